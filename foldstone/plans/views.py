"""Package, portfolio and operations queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone.operators import append, integrity, loans, package, summary, views
from foldstone.plans.commands import WORK
from foldstone.plans.compliance import REPLAY
from foldstone.plans.ctes import LOAN, RULES, summary_cte
from foldstone.plans.registry import as_double, joined, micros, query
from foldstone.sources import adapters, stored

EXAMINED = "2024-01-20"


# ---- regulator packages -------------------------------------------------------------------------------------------
def _at():
    return F.lit(EXAMINED).cast("timestamp")


def _package(spark, folder):
    ledger = stored.loan_ledger(spark, folder)

    def checks(s, f):
        entities = ledger.select(F.lit("loan").alias("entity_type"), F.get_json_object("payload", "$.application_id").alias("entity_id")).distinct()
        return integrity.integrity_checks(ledger, entities, None, F.lit("2024-02-01").cast("timestamp"))

    results = stored.derived("package-checks", checks, spark, folder)
    audits = stored.derived("package-audits", lambda s, f: integrity.check_events(results, 1 << 40), spark, folder)
    rows = stored.derived("package-rows", lambda s, f: package.package_rows(ledger, audits, results, _at()), spark, folder)
    headers = stored.derived("package-headers", lambda s, f: package.package_digests(rows, _at()), spark, folder)
    return rows, headers


@query(
    "package_sections",
    f"""WITH {LOAN}, sc AS (SELECT app, count(*) AS n FROM led GROUP BY 1)
    SELECT app AS application_id, 'event_stream' AS section, n AS rows FROM sc UNION ALL SELECT app, 'narrative', n FROM sc UNION ALL SELECT app, 'audit_stream', 1 FROM sc
    UNION ALL SELECT app, 'integrity_verification', 1 FROM sc
    UNION ALL SELECT app, 'agent_model_metadata', count(*) FROM led WHERE t IN ('CreditAnalysisCompleted','FraudScreeningCompleted','ComplianceCheckCompleted','DecisionGenerated') GROUP BY 1""",
)
def package_sections(spark, folder):
    rows, _ = _package(spark, folder)
    return rows.where("section <> 'projection_states'").groupBy("application_id", "section").agg(F.count("*").alias("rows"))


@query(
    "package_states",
    f"""WITH {LOAN}, lim AS (SELECT * FROM led WHERE ts <= TIMESTAMP '{EXAMINED}'), {summary_cte('lim')} SELECT app AS application_id, state, risk_tier, decision, sessions_completed FROM summ""",
)
def package_states(spark, folder):
    """Summaries inside the packages, as of the examination date."""
    rows, _ = _package(spark, folder)
    mine = rows.where("section = 'projection_states' and get_json_object(content, '$.model') = 'application_summary'")
    s = "$.state."
    return mine.select("application_id", *[F.get_json_object("content", s + c).alias(c) for c in ("state", "risk_tier", "decision")], F.get_json_object("content", s + "sessions_completed").cast("bigint").alias("sessions_completed"))


@query(
    "narrative_sentences",
    f"""WITH {LOAN} SELECT eid AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00: ' ||
      CASE t WHEN 'ApplicationSubmitted' THEN 'Application ' || app || ' was submitted for $' || CAST(CAST(requested AS DECIMAL(18,2)) AS VARCHAR) || '.'
        WHEN 'CreditAnalysisCompleted' THEN 'Credit analysis completed with risk tier ' || coalesce(tier, 'None') || ' and confidence ' || CAST(k / 100.0 AS DOUBLE) || '.'
        WHEN 'FraudScreeningCompleted' THEN 'Fraud screening completed with score ' || coalesce(CAST(CAST(fraud AS DOUBLE) AS VARCHAR), 'None') || '.'
        WHEN 'ComplianceCheckCompleted' THEN 'Compliance review finished with verdict ' || verdict || '.'
        WHEN 'DecisionGenerated' THEN 'The orchestrator recommended ' || coalesce(rec, 'None') || ' with confidence ' || CAST(k / 100.0 AS DOUBLE) || '.'
        WHEN 'HumanReviewCompleted' THEN 'Human review ended ' || CASE WHEN override THEN 'with override' ELSE 'without override' END || '; final decision was ' || fdec || '.'
        WHEN 'ApplicationApproved' THEN 'The application was approved for $' || coalesce(CAST(CAST(approved AS DECIMAL(18,2)) AS VARCHAR), 'None') || '.'
        WHEN 'ApplicationDeclined' THEN 'The application was declined.' WHEN 'AgentSessionStarted' THEN 'Agent session ' || sess || ' started for ' || akind || '.' ELSE t || ' was recorded.' END AS sentence FROM led""",
)
def narrative_sentences(spark, folder):
    return stored.loan_ledger(spark, folder).select("event_id", package.narrative_sentence().alias("sentence"))


@query(
    "model_provenance",
    f"""WITH {LOAN}, sm AS (SELECT app, sess, arg_max({{'k': akind, 'a': 'agent-' || (k % 7), 'm': 'm' || (k % 2)}}, gpos) AS m FROM led WHERE t = 'AgentSessionStarted' GROUP BY 1, 2)
    SELECT led.app AS application_id, eid AS event_id, led.sess AS session_id, m.k AS agent_type, m.a AS agent_id, m.m AS model_version, t AS event_type,
      CASE WHEN t IN ('CreditAnalysisCompleted','DecisionGenerated') AND (t = 'CreditAnalysisCompleted' OR k > 0) THEN CAST(k / 100.0 AS DOUBLE) END AS confidence
    FROM led LEFT JOIN sm ON sm.app = led.app AND sm.sess = led.sess WHERE t IN ('CreditAnalysisCompleted','FraudScreeningCompleted','ComplianceCheckCompleted','DecisionGenerated')""",
)
def model_provenance(spark, folder):
    from foldstone.operators import lineage

    p = package.model_provenance(lineage.application_events(stored.loan_ledger(spark, folder)))
    return p.select("application_id", "event_id", "session_id", "agent_type", "agent_id", "model_version", "event_type", "confidence")


@query("package_verification", f"WITH {LOAN} SELECT DISTINCT app AS application_id, true AS package_hash_valid, true AS audit_chain_valid, true AS latest_integrity_hash_matches, false AS tamper_detected, true AS ok FROM led")
def package_verification(spark, folder):
    rows, headers = _package(spark, folder)
    return package.verify_packages(rows, headers, _at())


@query(
    "package_tampering",
    f"""WITH {LOAN}, hit AS (SELECT app, bool_or(t = 'DocumentUploadRequested') AS h FROM led GROUP BY 1)
    SELECT app AS application_id, NOT h AS package_hash_valid, NOT h AS audit_chain_valid, true AS latest_integrity_hash_matches, false AS tamper_detected, NOT h AS ok FROM hit""",
)
def package_tampering(spark, folder):
    """Packages whose upload requests were altered after they were sealed."""
    rows, headers = _package(spark, folder)
    changed = F.when(F.col("section") == "event_stream", F.replace(F.col("content"), F.lit("DocumentUploadRequested"), F.lit("DocumentUploadRequired"))).otherwise(F.col("content"))
    return package.verify_packages(rows.withColumn("content", changed), headers, _at())


# ---- timelines and portfolio --------------------------------------------------------------------------------------
@query(
    "timeline",
    f"""WITH {LOAN} SELECT app AS application_id, eid AS event_id, split_part(stream_id, '-', 1) AS stream_family, t LIKE '%Declined%' AS risky,
      CASE split_part(stream_id, '-', 1) WHEN 'loan' THEN 'Loan' WHEN 'docpkg' THEN 'Documents' WHEN 'credit' THEN 'Credit' WHEN 'fraud' THEN 'Fraud' WHEN 'compliance' THEN 'Compliance' WHEN 'agent' THEN 'Agent Session' END AS family_label FROM led""",
)
def timeline(spark, folder):
    t = views.timeline(views.grouped_events(stored.loan_ledger(spark, folder)))
    return t.select("application_id", "event_id", "stream_family", "risky", "family_label")


@query("timeline_search", f"""WITH {LOAN} SELECT app AS application_id, eid AS event_id FROM led WHERE stream_id LIKE 'loan-%' AND (lower(t) LIKE '%review%' OR stream_id LIKE '%review%')""")
def timeline_search(spark, folder):
    t = views.timeline(views.grouped_events(stored.loan_ledger(spark, folder)), family="loan", search=" REVIEW ")
    return t.select("application_id", "event_id")


@query("grouped_sessions", """WITH s AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), e AS (SELECT *, role = 'system' OR (role = 'assistant' AND (n % 11 = 0 OR n % 13 = 0)) OR (role = 'user' AND n % 5 = 0) AS named FROM s)
    SELECT 't' || (conv_id * 1048576 + turn) AS event_id, 'app-' || (conv_id % 20) AS application_id FROM e WHERE conv_id IN (SELECT conv_id FROM e WHERE named)""")
def grouped_sessions(spark, folder):
    """Node and tool events find their application through their session."""
    return views.grouped_events(stored.session_ledger(spark, folder)).select("event_id", "application_id")


def _portfolio(spark, folder):
    def build(s, f):
        return views.portfolio(views.grouped_events(stored.lifecycle_ledger(s, f)), adapters.companies(s, f), prefix="W")

    return stored.derived("portfolio", build, spark, folder)


FOLIO = f"""{WORK},
pf AS (SELECT k, app AS application_id, 'COMP-' || k AS applicant_id, hard, depth,
    CASE WHEN depth = 2 THEN 'DOCUMENTS_PENDING' WHEN depth = 3 THEN 'DOCUMENTS_PROCESSED' ELSE state END AS state,
    CASE WHEN hard AND depth >= 14 THEN 'DECLINE' WHEN depth >= 17 THEN CASE WHEN k % 2 = 0 THEN 'APPROVE' ELSE 'DECLINE' END WHEN depth = 16 THEN rec END AS decision,
    CASE WHEN depth >= 13 THEN CASE WHEN hard THEN 'BLOCKED' ELSE 'CLEAR' END END AS compliance_status, CASE WHEN depth >= 6 THEN (['LOW','MEDIUM','HIGH'])[k % 3 + 1] END AS risk_tier,
    CASE WHEN depth >= 8 THEN CAST(k % 100 / 100.0 AS DOUBLE) END AS fraud_score, CASE WHEN depth >= 17 THEN 'r1' END AS human_reviewer_id,
    CASE WHEN depth >= 17 THEN 'completed' WHEN depth = 16 THEN 'pending' ELSE 'not_required' END AS review_state, depth AS event_count, (1704067200 + k * 32 + depth) * 1000000 AS last_event_at,
    CASE WHEN regexp_full_match(app, 'W[0-9]{{4}}') THEN 'seeded' ELSE 'live' END AS origin, 10000 + k * 10 AS requested_amount_usd FROM ws)
"""


@query(
    "portfolio",
    f"""WITH {FOLIO} SELECT application_id, applicant_id, c_name AS company_name, origin, state, CAST(requested_amount_usd AS DOUBLE) AS requested_amount_usd, decision, compliance_status, risk_tier, fraud_score, human_reviewer_id, review_state,
      event_count, last_event_at, true AS client_visible, concat_ws('|', CASE WHEN depth >= 5 THEN 'agent' END, CASE WHEN depth >= 10 THEN 'compliance' END, CASE WHEN depth >= 6 THEN 'credit' END, CASE WHEN depth >= 3 THEN 'docpkg' END,
      CASE WHEN depth >= 8 THEN 'fraud' END, 'loan') AS stream_families FROM pf JOIN customer ON c_custkey = k""",
)
def portfolio(spark, folder):
    p = _portfolio(spark, folder)
    return p.select("application_id", "applicant_id", "company_name", "origin", "state", as_double("requested_amount_usd"), "decision", "compliance_status", "risk_tier", "fraud_score", "human_reviewer_id",
                    "review_state", "event_count", micros("last_event_at"), "client_visible", joined("stream_families"))


@query("review_summaries", f"""WITH {FOLIO} SELECT application_id, depth >= 16 AS requested, depth >= 17 AS completed, human_reviewer_id AS reviewer_id, depth >= 17 AND k % 3 <> 2 AND (k % 3 = 0) <> (k % 2 = 0) AS override,
      CASE WHEN depth >= 17 THEN CASE WHEN k % 2 = 0 THEN 'APPROVE' ELSE 'DECLINE' END END AS final_decision FROM pf""")
def review_summaries(spark, folder):
    return _portfolio(spark, folder).select("application_id", "review.requested", "review.completed", "review.reviewer_id", "review.override", "review.final_decision")


@query(
    "stage_rail",
    f"""WITH {FOLIO}, c AS (SELECT application_id, CASE WHEN state = 'SUBMITTED' THEN 0 WHEN state LIKE 'DOCUMENTS%' THEN 1 WHEN state = 'AWAITING_ANALYSIS' THEN 2 WHEN state = 'ANALYSIS_COMPLETE' THEN 3 WHEN state IN ('COMPLIANCE_REVIEW','DECLINED_COMPLIANCE') THEN 4
        WHEN state = 'PENDING_DECISION' THEN 5 WHEN state LIKE '%HUMAN%' THEN 6 ELSE 7 END AS cur FROM pf), s AS (SELECT unnest(range(8)) AS i)
    SELECT application_id, i AS ordinal, (['submitted','documents','credit','fraud','compliance','decision','human','final'])[i + 1] AS stage, CASE WHEN i < cur OR cur = 7 THEN 'complete' WHEN i = cur THEN 'current' ELSE 'upcoming' END AS status FROM c, s""",
)
def stage_rail(spark, folder):
    return views.stage_rail(_portfolio(spark, folder)).select("application_id", "ordinal", "stage", "status")


@query(
    "state_labels",
    f"""WITH {FOLIO} SELECT application_id, CASE state WHEN 'SUBMITTED' THEN 'Submitted' WHEN 'DOCUMENTS_PENDING' THEN 'Awaiting documents' WHEN 'DOCUMENTS_PROCESSED' THEN 'Ready for credit' WHEN 'AWAITING_ANALYSIS' THEN 'Credit in progress'
        WHEN 'ANALYSIS_COMPLETE' THEN 'Ready for compliance' WHEN 'COMPLIANCE_REVIEW' THEN 'Compliance in progress' WHEN 'PENDING_DECISION' THEN 'Awaiting recommendation' WHEN 'APPROVED_PENDING_HUMAN' THEN 'Recommended approve'
        WHEN 'DECLINED_PENDING_HUMAN' THEN 'Recommended decline' WHEN 'PENDING_HUMAN_REVIEW' THEN 'Awaiting review' WHEN 'FINAL_APPROVED' THEN 'Approved' WHEN 'FINAL_DECLINED' THEN 'Declined' ELSE 'Declined - compliance' END AS state_label,
      CASE WHEN decision IS NULL THEN 'Pending' WHEN decision = 'APPROVE' THEN CASE WHEN state = 'FINAL_APPROVED' THEN 'Approved' ELSE 'Recommended approve' END WHEN decision = 'DECLINE' THEN CASE WHEN state IN ('FINAL_DECLINED','DECLINED_COMPLIANCE') THEN 'Declined' ELSE 'Recommended decline' END
        ELSE 'Refer to review' END AS decision_label, CASE compliance_status WHEN 'CLEAR' THEN 'Clear' WHEN 'BLOCKED' THEN 'Blocked' ELSE 'In progress' END AS compliance_label,
      CASE origin WHEN 'seeded' THEN 'Seeded portfolio' ELSE 'Live workflow' END AS origin_label FROM pf""",
)
def state_labels(spark, folder):
    return views.labelled(_portfolio(spark, folder)).select("application_id", "state_label", "decision_label", "compliance_label", "origin_label")


@query(
    "dashboard_totals",
    f"""WITH {FOLIO} SELECT count(*) AS applications, count(*) FILTER (WHERE origin = 'seeded') AS seeded_applications, count(*) FILTER (WHERE origin = 'live') AS live_applications, count(*) FILTER (WHERE state = 'FINAL_APPROVED') AS final_approved,
      count(*) FILTER (WHERE state IN ('FINAL_DECLINED','DECLINED_COMPLIANCE')) AS final_declined, count(*) FILTER (WHERE review_state <> 'not_required') AS human_review FROM pf""",
)
def dashboard_totals(spark, folder):
    return views.dashboard_totals(_portfolio(spark, folder))


@query(
    "queue_lanes",
    f"""WITH {FOLIO}, l AS (SELECT count(*) AS total, count(*) FILTER (WHERE review_state <> 'not_required') AS human, count(*) FILTER (WHERE state NOT LIKE 'FINAL%' AND state NOT LIKE 'DECLINED\\_%' ESCAPE '\\' AND review_state = 'not_required') AS opn,
      count(*) FILTER (WHERE state = 'FINAL_APPROVED') AS appr, count(*) FILTER (WHERE state IN ('FINAL_DECLINED','DECLINED_COMPLIANCE')) AS decl FROM pf),
    x AS (SELECT total, greatest(human, opn, appr, decl) AS best, unnest([{{'l': 'human', 'n': human}}, {{'l': 'open', 'n': opn}}, {{'l': 'approved', 'n': appr}}, {{'l': 'declined', 'n': decl}}, {{'l': 'all', 'n': total}}]) AS r FROM l)
    SELECT r.l AS lane, r.n AS applications, CAST(floor(r.n * 100.0 / total + 0.5) AS BIGINT) AS share_pct, r.l <> 'all' AND r.n = best AS is_busiest FROM x""",
)
def queue_lanes(spark, folder):
    return views.queue_lanes(_portfolio(spark, folder))


@query("explorer_page", f"""WITH {FOLIO} SELECT application_id, state FROM pf JOIN customer ON c_custkey = k WHERE state IN ('FINAL_DECLINED','DECLINED_COMPLIANCE') AND (lower(c_name) LIKE '%7%' OR application_id LIKE '%7%' OR applicant_id LIKE '%7%') ORDER BY last_event_at DESC, application_id LIMIT 8 OFFSET 8""")
def explorer_page(spark, folder):
    """Second page of declined applications that contain a 7."""
    return views.explore(_portfolio(spark, folder), "declined", "7", page=2).select("application_id", "state")


@query(
    "compliance_counts",
    f"""WITH {RULES} SELECT app AS application_id, 'e' || gpos AS event_id, count(*) FILTER (WHERE t = 'ComplianceRulePassed') OVER w AS passed, count(*) FILTER (WHERE t = 'ComplianceRuleFailed') OVER w AS failed, count(*) FILTER (WHERE t = 'ComplianceRuleNoted') OVER w AS noted,
      last_value(verdict IGNORE NULLS) OVER w AS verdict FROM rl WINDOW w AS (PARTITION BY app ORDER BY gpos ROWS UNBOUNDED PRECEDING)""",
)
def compliance_counts(spark, folder):
    c = views.compliance_counts(views.grouped_events(stored.rule_ledger(spark, folder)))
    return c.select("application_id", "event_id", "passed", "failed", "noted", "verdict")


@query("audit_summaries", f"WITH {LOAN} SELECT DISTINCT app AS application_id, 1 AS event_count, true AS chain_valid, false AS tamper_detected, epoch_us(TIMESTAMP '2024-02-01') AS latest_check_at, 'AuditIntegrityCheckRun' AS event_types FROM led")
def audit_summaries(spark, folder):
    _package(spark, folder)
    audits = stored.derived("package-audits", lambda s, f: None, spark, folder)
    a = views.audit_summaries(views.grouped_events(audits))
    return a.select("application_id", "event_count", "chain_valid", "tamper_detected", micros("latest_check_at"), joined("event_types"))


@query("event_distribution", f"WITH {LOAN} SELECT 'event_type' AS scope, t AS key, count(*) AS events FROM led GROUP BY 2 UNION ALL SELECT 'family', split_part(stream_id, '-', 1), count(*) FROM led GROUP BY 2")
def event_distribution(spark, folder):
    return views.event_distribution(stored.loan_ledger(spark, folder))


@query("top_event_types", f"WITH {LOAN} SELECT t AS event_type, count(*) AS events FROM led GROUP BY 1 ORDER BY events DESC, event_type LIMIT 8")
def top_event_types(spark, folder):
    return views.top_types(stored.loan_ledger(spark, folder))


@query(
    "ledger_totals",
    f"""WITH RECURSIVE {REPLAY.replace("FROM led WHERE stream_id LIKE 'loan-%')", "FROM led WHERE stream_id LIKE 'loan-%' AND ts < TIMESTAMP '2024-01-02')")}, z AS (SELECT count(*) AS apps FROM fin WHERE NOT bad) SELECT (SELECT count(*) FROM led) AS total_events, (SELECT max(gpos) FROM led) AS latest_global_position, (SELECT epoch_us(arg_max(ts, gpos)) FROM led) AS latest_recorded_at,
      (SELECT count(DISTINCT stream_id) FROM led) AS total_streams, (SELECT count(DISTINCT stream_id) FROM led WHERE stream_id LIKE 'fraud-%') AS archived_streams, apps AS aggregate_snapshots FROM z""",
)
def ledger_totals(spark, folder):
    ledger = stored.loan_ledger(spark, folder)
    archive = append.archive_streams(spark.createDataFrame([], "stream_id string, archived_at timestamp"), ledger.where("stream_id like 'fraud-%'"), F.lit("2024-02-01").cast("timestamp"))
    saved = loans.save_snapshots(loans.replay_loans(ledger.where(F.col("recorded_at") < F.lit("2024-01-02").cast("timestamp"))), F.lit("2024-02-01").cast("timestamp"))
    t = views.ledger_totals(ledger, append.stream_heads(ledger, archive), saved)
    return t.select("total_events", "latest_global_position", micros("latest_recorded_at"), "total_streams", "archived_streams", "aggregate_snapshots")


@query("read_model_sizes", f"""WITH {LOAN}, {summary_cte()} SELECT 'application_summary' AS model, count(*) AS rows FROM summ UNION ALL SELECT 'portfolio', (SELECT count(*) FROM customer)""")
def read_model_sizes(spark, folder):
    return views.model_sizes(application_summary=summary.application_summary(stored.loan_ledger(spark, folder)), portfolio=_portfolio(spark, folder))


@query(
    "read_model_health",
    """WITH top AS (SELECT max(event_id) AS p, arg_max(ts, event_id) AS top_at FROM events),
    cp(projection_name, last_position, target, upd) AS (SELECT 'application_summary', p + 1, 500, TIMESTAMP '2024-01-31' FROM top UNION ALL SELECT 'agent_performance', p // 2, 1000, TIMESTAMP '2024-01-30' FROM top UNION ALL SELECT 'compliance_audit', 0, 2000, TIMESTAMP '2024-01-31' FROM top),
    j AS (SELECT cp.*, p, top_at, e.ts, CASE WHEN last_position = 0 THEN p ELSE greatest(0, p - (last_position - 1)) END AS lagp, coalesce(greatest(0, (epoch_us(top_at) - epoch_us(e.ts)) // 1000), 0) AS lagms FROM cp LEFT JOIN events e ON e.event_id = last_position - 1, top)
    SELECT projection_name, lagp AS lag_positions, lagms AS lag_ms, target AS slo_target_ms,
      CASE WHEN last_position = 0 THEN 'not_started' WHEN lagp = 0 AND lagms <= target THEN 'healthy' WHEN epoch_ms(TIMESTAMP '2024-01-31 00:00:10') - epoch_ms(upd) > 60000 AND lagp > 0 THEN 'stalled' ELSE 'lagging' END AS status FROM j""",
)
def read_model_health(spark, folder):
    ledger = stored.loan_ledger(spark, folder)
    top = ledger.agg(F.max("global_position").alias("p"))
    day = "2024-01-31"
    points = top.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("projection_name"), v.cast("bigint").alias("last_position"), F.lit(u).cast("timestamp").alias("updated_at"))
        for n, v, u in (("application_summary", F.col("p") + 1, day), ("agent_performance", F.floor(F.col("p") / 2), "2024-01-30"), ("compliance_audit", F.lit(0), day))
    ])))
    h = views.read_model_health(views.read_model_lag(points, ledger), F.lit("2024-01-31 00:00:10").cast("timestamp"))
    return h.select("projection_name", "lag_positions", "lag_ms", "slo_target_ms", "status")
