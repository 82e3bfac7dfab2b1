"""Compliance read model and loan replay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone.operators import compliance, loans, verify
from foldstone.plans.ctes import LOAN, RULES
from foldstone.plans.registry import as_double, joined, micros, query
from foldstone.session import stage
from foldstone.sources import stored

HISTORY = f"""{RULES},
seg AS (
  SELECT *, sum(CASE WHEN t = 'ComplianceCheckInitiated' THEN 1 ELSE 0 END) OVER w AS segment, row_number() OVER w AS ver,
    last_value(CASE WHEN t = 'ComplianceCheckInitiated' THEN {{'rs': regset, 'rq': required}} END IGNORE NULLS) OVER w AS op,
    last_value(CASE WHEN t IN ('ComplianceCheckInitiated','ComplianceCheckCompleted') THEN {{'c': t = 'ComplianceCheckCompleted', 'v': verdict}} END IGNORE NULLS) OVER w AS cl
  FROM rl WINDOW w AS (PARTITION BY app ORDER BY gpos ROWS UNBOUNDED PRECEDING)),
cnt AS (
  SELECT *, count(*) FILTER (WHERE t = 'ComplianceRulePassed') OVER s AS np, count(*) FILTER (WHERE t = 'ComplianceRuleFailed') OVER s AS nf,
    count(*) FILTER (WHERE t = 'ComplianceRuleNoted') OVER s AS nn, count(*) FILTER (WHERE hard) OVER s AS nh
  FROM seg WINDOW s AS (PARTITION BY app, segment ORDER BY gpos ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT app, segment, min(gpos) AS cut FROM cnt WHERE has_hard AND nh = 0 AND nf > 0 GROUP BY 1, 2),
blk AS (
  SELECT c.gpos, string_agg(DISTINCT f.rule, '|' ORDER BY f.rule) AS hb
  FROM cnt c LEFT JOIN cut x ON x.app = c.app AND x.segment = c.segment
  JOIN cnt f ON f.app = c.app AND f.segment = c.segment AND f.t = 'ComplianceRuleFailed' AND f.gpos <= c.gpos AND (f.hard OR (x.cut <= c.gpos AND f.gpos <= x.cut))
  GROUP BY 1),
hist AS (
  SELECT c.app AS application_id, ver AS snapshot_version, CAST(c.segment AS BIGINT) AS segment, c.gpos AS global_position, epoch_us(ts) AS as_of, t AS last_event_type,
    CASE WHEN op IS NOT NULL THEN 's' || c.app END AS session_id, op.rs AS regulation_set_version, coalesce(array_to_string(op.rq, '|'), '') AS required_rules,
    np AS passed_count, nf AS failed_count, nn AS noted_count, coalesce(hb, '') AS hard_block_rules, coalesce(cl.c, false) AS completed,
    cl.v AS overall_verdict, c.gpos + 1 AS checkpoint_position, ts
  FROM cnt c LEFT JOIN blk USING (gpos))
"""
COLUMNS = """application_id, snapshot_version, segment, global_position, as_of, last_event_type, session_id, regulation_set_version,
required_rules, passed_count, failed_count, noted_count, hard_block_rules, completed, overall_verdict, checkpoint_position"""


def _flat(df, *extra):
    return df.select(
        *extra, "application_id", "snapshot_version", "segment", "global_position", micros("as_of"), "last_event_type", "session_id",
        "regulation_set_version", joined("required_rules"), "passed_count", "failed_count", "noted_count", joined("hard_block_rules"),
        "completed", "overall_verdict", "checkpoint_position",
    )


@query("compliance_history", f"WITH {HISTORY} SELECT {COLUMNS} FROM hist")
def compliance_history(spark, folder):
    return _flat(compliance.compliance_history(stored.rule_ledger(spark, folder)))


@query("compliance_current", f"WITH {HISTORY} SELECT {COLUMNS} FROM hist QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY global_position DESC) = 1")
def compliance_current(spark, folder):
    return _flat(compliance.compliance_current(stored.rule_ledger(spark, folder)))


@query(
    "rebuild_compliance",
    f"""WITH {HISTORY}, cur AS (SELECT *, application_id::BIGINT AS u FROM hist QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY global_position DESC) = 1)
    SELECT application_id, 'missing' AS problem, NULL AS field, NULL AS stored, NULL AS expected FROM cur WHERE u % 37 = 0
    UNION ALL SELECT 'ghost-' || application_id, 'unexpected', NULL, NULL, NULL FROM cur WHERE u % 17 = 1
    UNION ALL SELECT application_id, 'mismatch', 'passed_count', (passed_count + 1)::VARCHAR, passed_count::VARCHAR FROM cur WHERE u % 37 <> 0 AND u % 11 = 3
    UNION ALL SELECT application_id, 'mismatch', 'hard_block_rules', 'REG-999', hard_block_rules FROM cur WHERE u % 37 <> 0 AND u % 13 = 5
    UNION ALL SELECT application_id, 'mismatch', 'completed', (NOT completed)::VARCHAR, completed::VARCHAR FROM cur WHERE u % 37 <> 0 AND u % 19 = 2""",
)
def rebuild_compliance(spark, folder):
    """Current states with lost, invented and changed rows against a recomputation."""
    ledger = stored.rule_ledger(spark, folder)
    rows = stage(compliance.compliance_current(ledger))
    u = F.col("application_id").cast("bigint")
    changed = rows.where(u % 37 != 0).withColumns({
        "passed_count": F.col("passed_count") + (u % 11 == 3).cast("int"),
        "hard_block_rules": F.when(u % 13 == 5, F.array(F.lit("REG-999"))).otherwise(F.col("hard_block_rules")),
        "completed": F.when(u % 19 == 2, ~F.col("completed")).otherwise(F.col("completed")),
    })
    ghosts = rows.where(u % 17 == 1).withColumn("application_id", F.concat(F.lit("ghost-"), "application_id"))
    return verify.verify_compliance(stage(changed.unionByName(ghosts)), ledger)


@query(
    "compliance_as_of",
    f"""WITH {HISTORY}, probes AS (SELECT gpos, app, ts - INTERVAL 30 MINUTE AS at FROM ev)
    SELECT p.gpos AS probe, p.app AS application_id, h.snapshot_version, h.passed_count, h.failed_count, h.hard_block_rules, h.completed, h.overall_verdict
    FROM probes p ASOF LEFT JOIN hist h ON p.app = h.application_id AND p.at >= h.ts""",
)
def compliance_as_of(spark, folder):
    ledger = stored.rule_ledger(spark, folder)
    history = compliance.compliance_history(ledger)
    probes = ledger.select(
        F.col("global_position").alias("probe"), F.regexp_replace("stream_id", "^compliance-", "").alias("application_id"),
        (F.col("recorded_at") - F.expr("interval 30 minutes")).alias("at"),
    )
    found = compliance.compliance_at(history, probes)
    return found.select("probe", "application_id", "snapshot_version", "passed_count", "failed_count", joined("hard_block_rules"), "completed", "overall_verdict")


RESULTS = """rs AS (SELECT *, sum(CASE WHEN t = 'ComplianceCheckInitiated' THEN 1 ELSE 0 END) OVER (PARTITION BY app ORDER BY gpos ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM rl),
opened AS (SELECT app, segment - 1 AS segment, gpos, ts FROM rs WHERE t = 'ComplianceCheckInitiated'),
res AS (SELECT rs.app AS application_id, rs.segment, lower(t[15:]) AS rule_class, row_number() OVER (PARTITION BY rs.app, rs.segment, t ORDER BY rs.gpos) AS ordinal, rule AS rule_id, 'Rule ' || rule AS rule_name,
    CASE WHEN t <> 'ComplianceRuleNoted' THEN 'v' || (k % 3) END AS rule_version, CASE WHEN t <> 'ComplianceRuleNoted' THEN 'ev' || rs.gpos END AS evidence_hash,
    CASE WHEN t = 'ComplianceRulePassed' THEN 'checked ' || k END AS evaluation_notes, CASE WHEN t = 'ComplianceRuleFailed' THEN 'failed ' || k END AS failure_reason,
    CASE WHEN t = 'ComplianceRuleFailed' THEN k % 10 = 0 END AS is_hard_block, CASE WHEN t = 'ComplianceRuleFailed' THEN k % 2 = 0 END AS remediation_available,
    CASE WHEN t = 'ComplianceRuleFailed' AND k % 2 = 0 THEN 'remedy ' || k END AS remediation_description, CASE WHEN t = 'ComplianceRuleNoted' THEN (['INFO','LIMIT'])[k % 2 + 1] END AS note_type,
    CASE WHEN t = 'ComplianceRuleNoted' THEN 'note ' || k END AS note_text, epoch_us(rs.ts) AS evaluated_at, rs.gpos AS valid_from_position, epoch_us(rs.ts) AS valid_from,
    opened.gpos AS valid_until_position, epoch_us(opened.ts) AS valid_until
  FROM rs LEFT JOIN opened ON opened.app = rs.app AND opened.segment = rs.segment WHERE t LIKE 'ComplianceRule%')
"""


def _told(df):
    instants = ("evaluated_at", "valid_from", "valid_until")
    return df.select(*[micros(c) if c in instants else c for c in df.columns])


@query("compliance_rule_results", f"WITH {RULES}, {RESULTS} SELECT * FROM res")
def compliance_rule_results(spark, folder):
    return _told(compliance.rule_results(stored.rule_ledger(spark, folder)))


@query("compliance_rule_results_current", f"WITH {RULES}, {RESULTS} SELECT * FROM res WHERE valid_until_position IS NULL")
def compliance_rule_results_current(spark, folder):
    return _told(compliance.current_rule_results(compliance.rule_results(stored.rule_ledger(spark, folder))))


@query(
    "compliance_rule_results_as_of",
    f"""WITH {HISTORY}, {RESULTS}, probes AS (SELECT gpos, app, ts - INTERVAL 30 MINUTE AS at FROM ev)
    SELECT p.gpos AS probe, res.* FROM probes p ASOF JOIN hist h ON p.app = h.application_id AND p.at >= h.ts JOIN res ON res.application_id = h.application_id AND res.segment = h.segment AND valid_from_position <= h.global_position""",
)
def compliance_rule_results_as_of(spark, folder):
    """All that the rule results said in the state of an application half an hour before each of its events."""
    ledger = stored.rule_ledger(spark, folder)
    probes = ledger.select(
        F.col("global_position").alias("probe"), F.regexp_replace("stream_id", "^compliance-", "").alias("application_id"),
        (F.col("recorded_at") - F.expr("interval 30 minutes")).alias("at"),
    )
    return _told(compliance.rule_results_at(compliance.rule_results(ledger), compliance.compliance_history(ledger), probes).drop("at"))


@query(
    "compliance_rule_lists",
    f"""WITH {RULES}, o AS (SELECT app, max(gpos) AS g FROM rl WHERE t = 'ComplianceCheckInitiated' GROUP BY 1)
    SELECT rl.app AS application_id, CASE t WHEN 'ComplianceRulePassed' THEN 'passed' WHEN 'ComplianceRuleFailed' THEN 'failed' ELSE 'noted' END AS rule_class,
      row_number() OVER (PARTITION BY rl.app, t ORDER BY gpos) AS ordinal, rule AS rule_id
    FROM rl LEFT JOIN o ON rl.app = o.app WHERE t LIKE 'ComplianceRule%' AND (g IS NULL OR gpos > g)""",
)
def compliance_rule_lists(spark, folder):
    return compliance.rule_lists(stored.rule_ledger(spark, folder))


@query(
    "compliance_record",
    f"""WITH {RULES},
    a AS (SELECT app, count(*) AS version, arg_max(regset, gpos) FILTER (WHERE regset IS NOT NULL) AS regset,
        coalesce(arg_max(required, gpos) FILTER (WHERE t = 'ComplianceCheckInitiated'), []) AS req,
        coalesce(list_sort(list(DISTINCT rule) FILTER (WHERE t = 'ComplianceRulePassed')), []) AS p,
        coalesce(list_sort(list(DISTINCT rule) FILTER (WHERE t = 'ComplianceRuleFailed')), []) AS f,
        coalesce(list_sort(list(DISTINCT rule) FILTER (WHERE t = 'ComplianceRuleNoted')), []) AS n,
        min(gpos) FILTER (WHERE t = 'ComplianceRuleFailed') AS ff, min(gpos) FILTER (WHERE hard) AS fh,
        count(*) FILTER (WHERE t = 'ComplianceCheckCompleted') > 0 AS completed,
        arg_max(verdict, gpos) FILTER (WHERE t = 'ComplianceCheckCompleted') AS verdict
      FROM rl GROUP BY 1),
    c AS (SELECT rl.app, min(gpos) AS cut FROM rl JOIN a USING (app) WHERE has_hard AND gpos > ff GROUP BY 1),
    h AS (SELECT rl.app, list_sort(list(DISTINCT rule)) AS hb FROM rl JOIN a USING (app) LEFT JOIN c USING (app)
      WHERE t = 'ComplianceRuleFailed' AND (hard OR (cut IS NOT NULL AND (fh IS NULL OR fh > cut) AND gpos < cut)) GROUP BY 1)
    SELECT app AS application_id, version, CASE WHEN regset IS NOT NULL THEN 's' || app END AS session_id, regset AS regulation_set_version,
      array_to_string(req, '|') AS required_rules, array_to_string(p, '|') AS passed_rules, array_to_string(f, '|') AS failed_rules,
      array_to_string(n, '|') AS noted_rules, coalesce(array_to_string(hb, '|'), '') AS hard_block_rules, completed, verdict AS overall_verdict,
      hb IS NOT NULL AS has_hard_block,
      len(req) > 0 AND list_has_all(list_concat(p, list_concat(f, n)), req) AS all_required_evaluated,
      completed AND hb IS NULL AND list_has_all(p, list_filter(req, lambda r: r <> 'REG-006')) AND verdict = 'CLEAR' AS cleared_for_approval
    FROM a LEFT JOIN h USING (app)""",
)
def compliance_record(spark, folder):
    r = compliance.compliance_record(stored.rule_ledger(spark, folder))
    lists = ("required_rules", "passed_rules", "failed_rules", "noted_rules", "hard_block_rules")
    return r.select(*[joined(c) if c in lists else c for c in r.columns])


REPLAY = f"""{LOAN},
ord AS (
  SELECT *, row_number() OVER (PARTITION BY app ORDER BY gpos) AS rn,
    CASE t WHEN 'ApplicationSubmitted' THEN 'SUBMITTED' WHEN 'CreditAnalysisRequested' THEN 'AWAITING_ANALYSIS' WHEN 'FraudScreeningRequested' THEN 'ANALYSIS_COMPLETE'
      WHEN 'ComplianceCheckRequested' THEN 'COMPLIANCE_REVIEW' WHEN 'DecisionRequested' THEN 'PENDING_DECISION' WHEN 'ApplicationApproved' THEN 'FINAL_APPROVED'
      WHEN 'ApplicationDeclined' THEN 'FINAL_DECLINED'
      WHEN 'DecisionGenerated' THEN CASE rec WHEN 'APPROVE' THEN 'APPROVED_PENDING_HUMAN' WHEN 'DECLINE' THEN 'DECLINED_PENDING_HUMAN' ELSE 'PENDING_HUMAN_REVIEW' END END AS target,
    CASE WHEN t = 'ApplicationSubmitted' AND k % 12 = 0 THEN 'applicant_id' WHEN t = 'ApplicationSubmitted' AND k % 40 = 0 THEN 'application_reference'
      WHEN t = 'DecisionGenerated' AND k % 25 = 0 THEN 'recommendation' WHEN t = 'ApplicationApproved' AND k % 16 = 3 THEN 'approved_amount_usd' END AS miss
  FROM led WHERE stream_id LIKE 'loan-%'),
ok(a, b) AS (VALUES ('NEW','SUBMITTED'),('SUBMITTED','AWAITING_ANALYSIS'),('AWAITING_ANALYSIS','ANALYSIS_COMPLETE'),('ANALYSIS_COMPLETE','COMPLIANCE_REVIEW'),
  ('COMPLIANCE_REVIEW','PENDING_DECISION'),('COMPLIANCE_REVIEW','DECLINED_COMPLIANCE'),('PENDING_DECISION','APPROVED_PENDING_HUMAN'),('PENDING_DECISION','DECLINED_PENDING_HUMAN'),
  ('PENDING_DECISION','PENDING_HUMAN_REVIEW'),('APPROVED_PENDING_HUMAN','FINAL_APPROVED'),('APPROVED_PENDING_HUMAN','FINAL_DECLINED'),('DECLINED_PENDING_HUMAN','FINAL_APPROVED'),
  ('DECLINED_PENDING_HUMAN','FINAL_DECLINED'),('PENDING_HUMAN_REVIEW','FINAL_APPROVED'),('PENDING_HUMAN_REVIEW','FINAL_DECLINED')),
run(app, rn, st, ev, tg, fld, bad) AS (
  SELECT DISTINCT app, CAST(0 AS BIGINT), 'NEW', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), false FROM ord
  UNION ALL
  SELECT app, rn, CASE WHEN is_bad OR miss IS NOT NULL THEN st ELSE coalesce(nxt, st) END, t,
    CASE WHEN is_bad AND NOT (t = 'DecisionGenerated' AND miss IS NOT NULL) THEN target END,
    CASE WHEN NOT is_bad OR t = 'DecisionGenerated' THEN miss END, is_bad OR miss IS NOT NULL
  FROM (SELECT r.app, o.rn, r.st, o.t, o.target, o.miss,
      CASE WHEN o.t = 'ApplicationDeclined' AND r.st = 'COMPLIANCE_REVIEW' THEN 'DECLINED_COMPLIANCE'
           WHEN o.t = 'HumanReviewRequested' AND r.st IN ('APPROVED_PENDING_HUMAN','DECLINED_PENDING_HUMAN') THEN 'PENDING_HUMAN_REVIEW' ELSE o.target END AS nxt,
      o.target IS NOT NULL AND NOT (o.t = 'ApplicationDeclined' AND r.st = 'COMPLIANCE_REVIEW') AND o.target <> r.st AND ok.a IS NULL AS is_bad
    FROM run r JOIN ord o ON o.app = r.app AND o.rn = r.rn + 1 LEFT JOIN ok ON ok.a = r.st AND ok.b = o.target WHERE NOT r.bad)),
fin AS (SELECT app, arg_max(st, rn) AS st, max(rn) AS rn, arg_max(bad, rn) AS bad, arg_max_null(ev, rn) AS ev, arg_max_null(tg, rn) AS tg, arg_max_null(fld, rn) AS fld FROM run GROUP BY 1),
cap AS (
  SELECT o.app, max(o.rn) AS version, arg_max_null(applicant, o.rn) FILTER (WHERE t = 'ApplicationSubmitted') AS applicant_id,
    arg_max_null(requested, o.rn) FILTER (WHERE t = 'ApplicationSubmitted') AS requested_amount_usd,
    arg_max(k + 12, o.rn) FILTER (WHERE t = 'ApplicationSubmitted') AS loan_term_months,
    coalesce(bool_or(t = 'DocumentUploadRequested'), false) AS documents_requested, coalesce(bool_or(t = 'CreditAnalysisRequested'), false) AS credit_requested,
    arg_max(fdec, o.rn) FILTER (WHERE t = 'HumanReviewCompleted') AS final_decision, arg_max(override, o.rn) FILTER (WHERE t = 'HumanReviewCompleted') AS human_override
  FROM ord o JOIN fin f ON f.app = o.app AND (NOT f.bad OR o.rn < f.rn) GROUP BY 1)
"""


@query(
    "loan_replay",
    f"""WITH RECURSIVE {REPLAY}
    SELECT f.app AS application_id, coalesce(c.version, -1) AS version, f.st AS state, CASE WHEN f.bad THEN f.rn END AS error_position,
      CASE WHEN f.bad THEN f.ev END AS error_event, CASE WHEN f.bad THEN f.tg END AS error_target, CASE WHEN f.bad THEN f.fld END AS error_field,
      applicant_id, requested_amount_usd, loan_term_months, coalesce(documents_requested, false) AS documents_requested,
      coalesce(credit_requested, false) AS credit_requested, coalesce(human_override, false) AS human_override
    FROM fin f LEFT JOIN cap c USING (app)""",
)
def loan_replay(spark, folder):
    r = loans.replay_loans(stored.loan_ledger(spark, folder))
    return r.select(
        "application_id", "version", "state", "error_position", "error_event", "error_target", "error_field", "applicant_id",
        as_double("requested_amount_usd"), "loan_term_months", "documents_requested", "credit_requested", "human_override",
    )


@query(
    "loan_replay_from_snapshots",
    f"""WITH RECURSIVE {REPLAY}
    SELECT f.app AS application_id, coalesce(c.version, -1) AS version, f.st AS state, CASE WHEN f.bad THEN f.rn END AS error_position,
      CASE WHEN f.bad THEN f.ev END AS error_event, applicant_id, requested_amount_usd
    FROM fin f LEFT JOIN cap c USING (app)""",
)
def loan_replay_from_snapshots(spark, folder):
    """Snapshots of the first ten days, then only later events; the result equals a replay of everything."""
    ledger = stored.loan_ledger(spark, folder)
    cutoff = F.lit("2024-01-02 00:00:00").cast("timestamp")
    saved = loans.save_snapshots(loans.replay_loans(ledger.where(F.col("recorded_at") < cutoff)), cutoff)
    r = loans.replay_loans(ledger, saved)
    return r.select("application_id", "version", "state", "error_position", "error_event", "applicant_id", as_double("requested_amount_usd"))
