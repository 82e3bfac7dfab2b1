"""Log queries: heads, append decisions, outbox, constraints, validation and upgrades."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldstone.operators import append, evolution
from foldstone.plans.ctes import LOAN
from foldstone.plans.registry import micros, query
from foldstone.sources import adapters, stored


@query(
    "stream_heads",
    f"""WITH {LOAN} SELECT stream_id, count(*) AS current_version, count(*) AS events, epoch_us(min(ts)) AS created_at,
      CASE split_part(stream_id, '-', 1) WHEN 'loan' THEN 'LoanApplication' WHEN 'docpkg' THEN 'DocumentPackage' WHEN 'agent' THEN 'AgentSession' WHEN 'credit' THEN 'CreditRecord'
        WHEN 'fraud' THEN 'FraudScreening' WHEN 'compliance' THEN 'ComplianceRecord' END AS aggregate_type,
      CASE WHEN stream_id LIKE 'loan-1%' THEN epoch_us(TIMESTAMP '2024-02-01') END AS archived_at
    FROM led GROUP BY stream_id""",
)
def stream_heads(spark, folder):
    ledger = stored.loan_ledger(spark, folder)
    asked = ledger.where(F.col("stream_id").startswith("loan-1")).select("stream_id")
    empty = spark.createDataFrame([], "stream_id string, archived_at timestamp")
    archive = append.archive_streams(empty, asked, F.lit("2024-02-01").cast("timestamp"))
    h = append.stream_heads(ledger, archive)
    return h.select("stream_id", "current_version", "events", micros("created_at"), "aggregate_type", micros("archived_at"))


@query(
    "stream_range",
    f"""WITH {LOAN}, n AS (SELECT stream_id, eid, t, row_number() OVER (PARTITION BY stream_id ORDER BY gpos) AS pos FROM led)
    SELECT stream_id, pos AS stream_position, eid AS event_id, t AS event_type FROM n WHERE stream_id LIKE 'loan-%' AND pos BETWEEN 2 AND 5""",
)
def stream_range(spark, folder):
    from foldstone.sources.ledger import stream_events

    rows = stream_events(stored.loan_ledger(spark, folder), family="loan", from_position=2, to_position=5)
    return rows.select("stream_id", "stream_position", "event_id", "event_type")


@query(
    "log_after_position",
    f"WITH {LOAN} SELECT eid AS event_id, gpos AS global_position, stream_id, t AS event_type FROM led WHERE gpos > (SELECT max(gpos) // 2 FROM led)",
)
def log_after_position(spark, folder):
    from foldstone.sources.ledger import log_after

    ledger = stored.loan_ledger(spark, folder)
    half = ledger.agg((F.max("global_position") / 2).cast("bigint")).first()[0]
    return log_after(ledger, half).select("event_id", "global_position", "stream_id", "event_type")


@query("log_check", f"""WITH {LOAN}, d AS (SELECT eid, stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY gpos) AS pos, gpos, CASE WHEN gpos % 103 = 0 THEN 0 ELSE gpos END AS g, t FROM led),
    k0 AS (SELECT * FROM d WHERE t <> 'DocumentUploadRequested'), kept AS (SELECT *, lag(pos) OVER w AS prev, lag(g) OVER w AS pg FROM k0 WINDOW w AS (PARTITION BY stream_id ORDER BY pos))
    SELECT 'gap' AS problem, stream_id || ':' || pos AS subject, pos - coalesce(prev, 0) - 1 AS detail FROM kept WHERE pos <> coalesce(prev, 0) + 1
    UNION ALL SELECT 'duplicate_event_id', eid, 2 FROM k0 WHERE gpos % 101 = 0 UNION ALL SELECT 'duplicate_position', stream_id || ':' || pos, 2 FROM k0 WHERE gpos % 101 = 0
    UNION ALL SELECT 'global_order', stream_id || ':' || pos, g FROM kept WHERE g <= pg""")
def log_check(spark, folder):
    """Constraint check of a log that lost its upload requests, has some events twice and others at position 0."""
    at = F.col("global_position")
    kept = stored.loan_ledger(spark, folder).where("event_type <> 'DocumentUploadRequested'")
    twice = kept.where(at % 101 == 0)
    return append.check_log(kept.unionByName(twice).withColumn("global_position", F.when(at % 103 == 0, F.lit(0).cast("bigint")).otherwise(at)))


def _requests(spark, folder):
    from foldstone.operators.scan import running, total
    from foldstone.session import stage

    src = adapters.table(spark, folder, "events").select("event_id", F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    n = F.col("k") % 2 + 1
    good = F.col("k") % 4 >= 2
    sized = stage(src.select("*", n.alias("n"), good.alias("good"), F.concat(F.lit("q-"), F.col("u").cast("string")).alias("stream_id")))
    planned = running(sized, ["stream_id"], "event_id", {"_sum": total(F.when(F.col("good"), F.col("n")).otherwise(F.lit(0)).cast("bigint"), inclusive=False)})
    base = F.when(F.col("u") % 10 == 0, F.lit(5)).otherwise(F.lit(0))
    head = F.when((base == 0) & (F.col("_sum") == 0), F.lit(-1)).otherwise(base + F.col("_sum"))
    expected = F.when(F.col("good"), head).otherwise(head - 1 - F.col("k") % 4)
    event = F.struct(
        F.lit(None).cast("string").alias("event_id"), F.lit("Noted").alias("event_type"), F.lit(1).alias("event_version"), F.lit("{}").alias("payload"),
        F.lit('{"by":"x"}').alias("metadata"), F.col("ts").alias("recorded_at"),
    )
    requests = planned.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"), F.col("event_id").alias("request_order"), "stream_id", expected.cast("bigint").alias("expected_version"),
        F.array_repeat(event, F.col("n")).alias("events"), F.concat(F.lit("cause-"), F.col("k").cast("string")).alias("causation_id"),
        F.when(F.col("k") % 3 == 0, F.lit('{"correlation_id":"c","stream_metadata":{},"outbox_destinations":["a"]}')).alias("metadata"),
    )
    heads = sized.where(F.col("u") % 10 == 0).select(
        "stream_id", F.lit(5).cast("bigint").alias("current_version"), F.when(F.col("u") % 20 == 0, F.lit("2024-01-01").cast("timestamp")).alias("archived_at")
    ).distinct()
    return requests, heads


APPENDS = """ev AS (SELECT event_id, user_id AS u, 'q-' || user_id AS stream_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
pl AS (SELECT *, k % 2 + 1 AS n, row_number() OVER w AS rn, coalesce(sum(CASE WHEN k % 4 >= 2 THEN k % 2 + 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
    CASE WHEN u % 10 = 0 THEN 5 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY u ORDER BY event_id)),
rq AS (SELECT *, CASE WHEN k % 4 >= 2 THEN h ELSE h - 1 - k % 4 END AS expected FROM (SELECT *, CASE WHEN b = 0 AND s = 0 THEN -1 ELSE b + s END AS h FROM pl)),
run(u, rn, event_id, expected, actual, head, status) AS (
  SELECT DISTINCT u, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(CASE WHEN u % 10 = 0 THEN 5 ELSE -1 END AS BIGINT), '' FROM rq
  UNION ALL
  SELECT r.u, q.rn, q.event_id, CAST(q.expected AS BIGINT), r.head, CASE WHEN q.expected = r.head AND r.u % 20 <> 0 THEN greatest(r.head, 0) + q.n ELSE r.head END,
    CASE WHEN q.expected <> r.head THEN 'conflict' WHEN r.u % 20 = 0 THEN 'archived' ELSE 'accepted' END
  FROM run r JOIN rq q ON q.u = r.u AND q.rn = r.rn + 1)
"""


@query(
    "append_decisions",
    f"""WITH RECURSIVE {APPENDS} SELECT 'r' || event_id AS request_id, 'q-' || u AS stream_id, status, expected AS expected_version, actual AS actual_version,
      CASE status WHEN 'conflict' THEN 'OptimisticConcurrencyError' WHEN 'archived' THEN 'DomainError' END AS error_type,
      CASE WHEN status = 'conflict' THEN 'reload_stream_and_retry' END AS suggested_action,
      CASE WHEN status = 'accepted' THEN greatest(actual, 0) + 1 END AS first_position, CASE WHEN status = 'accepted' THEN head END AS last_position
    FROM run WHERE rn > 0""",
)
def append_decisions(spark, folder):
    requests, heads = _requests(spark, folder)
    return append.decide_appends(requests, heads).drop("request_order")


@query(
    "appended_events",
    f"""WITH RECURSIVE {APPENDS}, ok AS (SELECT r.event_id, 'q-' || r.u AS stream_id, actual, n, k FROM run r JOIN ev USING (event_id) JOIN pl USING (event_id) WHERE status = 'accepted'),
    x AS (SELECT *, unnest(range(n)) AS i FROM ok)
    SELECT stream_id, greatest(actual, 0) + 1 + i AS stream_position, 1000 + row_number() OVER (ORDER BY event_id, i) AS global_position, 'Noted' AS event_type,
      CASE WHEN k % 3 = 0 THEN 'c' END AS correlation_id, 'cause-' || k AS causation_id, 'x' AS by_field FROM x""".replace("SELECT r.event_id, 'q-' || r.u AS stream_id, actual, n, k FROM run r JOIN ev USING (event_id) JOIN pl USING (event_id)", "SELECT r.event_id, 'q-' || r.u AS stream_id, actual, pl.n, pl.k FROM run r JOIN pl ON pl.event_id = r.event_id"),
)
def appended_events(spark, folder):
    requests, heads = _requests(spark, folder)
    from foldstone.session import stage

    requests = stage(requests)
    rows = append.accepted_events(requests, append.decide_appends(requests, heads), 1000)
    meta = "metadata"
    return rows.select(
        "stream_id", "stream_position", "global_position", "event_type", F.get_json_object(meta, "$.correlation_id").alias("correlation_id"),
        F.get_json_object(meta, "$.causation_id").alias("causation_id"), F.get_json_object(meta, "$.by").alias("by_field"),
    )


@query(
    "conflict_statistics",
    f"""WITH RECURSIVE {APPENDS}, {LOAN.replace("ev AS (", "ev0 AS (", 1).replace("FROM ev)", "FROM ev0)", 1)},
    decided AS (SELECT 'q-' || u AS stream_id, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'conflict') AS conflicts FROM run WHERE rn > 0 GROUP BY u),
    logged AS (SELECT 'q-' || app AS stream_id, count(*) FILTER (WHERE t = 'CreditAnalysisCompleted') AS completions, count(*) FILTER (WHERE t = 'HumanReviewRequested') AS failed_sessions, min(gpos) FILTER (WHERE t = 'ApplicationSubmitted') AS opened_position FROM led GROUP BY 1)
    SELECT stream_id, coalesce(accepted, 0) AS accepted, coalesce(conflicts, 0) AS conflicts, coalesce(completions, 0) AS completions, coalesce(failed_sessions, 0) AS failed_sessions, opened_position FROM decided FULL JOIN logged USING (stream_id)""",
)
def conflict_statistics(spark, folder):
    """Requests decided in a batch beside what the log says of their streams."""
    requests, heads = _requests(spark, folder)
    decided = append.decide_appends(requests, heads)
    ledger = stored.loan_ledger(spark, folder)
    failed = F.when(F.col("event_type") == "HumanReviewRequested", F.lit("AgentSessionFailed")).otherwise(F.col("event_type"))
    own = ledger.select(F.concat(F.lit("q-"), F.get_json_object("payload", "$.application_id")).alias("stream_id"), F.col("global_position").alias("stream_position"), failed.alias("event_type"))
    found = append.conflict_statistics(decided, own, opening="ApplicationSubmitted")
    return found.select("stream_id", "accepted", "conflicts", "completions", "failed_sessions", "opened_position")


@query(
    "completion_offsets",
    f"""WITH {LOAN}, n AS (SELECT stream_id, t, row_number() OVER (PARTITION BY stream_id ORDER BY gpos) AS pos FROM led),
    o AS (SELECT stream_id, min(pos) AS p FROM n WHERE t = 'ApplicationSubmitted' GROUP BY 1)
    SELECT n.stream_id, pos AS stream_position, pos - p AS offset_from_open FROM n JOIN o USING (stream_id) WHERE t = 'DecisionGenerated'""",
)
def completion_offsets(spark, folder):
    return append.completion_offsets(stored.loan_ledger(spark, folder), "ApplicationSubmitted", "DecisionGenerated")


def _outbox(spark, folder):
    ledger = stored.loan_ledger(spark, folder)
    routes = F.when(F.col("event_type") == "DecisionGenerated", F.array(F.lit("audit"), F.lit("mail"))).when(F.col("event_type").startswith("Application"), F.array(F.lit("audit")))
    return append.outbox_rows(ledger, routes, F.col("recorded_at"))


OUTBOX = f"""{LOAN}, ob AS (
  SELECT eid, gpos, ts, 'audit' AS destination, stream_id, t FROM led WHERE t = 'DecisionGenerated' OR t LIKE 'Application%'
  UNION ALL SELECT eid, gpos, ts, 'mail', stream_id, t FROM led WHERE t = 'DecisionGenerated')
"""


@query("outbox_rows", f"WITH {OUTBOX} SELECT eid || '/' || destination AS id, eid AS event_id, destination, epoch_us(ts) AS created_at, stream_id, t AS event_type, 0 AS attempts FROM ob")
def outbox_rows(spark, folder):
    o = _outbox(spark, folder)
    return o.select("id", "event_id", "destination", micros("created_at"), F.get_json_object("payload", "$.stream_id").alias("stream_id"),
                    F.get_json_object("payload", "$.event_type").alias("event_type"), "attempts")


@query("outbox_pending", f"WITH {OUTBOX} SELECT eid || '/' || destination AS id, epoch_us(ts) AS created_at FROM ob WHERE destination = 'audit' ORDER BY ts, gpos LIMIT 50")
def outbox_pending(spark, folder):
    return append.outbox_pending(_outbox(spark, folder), "audit", 50).select("id", micros("created_at"))


@query(
    "outbox_published",
    f"""WITH {OUTBOX}, first AS (SELECT eid, destination FROM ob ORDER BY ts, gpos, destination LIMIT 200)
    SELECT ob.eid || '/' || ob.destination AS id, first.eid IS NOT NULL AS published, CASE WHEN first.eid IS NULL THEN 0 ELSE 1 END AS attempts
    FROM ob LEFT JOIN first ON first.eid = ob.eid AND first.destination = ob.destination""",
)
def outbox_published(spark, folder):
    after, _, _ = append.publish_pending(_outbox(spark, folder), lambda batch: None, F.lit("2024-03-01").cast("timestamp"), limit=200)
    return after.select("id", F.col("published_at").isNotNull().alias("published"), "attempts")


@query(
    "outbox_statistics",
    f"""WITH {OUTBOX} SELECT count(*) AS pending, epoch_us(min(ts)) AS oldest_pending_at, 0 AS max_attempts,
      CAST(floor((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(min(ts))) / 60000000.0 + 0.5) AS BIGINT) AS oldest_pending_age_minutes FROM ob""",
)
def outbox_statistics(spark, folder):
    s = append.outbox_statistics(_outbox(spark, folder), F.lit("2024-03-01").cast("timestamp"))
    return s.select("pending", micros("oldest_pending_at"), "max_attempts", "oldest_pending_age_minutes")


@query("outbox_by_destination", f"WITH {OUTBOX} SELECT destination, count(*) AS pending FROM ob GROUP BY 1")
def outbox_by_destination(spark, folder):
    return append.outbox_by_destination(_outbox(spark, folder))


# Required fields that the adapter never fills, per event type; the conditional ones are added below.
VALID = f"""{LOAN}, need(t, n) AS (VALUES ('ApplicationSubmitted', 3), ('DocumentUploadRequested', 3), ('DocumentUploaded', 8), ('CreditAnalysisRequested', 2),
  ('FraudScreeningRequested', 2), ('ComplianceCheckRequested', 4), ('DecisionRequested', 3), ('DecisionGenerated', 2), ('HumanReviewRequested', 3), ('HumanReviewCompleted', 1),
  ('ApplicationApproved', 4), ('ApplicationDeclined', 3), ('PackageReadyForAnalysis', 5), ('AgentSessionStarted', 2), ('AgentSessionCompleted', 7), ('CreditAnalysisCompleted', 3),
  ('ComplianceCheckCompleted', 6), ('FraudScreeningCompleted', 6)),
v AS (SELECT led.*, n + CASE WHEN led.t = 'ApplicationSubmitted' THEN CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 40 = 0 THEN 1 ELSE 0 END
    WHEN led.t = 'DecisionGenerated' AND k % 25 = 0 THEN 1 WHEN led.t = 'ApplicationApproved' AND k % 16 = 3 THEN 1
    WHEN led.t = 'CreditAnalysisCompleted' AND k % 8 = 0 THEN 1 WHEN led.t = 'FraudScreeningCompleted' AND k % 20 = 1 THEN 1 ELSE 0 END AS problems
  FROM led LEFT JOIN need ON need.t = led.t)
"""


@query("event_validation", f"WITH {VALID} SELECT eid AS event_id, t AS event_type, problems FROM v")
def event_validation(spark, folder):
    v = evolution.validate_events(stored.loan_ledger(spark, folder))
    return v.select("event_id", "event_type", F.size("problems").alias("problems"))


@query(
    "validation_report",
    f"""WITH {LOAN} SELECT 'all' AS scope, NULL AS key, count(*) AS events, count(*) AS errors FROM led
    UNION ALL SELECT 'event_type', t, count(*), count(*) FROM led GROUP BY 2 UNION ALL SELECT 'family', split_part(stream_id, '-', 1), count(*), count(*) FROM led GROUP BY 2""",
)
def validation_report(spark, folder):
    return evolution.validation_report(evolution.validate_events(stored.loan_ledger(spark, folder)))


@query(
    "malformed_events",
    f"""WITH {LOAN} SELECT eid AS event_id, stream_id, t AS event_type, gpos AS global_position,
      CASE WHEN t = 'ApplicationSubmitted' AND k % 12 = 0 THEN 'applicant_id' WHEN t = 'ApplicationSubmitted' THEN 'application_reference' WHEN t = 'DecisionGenerated' THEN 'recommendation' ELSE 'approved_amount_usd' END AS field
    FROM led WHERE (t = 'ApplicationSubmitted' AND (k % 12 = 0 OR k % 40 = 0)) OR (t = 'DecisionGenerated' AND k % 25 = 0) OR (t = 'ApplicationApproved' AND k % 16 = 3)""",
)
def malformed_events(spark, folder):
    return evolution.malformed_events(stored.loan_ledger(spark, folder))


@query(
    "upgraded_credit_events",
    f"""WITH {LOAN}, s AS (SELECT *, ts + to_days(CAST(k * 10 AS INTEGER)) AS att FROM led WHERE t = 'CreditAnalysisCompleted')
    SELECT eid AS event_id, 2 AS event_version,
      CASE WHEN k % 8 <> 0 THEN 'm' || (k % 2) WHEN att < TIMESTAMP '2026-01-01' THEN 'credit-v0-legacy' WHEN att < TIMESTAMP '2026-03-01' THEN 'credit-v1' ELSE 'credit-v2' END AS model_version,
      CASE WHEN k % 8 <> 0 THEN NULL WHEN att < TIMESTAMP '2026-01-01' THEN 'APEX-CREDIT-POLICY-2025.4' WHEN att < TIMESTAMP '2026-03-01' THEN 'APEX-CREDIT-POLICY-2026.1' ELSE 'APEX-CREDIT-POLICY-2026.2' END AS first_rule,
      CAST(NULL AS VARCHAR) AS upgrade_error
    FROM s""",
)
def upgraded_credit_events(spark, folder):
    """Credit analyses spread over three years, read at version 2."""
    k = F.get_json_object("payload", "$.analysis_duration_ms").cast("int") - 100
    shifted = stored.loan_ledger(spark, folder).where("event_type = 'CreditAnalysisCompleted'")
    shifted = shifted.withColumn("recorded_at", F.col("recorded_at") + F.make_dt_interval(k * 10))
    done = evolution.upgrade_events(shifted, [evolution.credit_upgrade()])
    return done.select("event_id", "event_version", F.get_json_object("payload", "$.model_version").alias("model_version"),
                       F.get_json_object("payload", "$.regulatory_basis[0]").alias("first_rule"), "upgrade_error")


@query(
    "upgraded_decisions",
    f"""WITH {LOAN}, an AS (SELECT stream_id, arg_min('m' || (k % 2), gpos) AS m FROM led WHERE t = 'AgentSessionStarted' GROUP BY 1),
    d AS (SELECT eid, app FROM led WHERE t = 'DecisionGenerated' AND k % 8 = 0)
    SELECT eid AS event_id, 2 AS event_version, a.m AS credit_model, b.m AS fraud_model
    FROM d LEFT JOIN an a ON a.stream_id = 'agent-credit_analysis-s' || app || '-0' LEFT JOIN an b ON b.stream_id = 'agent-fraud_detection-s' || app || '-1'
    """,
)
def upgraded_decisions(spark, folder):
    ledger = stored.loan_ledger(spark, folder)
    old = ledger.where("event_type = 'DecisionGenerated' and event_version = 1")
    done = evolution.upgrade_events(old, [evolution.decision_upgrade()], log=ledger)
    models = "$.model_versions."
    return done.select("event_id", "event_version", F.get_json_object("payload", models + "credit_analysis").alias("credit_model"),
                       F.get_json_object("payload", models + "fraud_detection").alias("fraud_model"))
