"""Queries that go through files and streams: log files, outbox files, followed read models, streamed appends."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from foldstone.operators import branches, lineage, views
from foldstone.operators.model import AGENT_PERFORMANCE, APPLICATION_SUMMARY, COMPLIANCE_AUDIT, READ_MODELS
from foldstone.plans import compliance as compliance_plans, log as log_plans, readmodels
from foldstone.plans.ctes import LOAN, SUMMARY_TYPES
from foldstone.plans.lineage import OUTCOMES
from foldstone.plans.registry import SQL, query
from foldstone.session import shared_folder, stage
from foldstone.sources import ledger as ledger_source, stored
from foldstone.sources.files import write_outbox_jsonl
from foldstone.streaming import appends, follow, state


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "jsonl_log",
    f"""WITH {LOAN} SELECT eid AS event_id, row_number() OVER (ORDER BY gpos) AS global_position, row_number() OVER (PARTITION BY stream_id ORDER BY gpos) AS stream_position, t AS event_type, epoch_us(ts) AS recorded_at FROM led""",
)
def jsonl_log(spark, folder):
    """The log written as JSON lines in order and read back with positions taken from the files."""
    path = _fresh(spark, "jsonl")
    rows = stored.loan_ledger(spark, folder).select(
        "global_position", F.to_json(F.struct("event_id", "stream_id", "event_type", "event_version", F.parse_json("payload").alias("payload"), F.parse_json("metadata").alias("metadata"),
                                              F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("recorded_at"))).alias("value"))
    rows.orderBy("global_position").select("value").write.text(path)
    back = ledger_source.read_jsonl(spark, path)
    return back.select("event_id", "global_position", "stream_position", "event_type", F.unix_micros("recorded_at").alias("recorded_at"))


@query("partitioned_log_families", f"WITH {LOAN} SELECT split_part(stream_id, '-', 1) AS stream_family, count(*) AS events, max(gpos) AS last_position FROM led WHERE stream_id LIKE 'credit-%' OR stream_id LIKE 'fraud-%' GROUP BY 1")
def partitioned_log_families(spark, folder):
    """Two families read from a log partitioned by family; the other partitions are not opened."""
    path = _fresh(spark, "families")
    ledger_source.write_ledger(stored.loan_ledger(spark, folder), path)
    rows = ledger_source.read_ledger(spark, path).where(F.col("stream_family").isin("credit", "fraud"))
    return rows.groupBy("stream_family").agg(F.count("*").alias("events"), F.max("global_position").alias("last_position"))


@query("events_by_id", f"WITH {LOAN}, c AS (SELECT DISTINCT 'e' || (gpos - k) AS eid FROM led WHERE k > 0) SELECT led.eid AS event_id, stream_id, t AS event_type FROM led JOIN c ON c.eid = led.eid")
def events_by_id(spark, folder):
    """Point lookups of every event that is named as a cause."""
    ledger = stored.loan_ledger(spark, folder)
    wanted = ledger.select(F.get_json_object("metadata", "$.causation_id").alias("event_id")).where("event_id is not null")
    return ledger_source.events_by_id(ledger, wanted).select("event_id", "stream_id", "event_type")


@query("application_events", f"WITH {LOAN} SELECT app AS application_id, count(*) AS events, count(DISTINCT stream_id) AS streams FROM led GROUP BY 1")
def application_events(spark, folder):
    rows = lineage.application_events(stored.loan_ledger(spark, folder))
    return rows.groupBy("application_id").agg(F.count("*").alias("events"), F.count_distinct("stream_id").alias("streams"))


@query("outbox_sink", f"WITH {log_plans.OUTBOX} SELECT eid || '/' || destination AS id, destination, t AS event_type FROM ob")
def outbox_sink(spark, folder):
    """Outbox rows written as JSON lines and read back."""
    path = _fresh(spark, "outbox")
    write_outbox_jsonl(log_plans._outbox(spark, folder), path)
    back = spark.read.schema(appends.OUTBOX_DDL).json(path)
    return back.select("id", "destination", F.get_json_object("payload", "$.event_type").alias("event_type"))


@query("outbox_stream", f"WITH {log_plans.OUTBOX} SELECT eid || '/mail' AS id, t AS event_type FROM ob WHERE destination = 'mail'")
def outbox_stream(spark, folder):
    source, out = _fresh(spark, "outbox"), _fresh(spark, "published")
    log_plans._outbox(spark, folder).write.parquet(source)
    appends.publish_stream(spark, source, out, _fresh(spark, "cp"), "mail").awaitTermination()
    return spark.read.schema(appends.OUTBOX_DDL).json(out).select("id", F.get_json_object("payload", "$.event_type").alias("event_type"))


def _dealt(ledger, parts=4):
    """The log in parts that have nothing to do with the order of its events."""
    deal = F.pmod(F.xxhash64("event_id"), F.lit(parts))
    return [ledger.where(deal == k) for k in range(parts)]


def _followed(spark, model, parts):
    log, root = _fresh(spark, "log"), _fresh(spark, "models")
    for part in parts:
        follow.write_log(part, log)
        follow.follow(spark, log, model, root).awaitTermination()
    return root, follow.current_rows(spark, model, root)


@query("followed_summary", SQL["application_summary"])
def followed_summary(spark, folder):
    """The log arrives in four shuffled parts; the followed model equals a rebuild in all columns."""
    _, rows = _followed(spark, APPLICATION_SUMMARY, _dealt(stored.loan_ledger(spark, folder)))
    return readmodels.summary_columns(rows)


@query("followed_compliance", SQL["compliance_history"])
def followed_compliance(spark, folder):
    _, rows = _followed(spark, COMPLIANCE_AUDIT, _dealt(stored.rule_ledger(spark, folder)))
    return compliance_plans._flat(rows)


@query("followed_agents", SQL["agent_performance"])
def followed_agents(spark, folder):
    _, rows = _followed(spark, AGENT_PERFORMANCE, _dealt(stored.loan_ledger(spark, folder)))
    return readmodels.agent_columns(rows)


@query(
    "quarantined_events",
    f"""WITH {LOAN}, m(model, types) AS (VALUES ('application_summary', [{SUMMARY_TYPES.strip("()")}]),
      ('agent_performance', ['AgentSessionStarted','CreditAnalysisCompleted','FraudScreeningCompleted','ComplianceCheckCompleted','DecisionGenerated','HumanReviewCompleted']),
      ('compliance_audit', ['ComplianceCheckInitiated','ComplianceRulePassed','ComplianceRuleFailed','ComplianceRuleNoted','ComplianceCheckCompleted']))
    SELECT model, eid AS event_id, t AS event_type, gpos AS global_position, 'payload is no JSON' AS error, 2 AS attempts FROM led JOIN m ON list_contains(types, t) WHERE gpos % 10 = 7""",
)
def quarantined_events(spark, folder):
    """Events whose payload was cut short; each model tries those it handles twice and goes on without them."""
    ledger = stored.loan_ledger(spark, folder)
    cut = ledger.withColumn("payload", F.when(F.col("global_position") % 10 == 7, F.lit('{"cut')).otherwise(F.col("payload")))
    log, root, out = _fresh(spark, "log"), _fresh(spark, "models"), []
    follow.write_log(cut, log)
    for model in (APPLICATION_SUMMARY, AGENT_PERFORMANCE, COMPLIANCE_AUDIT):
        strict = replace(model, problem=lambda events: F.when(F.try_parse_json("payload").isNull(), F.lit("payload is no JSON")))
        follow.follow(spark, log, strict, root, max_attempts=2).awaitTermination()
        out.append(follow.quarantined(spark, strict, root).select(F.lit(model.name).alias("model"), "event_id", "event_type", "global_position", "error", "attempts"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "followed_health",
    """WITH half AS (SELECT max(event_id) AS p1, max(ts) AS t1 FROM events WHERE ts < TIMESTAMP '2024-01-16'), top AS (SELECT max(event_id) AS p, max(ts) AS t FROM events)
    SELECT m.name AS projection_name, p - p1 AS lag_positions, (epoch_us(t) - epoch_us(t1)) // 1000 AS lag_ms FROM half, top, (VALUES ('application_summary'), ('agent_performance'), ('compliance_audit')) m(name)""",
)
def followed_health(spark, folder):
    """How far followers of the first half of the log are behind the whole log, by what they report of themselves."""
    ledger = stored.loan_ledger(spark, folder)
    log, root, running = _fresh(spark, "log"), _fresh(spark, "models"), []
    follow.write_log(ledger.where(F.col("recorded_at") < F.lit("2024-01-16").cast("timestamp")), log)
    for model in READ_MODELS:
        running.append(follow.follow(spark, log, model, root))
        running[-1].awaitTermination()
    points = follow.freshness(running).groupBy("projection_name").agg(F.max("last_position").alias("last_position"), F.max("updated_at").alias("updated_at"))
    return views.read_model_lag(points, ledger).select("projection_name", "lag_positions", "lag_ms")


@query("stateful_summary", SQL["application_summary"])
def stateful_summary(spark, folder):
    """The same fold kept in streaming state, one application per state entry; files arrive in shuffled order."""
    out = _fresh(spark, "stateful")
    source = _fresh(spark, "log")
    ledger = stored.loan_ledger(spark, folder)
    parts = _dealt(ledger)
    for part in parts:
        part.write.mode("append").parquet(source)
    # A part is written side by side into as many files as its tasks, and a trigger takes as many.
    files = parts[0].rdd.getNumPartitions()
    stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", max(files, 1)).parquet(source)
    writer = state.stateful_summary(stream).writeStream.outputMode("update").option("checkpointLocation", _fresh(spark, "cp")).trigger(availableNow=True)
    writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start().awaitTermination()
    rows = spark.read.parquet(out)
    latest = rows.groupBy("application_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "application_id"]), "batch").alias("s"))
    return readmodels.summary_columns(latest.select("application_id", "s.*"))


@query(
    "streamed_appends",
    f"""WITH RECURSIVE {log_plans.APPENDS} SELECT 'r' || event_id AS request_id, CASE WHEN u % 10 = 0 THEN 'conflict' ELSE status END AS status,
      CASE WHEN status = 'accepted' AND u % 10 <> 0 THEN head END AS last_position FROM run WHERE rn > 0""",
)
def streamed_appends(spark, folder):
    """Requests arriving as files against an empty log; writers that expect an older log conflict throughout."""
    requests, _ = log_plans._requests(spark, folder)
    inbox, root = _fresh(spark, "inbox"), _fresh(spark, "appended")
    requests.write.json(inbox)
    appends.append_stream(spark, inbox, root).awaitTermination()
    return spark.read.parquet(f"{root}/decisions").select("request_id", "status", "last_position")


@query(
    "branch_agent_rows",
    f"""WITH RECURSIVE {OUTCOMES},
    st AS (SELECT branch, app, sess, gpos, akind, 'agent-' || (k % 7) AS a, 'm' || (k % 2) AS m FROM tl WHERE t = 'AgentSessionStarted'),
    oo AS (SELECT s.branch, s.app, s.akind, s.a, s.m, o.t FROM (SELECT * FROM tl WHERE eid NOT LIKE 'i%' AND t IN ('CreditAnalysisCompleted','FraudScreeningCompleted','ComplianceCheckCompleted','DecisionGenerated')) o
      ASOF JOIN st s ON o.branch = s.branch AND o.app = s.app AND o.sess = s.sess AND o.gpos > s.gpos),
    u AS (SELECT branch, app, akind, a, m, 'start' AS what FROM st UNION ALL SELECT * FROM oo)
    SELECT branch, app AS scope, akind AS agent_type, a AS agent_id, m AS model_version, count(*) FILTER (WHERE what = 'start') AS total_sessions,
      count(*) FILTER (WHERE what NOT IN ('start', 'DecisionGenerated')) AS analyses_completed, count(*) FILTER (WHERE what = 'DecisionGenerated') AS decisions_generated FROM u GROUP BY 1, 2, 3, 4, 5""",
)
def branch_agent_rows(spark, folder):
    """Agent rows of the real and counterfactual timelines of each application."""
    ledger = stored.linked_ledger(spark, folder)
    apps = ledger.select(F.get_json_object("payload", "$.application_id").alias("application_id")).distinct()
    injected = apps.select("application_id", F.lit(1).alias("seq"), F.lit("CreditAnalysisCompleted").alias("event_type"), F.lit(2).alias("event_version"), F.to_json(F.struct("application_id")).alias("payload"),
                           F.lit("2024-06-01").cast("timestamp").alias("recorded_at"))
    cut = branches.branch_timelines(ledger, "CreditAnalysisCompleted", injected)
    _, _, agents = branches.replay_branches(stage(cut.events))
    return agents.select("branch", "scope", "agent_type", "agent_id", "model_version", "total_sessions", "analyses_completed", "decisions_generated")


