"""Agent sessions: replayed records, context for recovery, recovery lineage, cards and guarded reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldstone.functions import payload as P
from foldstone.operators.scan import listed
from foldstone.schema import ANCHOR_TYPES

CONTEXT_FIELDS = ("session_id", "agent_type", "agent_id", "application_id", "model_version", "context_source")
MISSING_STREAM, MISSING_ANCHOR, OVER_BUDGET = "session_stream_missing", "missing_gas_town_anchor", "token_budget_exceeded"


def _agent_events(ledger: DataFrame) -> DataFrame:
    return P.with_fields(
        ledger.where(F.col("stream_id").startswith("agent-")),
        *CONTEXT_FIELDS, "context_token_count", "node_name", "node_sequence", "tool_name", "recovered_from_session_id", "total_cost_usd",
        "events_written array<struct<stream_id:string,event_type:string,stream_position:bigint>>",
    )


def _first_event():
    return F.struct("event_type", *[F.col(f"p.{c}").alias(c) for c in CONTEXT_FIELDS], F.col("p.context_token_count").try_cast("bigint").alias("context_token_count"))


def session_records(ledger: DataFrame) -> DataFrame:
    """Replayed session per stream; an anchor that is not the first event stops the replay (``error_position``)."""
    t, pos = F.col("event_type"), F.col("stream_position")

    def first_of(name: str):
        return F.min(F.when(t == name, pos))

    folded = _agent_events(ledger).groupBy("stream_id").agg(
        F.min_by(_first_event(), pos).alias("_first"),
        F.max(pos).alias("_last"),
        F.min(F.when(t.isin(*ANCHOR_TYPES) & (pos > 1), pos)).alias("error_position"),
        first_of("AgentSessionRecovered").alias("_recovered"),
        first_of("AgentSessionCompleted").alias("_completed"),
        first_of("AgentSessionFailed").alias("_failed"),
        F.sum(F.when(t == "AgentOutputWritten", F.coalesce(F.size("p.events_written"), F.lit(0)))).alias("_outputs"),
    )
    stop = F.coalesce("error_position", F.lit((1 << 62)))
    anchored = F.col("_first.event_type").isin(*ANCHOR_TYPES)
    return folded.select(
        "stream_id",
        F.least("_last", stop - 1).alias("version"),
        *[F.when(anchored, F.col(f"_first.{c}")).alias(c) for c in (*CONTEXT_FIELDS, "context_token_count")],
        anchored.alias("started"),
        *[F.coalesce(F.col(f"_{c}") < stop, F.lit(False)).alias(c) for c in ("recovered", "completed", "failed")],
        F.when(F.col("error_position").isNull(), F.coalesce("_outputs", F.lit(0))).alias("outputs_written"),
        "error_position",
    )


def session_contexts(ledger: DataFrame, requests: DataFrame, token_budget: int = 8000) -> DataFrame:
    """What a resumed session needs, per requested (agent_type, session_id); missing streams are reported as such."""
    t, pos = F.col("event_type"), F.col("stream_position")
    node = t == "AgentNodeExecuted"
    folded = _agent_events(ledger).groupBy("stream_id").agg(
        F.min_by(_first_event(), pos).alias("_first"),
        F.max_by("event_type", pos).alias("last_event_type"),
        F.max_by(F.col("p.node_name"), F.when(node, pos)).alias("last_successful_node"),
        F.max_by(F.coalesce(F.col("p.node_sequence").try_cast("bigint"), F.lit(0)), F.when(node, pos)).alias("_sequence"),
        F.count_if((t == "AgentToolCalled") & P.filled(F.col("p.tool_name")).isNotNull()).alias("tools_called"),
        F.sum(F.when(t == "AgentOutputWritten", F.coalesce(F.size("p.events_written"), F.lit(0))).otherwise(0)).alias("outputs_written"),
        *[F.bool_or(t == f"AgentSession{c.capitalize()}").alias(c) for c in ("completed", "failed", "recovered")],
    )
    asked = requests.withColumn("stream_id", F.concat_ws("-", F.lit("agent"), "agent_type", "session_id")).select(
        "stream_id", F.col("session_id").alias("requested_session_id")
    )
    joined = asked.join(folded, "stream_id", "left")
    anchored = F.coalesce(F.col("_first.event_type").isin(*ANCHOR_TYPES), F.lit(False))
    tokens = F.when(anchored, F.coalesce("_first.context_token_count", F.lit(0))).otherwise(F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(F.col("_first").isNull(), F.lit(MISSING_STREAM)).when(~anchored, F.lit(MISSING_ANCHOR)),
        F.when(tokens > token_budget, F.lit(OVER_BUDGET)),
    ))
    return joined.select(
        "stream_id", "requested_session_id",
        *[F.when(anchored, F.col(f"_first.{c}")).alias(c) for c in CONTEXT_FIELDS],
        tokens.alias("context_token_count"),
        F.greatest(F.lit(0), F.lit(token_budget) - tokens).alias("token_budget_remaining"),
        "last_event_type", "last_successful_node",
        (F.coalesce("_sequence", F.lit(0)) + 1).alias("next_node_sequence"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tools_called", "outputs_written")],
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("completed", "failed", "recovered")],
        (F.size(reasons) > 0).alias("needs_reconciliation"),
        reasons.alias("reconciliation_reasons"),
    )


def session_tools(ledger: DataFrame) -> DataFrame:
    """Tool names per session stream in call order, one row each."""
    calls = _agent_events(ledger).where("event_type = 'AgentToolCalled'").where(P.filled(F.col("p.tool_name")).isNotNull())
    return listed(calls, ["stream_id"], "stream_position", F.col("p.tool_name"), "tool")


def session_outputs(ledger: DataFrame) -> DataFrame:
    """Every event reference a session wrote, one row each, in order."""
    written = _agent_events(ledger).where("event_type = 'AgentOutputWritten'")
    return written.select("stream_id", "stream_position", F.posexplode("p.events_written").alias("item", "o")).select(
        "stream_id", "stream_position", "item", F.col("o.stream_id").alias("output_stream_id"),
        F.col("o.event_type").alias("output_event_type"), F.col("o.stream_position").alias("output_position"),
    )


def recovery_lineage(ledger: DataFrame) -> DataFrame:
    """Recovered session -> failed session, with the nodes that ran more than once across both."""
    events = _agent_events(ledger)
    links = events.where("event_type = 'AgentSessionRecovered'").select(
        F.col("p.session_id").alias("session_id"), F.col("p.recovered_from_session_id").alias("recovered_from")
    ).distinct()
    per_node = events.where("event_type = 'AgentNodeExecuted'").groupBy(F.col("p.session_id").alias("member"), F.col("p.node_name").alias("node_name")).agg(F.count("*").alias("runs"))
    members = links.select("*", F.explode(F.array_distinct(F.array("session_id", "recovered_from"))).alias("member"))
    both = members.join(per_node, "member").groupBy("session_id", "recovered_from", "node_name").agg(F.sum("runs").alias("runs"))
    repeated = both.groupBy("session_id", "recovered_from").agg(F.count_if(F.col("runs") > 1).alias("repeated_nodes"), F.sum("runs").alias("nodes_run"))
    return links.join(repeated, ["session_id", "recovered_from"], "left").select(
        "session_id", "recovered_from", F.coalesce("nodes_run", F.lit(0)).alias("nodes_run"), F.coalesce("repeated_nodes", F.lit(0)).alias("repeated_nodes"),
        (F.coalesce("repeated_nodes", F.lit(0)) == 0).alias("no_node_repeated"),
    )


def session_cards(ledger: DataFrame) -> DataFrame:
    """One card per session id: status, counts, outputs, cost, start and end."""
    events = _agent_events(ledger)
    t, pos = F.col("event_type"), F.col("global_position")
    sid = F.coalesce("p.session_id", F.split_part("stream_id", F.lit("-"), F.lit(-1)))
    started, ended = t == "AgentSessionStarted", t.isin("AgentSessionCompleted", "AgentSessionFailed")
    named = {c: F.col(f"p.{c}") for c in ("agent_type", "agent_id", "model_version")}
    cards = events.withColumn("session", sid).groupBy("session").agg(
        F.min_by("stream_id", pos).alias("stream_id"),
        *[F.min_by(v, pos).alias(f"_first_{c}") for c, v in named.items()],
        *[F.max_by(v, F.when(started & v.isNotNull(), pos)).alias(f"_named_{c}") for c, v in named.items()],
        F.max_by("recorded_at", F.when(started, pos)).alias("started_at"),
        F.max_by("recorded_at", F.when(ended, pos)).alias("completed_at"),
        F.max_by(F.when(t == "AgentSessionFailed", F.lit("failed")).otherwise(F.lit("completed")), F.when(ended, pos)).alias("_status"),
        F.count_if(t == "AgentNodeExecuted").alias("nodes_executed"),
        F.count_if(t == "AgentToolCalled").alias("tools_called"),
        F.sum(F.when(t == "AgentOutputWritten", F.coalesce(F.size("p.events_written"), F.lit(0))).otherwise(0)).alias("output_events"),
        F.max_by(F.col("p.total_cost_usd").try_cast("double"), F.when((t == "AgentSessionCompleted") & F.col("p.total_cost_usd").isNotNull(), pos)).alias("total_cost_usd"),
    )
    return cards.select(
        F.col("session").alias("session_id"), "stream_id",
        F.coalesce("_named_agent_type", "_first_agent_type", F.lit("unknown")).alias("agent_type"),
        F.coalesce("_named_agent_id", "_first_agent_id").alias("agent_id"),
        F.coalesce("_named_model_version", "_first_model_version").alias("model_version"),
        "started_at", "completed_at", F.coalesce("_status", F.lit("running")).alias("status"),
        "nodes_executed", "tools_called", "output_events", "total_cost_usd",
    )


def guarded_session_events(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """Events of requested (agent, session_id) streams, only where the first event carries that agent id or type."""
    events = _agent_events(ledger)
    streams = events.groupBy("stream_id").agg(
        F.min_by(F.struct(F.col("p.agent_id").alias("agent_id"), F.col("p.agent_type").alias("agent_type")), "stream_position").alias("_first")
    )
    ids = events.select("stream_id", F.col("p.session_id").alias("session_id")).where("session_id is not null").distinct()
    allowed = requests.join(ids, "session_id").join(streams, "stream_id").where("agent = _first.agent_id or agent = _first.agent_type")
    return events.drop("p").join(allowed.select("stream_id", "agent", "session_id").distinct(), "stream_id")
