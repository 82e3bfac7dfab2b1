"""Correlation chains, causal order, references and the set of events that depend on a branch event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import ids, payload as P
from foldstone.operators.closure import reached_in_order
from foldstone.operators.scan import number_rows
from foldstone.schema import STAGE_RANKS
from foldstone.session import stage

MISSING_TARGET = "causation target is missing from the related event set"
LATE_TARGET = "causation target appears at or after the dependent event in global order"
OTHER_CHAIN = "causation target belongs to a different correlation chain"
OUTPUT_TYPES = ("AgentOutputWritten", "AgentSessionCompleted")


def audited_events(ledger: DataFrame) -> DataFrame:
    """(application_id, event) for audits: named by the event, or by its package id with or without prefix."""
    app = P.filled(F.get_json_object("payload", "$.application_id"))
    package = F.get_json_object("payload", "$.package_id")
    owners = F.array_distinct(F.array_compact(F.array(app, ids.package_owner(package), package)))
    owners = F.when(app.isNotNull() & package.isNull(), F.array(app)).otherwise(owners)
    rows = ledger.where(~F.col("stream_id").startswith("audit-"))
    return rows.select(F.explode(owners).alias("application_id"), *ledger.columns)


def application_events(ledger: DataFrame, include_audit: bool = False) -> DataFrame:
    """(application_id, event) for branches and packages: named by the payload or by one of the five owned streams."""
    app = P.filled(F.get_json_object("payload", "$.application_id"))
    owner = ids.stream_owner()
    owners = [app, owner]
    if include_audit:
        owners.append(P.filled(F.regexp_extract("stream_id", "^audit-(?:loan|application)-(.*)$", 1)))
    rows = ledger.select(F.explode(F.array_distinct(F.array_compact(F.array(*owners)))).alias("application_id"), *ledger.columns)
    return rows if include_audit else rows.where(~F.col("stream_id").startswith("audit-") | app.isNotNull())


def correlation_chains(related: DataFrame) -> DataFrame:
    """Events of each correlation chain of an application, numbered in global order."""
    chained = related.withColumn("correlation_id", P.filled(F.get_json_object("metadata", "$.correlation_id"))).where("correlation_id is not null")
    rows = chained.select("application_id", "correlation_id", "event_id", "event_type", "stream_id", "stream_position", "global_position")
    return number_rows(stage(rows), ["application_id", "correlation_id"], "global_position", "link")


def causal_violations(related: DataFrame) -> DataFrame:
    """Events whose cause is absent, not earlier, or of another chain; one row per violation."""
    rows = stage(related.select(
        "application_id", "event_id", "stream_id", "event_type", "global_position",
        P.filled(F.get_json_object("metadata", "$.correlation_id")).alias("correlation_id"), P.filled(F.get_json_object("metadata", "$.causation_id")).alias("causation_id"),
    ))
    effects = rows.where("causation_id is not null")
    causes = rows.select("application_id", F.col("event_id").alias("causation_id"), F.col("global_position").alias("_pos"), F.col("correlation_id").alias("_chain"))
    causes = causes.groupBy("application_id", "causation_id").agg(F.max_by(F.struct("_pos", "_chain"), F.col("_pos")).alias("c"))
    joined = effects.join(causes, ["application_id", "causation_id"], "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("c").isNull(), F.lit(MISSING_TARGET)),
        F.when(F.col("c._pos") >= F.col("global_position"), F.lit(LATE_TARGET)),
        F.when(F.col("c._chain") != F.col("correlation_id"), F.lit(OTHER_CHAIN)),
    ))
    return joined.select(*effects.columns, F.explode(reasons).alias("reason"))


def resolved_references(references: DataFrame, ledger: DataFrame) -> DataFrame:
    """Whether each ``reference`` of the form stream:position points at an event."""
    pattern = r"^(.*):\s*([+-]?\d+)\s*$"
    parsed = references.withColumn("_stream", F.regexp_extract("reference", pattern, 1)).withColumn("_pos", F.regexp_extract("reference", pattern, 2).try_cast("bigint"))
    known = ledger.select(F.col("stream_id").alias("_stream"), F.col("stream_position").alias("_pos"), F.lit(True).alias("_hit"))
    return parsed.join(known, ["_stream", "_pos"], "left").select(*references.columns, F.coalesce("_hit", F.lit(False)).alias("resolvable"))


def written_provenance(writes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Event references for the positions a session wrote (session_id, stream_id, stream_position), one row each."""
    events = ledger.select("stream_id", "stream_position", "event_type")
    return writes.join(events, ["stream_id", "stream_position"]).select("session_id", "stream_id", "event_type", "stream_position")


def reference_tokens() -> Column:
    """What an event refers to: its cause, trigger, decision, recovered session and written events."""
    def told(name: str) -> Column:
        # Few events have the field. Only a text that holds its name, or an escape that may spell it, is parsed for it.
        return F.when(F.col("payload").contains(name) | F.col("payload").contains("\\"), F.get_json_object("payload", f"$.{name}"))

    def field(name: str) -> Column:
        return P.filled(told(name))

    written = F.from_json(told("events_written"), "array<struct<stream_id:string,stream_position:string>>")
    written = F.transform(written, lambda w: F.when(w["stream_id"].isNotNull() & w["stream_position"].isNotNull(), F.concat_ws(":", w["stream_id"], w["stream_position"])))
    named = F.array(P.filled(F.get_json_object("metadata", "$.causation_id")), field("triggered_by_event_id"), field("decision_event_id"), field("recovered_from_session_id"))
    return F.array_distinct(F.array_compact(F.concat(named, F.coalesce(written, F.array().cast("array<string>")))))


def identity_tokens() -> Column:
    """Names under which an event can be referred to."""
    return F.array(F.col("event_id"), F.concat_ws(":", "stream_id", F.col("stream_position").cast("string")))


def stage_rank(event_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STAGE_RANKS.items() for x in pair])[event_type]


def branch_points(related: DataFrame, branch_type: str) -> DataFrame:
    """First event of ``branch_type`` per application."""
    first = related.where(F.col("event_type") == branch_type).groupBy("application_id").agg(
        F.min_by(F.struct("event_id", "stream_id", "stream_position", "global_position", "event_type", "metadata"), F.col("global_position")).alias("branch")
    )
    return first.withColumn("branch_rank", F.coalesce(stage_rank(F.col("branch.event_type")), F.lit(0)))


def dependents(related: DataFrame, branches: DataFrame) -> DataFrame:
    """Events after the branch that fall with it: by reference (directly or through others), by later stage on the loan
    stream, or as later session outputs. References count only towards earlier events, so they form no cycles."""
    rows = related.join(branches.select("application_id", F.col("branch.global_position").alias("_at"), F.col("branch.event_id").alias("_branch"), "branch_rank"), "application_id")
    rows = rows.where("global_position >= _at")
    later = F.col("stream_id").startswith(F.concat(F.lit("loan-"), F.col("application_id"))) & (F.coalesce(stage_rank(F.col("event_type")), F.col("branch_rank")) > F.col("branch_rank"))
    output = F.col("event_type").isin(*OUTPUT_TYPES) & (F.get_json_object("payload", "$.application_id") == F.col("application_id"))
    is_branch = F.col("event_id") == F.col("_branch")
    node = F.concat_ws("\x01", "application_id", "event_id")
    rows = stage(rows.select(
        "application_id", "event_id", "event_type", "stream_id", "stream_position", "global_position", node.alias("id"),
        reference_tokens().alias("refs"), identity_tokens().alias("names"), is_branch.alias("is_branch"), (is_branch | F.coalesce(later | output, F.lit(False))).alias("seed"),
    ))
    referring = number_rows(rows.where("not is_branch and not seed and size(refs) > 0").select("application_id", "refs", "id", "global_position"), ["application_id"], "global_position", "place")
    children = referring.select("application_id", F.explode("refs").alias("token"), F.col("id").alias("child"), F.col("global_position").alias("_c"), "place")
    parents = rows.select("application_id", F.explode("names").alias("token"), F.col("id").alias("parent"), F.col("global_position").alias("_p"))
    edges = children.join(parents, ["application_id", "token"]).where("_p < _c").select(F.col("application_id").alias("key"), "place", "child", "parent")
    reached = reached_in_order(edges, rows.where("seed").select("id"))
    return rows.where("not is_branch").join(reached, "id", "left_semi").select("application_id", "event_id", "event_type", "stream_id", "stream_position", "global_position")
