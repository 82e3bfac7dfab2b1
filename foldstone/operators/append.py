"""Batch append with expected versions, stream heads, archiving and the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.functions import ids, payload as P
from foldstone.operators.closure import reachable
from foldstone.operators.scan import asof, before, number_rows, running
from foldstone.schema import LEDGER_COLUMNS
from foldstone.session import stage

# Fixed values of a conflict row.
CONFLICT = "OptimisticConcurrencyError"
RETRY = "reload_stream_and_retry"
EVENTS_DDL = "array<struct<event_id:string,event_type:string,event_version:int,payload:string,metadata:string,recorded_at:timestamp>>"


def stream_heads(ledger: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """Version, aggregate type, creation and archive time per stream (``archive``: stream_id, archived_at)."""
    heads = ledger.groupBy("stream_id").agg(F.max("stream_position").alias("current_version"), F.min("recorded_at").alias("created_at"), F.count("*").alias("events"))
    heads = heads.withColumn("aggregate_type", ids.aggregate_type())
    if archive is None:
        return heads.withColumn("archived_at", F.lit(None).cast("timestamp"))
    return heads.join(archive.select("stream_id", "archived_at"), "stream_id", "left")


def stream_versions(heads: DataFrame, requested: DataFrame) -> DataFrame:
    """Version of each requested stream, -1 where it does not exist."""
    return requested.select("stream_id").distinct().join(heads, "stream_id", "left").withColumn("current_version", F.coalesce("current_version", F.lit(-1)))


def archive_streams(archive: DataFrame, requested: DataFrame, at: Column) -> DataFrame:
    """Archive table after a request; a stream archived before keeps its first time."""
    asked = requested.select("stream_id").distinct().withColumn("_now", at)
    return archive.join(asked, "stream_id", "full").select("stream_id", F.coalesce("archived_at", "_now").alias("archived_at"))


def decide_appends(requests: DataFrame, heads: DataFrame) -> DataFrame:
    """Accept or reject each request of a batch.

    ``requests``: request_id string, request_order bigint, stream_id, expected_version, events array. A request is
    accepted when its expectation equals the head left by the accepted requests before it. Seen as a chain, each
    request names the first later request that expects the version it would leave; the accepted ones are those reached
    from the first request that fits the stored head, so a stream with very many requests needs no single task.
    """
    sized = requests.select("request_id", "request_order", "stream_id", "expected_version", F.size("events").alias("_n"))
    # Only heads of requested streams take part; the small side travels.
    heads = heads.join(requests.select("stream_id").distinct(), "stream_id", "left_semi")
    known = heads.select("stream_id", F.col("current_version").alias("_head"), F.col("archived_at").isNotNull().alias("_archived"))
    rows = sized.join(known, "stream_id", "left").select(
        *sized.columns, F.coalesce("_head", F.lit(-1)).cast("bigint").alias("_head"), F.coalesce("_archived", F.lit(False)).alias("_archived"),
        (F.greatest("expected_version", F.lit(0)) + F.col("_n")).cast("bigint").alias("_leaves"), (-F.col("request_order")).alias("_back"),
    )
    rows = stage(rows)
    live = rows.where("_n > 0 and not _archived")
    ahead = live.select("stream_id", F.col("expected_version").cast("bigint").alias("_version"), "_back", F.col("request_id").alias("next"))
    looking = live.select("stream_id", F.col("_leaves").alias("_version"), "_back", "request_id")
    links = asof(looking, ahead, ["stream_id", "_version"], "_back", "next").where("next is not null")
    first = live.where("expected_version = _head").groupBy("stream_id").agg(F.min_by("request_id", "request_order").alias("id"))
    accepted = reachable(links.select(F.col("next").alias("child"), F.col("request_id").alias("parent")), first.select("id"))
    marked = rows.join(accepted.select(F.col("id").alias("request_id"), F.lit(True).alias("_ok")), "request_id", "left")
    marked = stage(marked.withColumn("_after", F.when(F.col("_ok"), F.col("_leaves"))))
    seen = running(marked, ["stream_id"], "request_order", {"_before": before(F.col("_after"))})
    actual = F.coalesce("_before", "_head")
    status = (
        F.when(F.col("_n") == 0, "empty").when(F.col("_ok"), "accepted")
        .when(F.col("_archived") & (F.col("expected_version") == actual), "archived").otherwise("conflict")
    )
    conflict = status == "conflict"
    return seen.select(
        "request_id", "request_order", "stream_id", status.alias("status"), "expected_version", actual.alias("actual_version"),
        F.when(conflict, F.lit(CONFLICT)).when(status == "archived", F.lit("DomainError")).alias("error_type"),
        F.when(conflict, F.lit(RETRY)).alias("suggested_action"),
        F.when(F.col("_ok"), F.greatest(actual, F.lit(0)) + 1).alias("first_position"),
        F.when(F.col("_ok"), F.col("_after")).alias("last_position"),
    )


def accepted_events(requests: DataFrame, decisions: DataFrame, last_global_position: int) -> DataFrame:
    """Ledger rows of the accepted requests, numbered per stream and globally in request order.

    Optional request columns ``causation_id`` and ``metadata`` (JSON) apply to every event of the request.
    """
    ok = decisions.where("status = 'accepted'").select("request_id", "first_position")
    spread = requests.join(ok, "request_id").select("*", F.posexplode("events").alias("_i", "_e"))
    shared = P.without_fields(F.col("metadata"), "stream_metadata", "outbox_destinations") if "metadata" in requests.columns else F.lit("{}")
    cause = F.col("causation_id") if "causation_id" in requests.columns else F.lit(None).cast("string")
    # An absent id is derived from the place in the log, so a repeated task writes the same one.
    place = F.md5(F.concat_ws(":", "stream_id", (F.col("first_position") + F.col("_i")).cast("string")))
    rows = spread.select(
        "request_order", "_i", F.coalesce("_e.event_id", place).alias("event_id"), "stream_id", (F.col("first_position") + F.col("_i")).alias("stream_position"),
        F.col("_e.event_type").alias("event_type"), F.coalesce("_e.event_version", F.lit(1)).alias("event_version"),
        F.coalesce("_e.payload", F.lit("{}")).alias("payload"), merged_metadata(shared, F.col("_e.metadata"), cause).alias("metadata"),
        F.coalesce("_e.recorded_at", F.current_timestamp()).alias("recorded_at"),
    )
    ordered = number_rows(rows, [], "request_order", "_g", ties=["_i"])
    return ordered.withColumn("global_position", F.col("_g") + last_global_position).select(*LEDGER_COLUMNS)


def merged_metadata(shared: Column, own: Column, causation_id: Column) -> Column:
    """Request metadata under event metadata; the cause is added only where neither names one."""
    default = F.when(causation_id.isNotNull(), F.to_json(F.struct(causation_id.alias("causation_id"))))
    return P.merged(P.merged(default, shared), own)


def check_log(ledger: DataFrame) -> DataFrame:
    """Constraint violations: duplicate event ids, duplicate positions, gaps and global order that does not rise."""
    duplicate_ids = ledger.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit("duplicate_event_id").alias("problem"), F.col("event_id").alias("subject"), F.col("n").cast("bigint").alias("detail")
    )
    per_position = ledger.groupBy("stream_id", "stream_position").agg(F.count("*").alias("n"), F.max("global_position").alias("global_position"))
    duplicate_positions = per_position.where("n > 1").select(
        F.lit("duplicate_position"), F.concat_ws(":", "stream_id", F.col("stream_position").cast("string")), F.col("n")
    )
    linked = running(stage(per_position), ["stream_id"], "stream_position", {
        "_prev": before(F.col("stream_position")), "_prev_global": before(F.col("global_position")),
    })
    subject = F.concat_ws(":", "stream_id", F.col("stream_position").cast("string"))
    gaps = linked.where("stream_position <> coalesce(_prev, 0) + 1").select(F.lit("gap"), subject, F.col("stream_position") - F.coalesce("_prev", F.lit(0)) - 1)
    order = linked.where("global_position <= _prev_global").select(F.lit("global_order"), subject, F.col("global_position"))
    return duplicate_ids.union(duplicate_positions).union(gaps).union(order)


def conflict_statistics(decisions: DataFrame, ledger: DataFrame, opening: str = "CreditRecordOpened", completion: str = "CreditAnalysisCompleted") -> DataFrame:
    """Per stream: completions, conflicts of the batch, failed sessions and the position of the opening event."""
    t = F.col("event_type")
    logged = ledger.groupBy("stream_id").agg(
        F.count_if(t == completion).alias("completions"), F.count_if(t == "AgentSessionFailed").alias("failed_sessions"),
        F.min(F.when(t == opening, F.col("stream_position"))).alias("opened_position"),
    )
    decided = decisions.groupBy("stream_id").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "conflict").alias("conflicts"))
    return logged.join(decided, "stream_id", "full").fillna(0, ["completions", "failed_sessions", "accepted", "conflicts"])


def completion_offsets(ledger: DataFrame, opening: str = "CreditRecordOpened", completion: str = "CreditAnalysisCompleted") -> DataFrame:
    """Distance of every completion from the opening event of its stream."""
    opened = ledger.where(F.col("event_type") == opening).groupBy("stream_id").agg(F.min("stream_position").alias("opened_position"))
    done = ledger.where(F.col("event_type") == completion).select("stream_id", "stream_position")
    return done.join(opened, "stream_id").select("stream_id", "stream_position", (F.col("stream_position") - F.col("opened_position")).alias("offset_from_open"))


def outbox_rows(events: DataFrame, destinations: Column, created_at: Column) -> DataFrame:
    """One outbox row per event and destination, with the envelope as payload."""
    envelope = F.to_json(F.struct(
        "stream_id", "stream_position", "event_type", "event_version",
        F.parse_json("payload").alias("payload"), F.parse_json(F.coalesce("metadata", F.lit("{}"))).alias("metadata"),
    ))
    spread = events.select(
        "event_id", "global_position", F.explode(destinations).alias("destination"), envelope.alias("payload"), created_at.alias("created_at"),
    )
    return spread.select(
        F.concat_ws("/", "event_id", "destination").alias("id"), "event_id", "global_position", "destination", "payload", "created_at",
        F.lit(None).cast("timestamp").alias("published_at"), F.lit(0).alias("attempts"),
    )


def outbox_pending(outbox: DataFrame, destination: str | None = None, limit: int = 100) -> DataFrame:
    """Oldest unpublished rows, optionally of one destination."""
    waiting = outbox.where("published_at is null")
    if destination is not None:
        waiting = waiting.where(F.col("destination") == destination)
    return waiting.orderBy("created_at", "global_position", "destination").limit(limit)


def mark_published(outbox: DataFrame, published: DataFrame, at: Column) -> DataFrame:
    """Outbox after publication: listed ids get a time and one more attempt."""
    done = published.select("id", F.lit(True).alias("_done"))
    hit = F.coalesce("_done", F.lit(False))
    return outbox.join(done, "id", "left").select(
        *[F.when(hit, at).otherwise(F.col(c)).alias(c) if c == "published_at" else (F.col(c) + hit.cast("int")).alias(c) if c == "attempts" else F.col(c) for c in outbox.columns]
    )


def publish_pending(outbox: DataFrame, sink, at: Column, destination: str | None = None, limit: int = 100) -> tuple[DataFrame, int, int]:
    """Send the pending rows to ``sink(df)``; returns the outbox after it, rows published and rows still pending (up to limit)."""
    batch = stage(outbox_pending(outbox, destination, limit))
    sink(batch)
    after = stage(mark_published(outbox, batch, at))
    return after, batch.count(), outbox_pending(after, destination, limit).count()


def outbox_statistics(outbox: DataFrame, now: Column) -> DataFrame:
    """Pending rows, oldest pending time, highest attempts and age in whole minutes."""
    waiting = F.col("published_at").isNull()
    stats = outbox.agg(
        F.count_if(waiting).alias("pending"), F.min(F.when(waiting, F.col("created_at"))).alias("oldest_pending_at"), F.max(F.when(waiting, F.col("attempts"))).alias("max_attempts")
    )
    age = (F.unix_micros(now) - F.unix_micros("oldest_pending_at")) / F.lit(60_000_000.0)
    return stats.withColumn("oldest_pending_age_minutes", F.greatest(F.lit(0), F.floor(age + 0.5)))


def outbox_by_destination(outbox: DataFrame) -> DataFrame:
    return outbox.where("published_at is null").groupBy("destination").agg(F.count("*").alias("pending")).orderBy(F.desc("pending"), "destination")
