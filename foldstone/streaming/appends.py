"""Streaming appends through expected-version checks, and streaming publication of the outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from foldstone.operators import append
from foldstone.session import stage

REQUEST_DDL = f"request_id string, request_order bigint, stream_id string, expected_version bigint, events {append.EVENTS_DDL}, causation_id string, metadata string"
HEAD_DDL = "stream_id string, current_version bigint, global_position bigint, archived_at timestamp"
OUTBOX_DDL = "id string, event_id string, global_position bigint, destination string, payload string, created_at timestamp, published_at timestamp, attempts int"


def append_stream(
    spark: SparkSession, requests_path: str, root: str, destinations: Callable[[DataFrame], Column] | None = None, continuous: str | None = None
) -> StreamingQuery:
    """Decide and append request files as they arrive; one writer per ledger root.

    Each micro-batch writes its events, decisions and outbox rows under its own batch folder. A repeated batch sees only
    earlier folders and replaces its own, so positions come out the same.
    """
    stream = spark.readStream.schema(REQUEST_DDL).json(requests_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        asked = stage(batch)
        earlier = _earlier(spark, f"{root}/heads", batch_id)
        heads = earlier.groupBy("stream_id").agg(F.max("current_version").alias("current_version"), F.max("archived_at").alias("archived_at"))
        last = earlier.agg(F.coalesce(F.max("global_position"), F.lit(0))).first()[0]
        decided = stage(append.decide_appends(asked, heads))
        events = append.accepted_events(asked, decided, last)
        events.write.mode("overwrite").parquet(f"{root}/events/batch={batch_id}")
        decided.write.mode("overwrite").parquet(f"{root}/decisions/batch={batch_id}")
        written = spark.read.parquet(f"{root}/events/batch={batch_id}")
        moved = written.groupBy("stream_id").agg(
            F.max("stream_position").alias("current_version"), F.max("global_position").alias("global_position"), F.lit(None).cast("timestamp").alias("archived_at")
        )
        moved.write.mode("overwrite").parquet(f"{root}/heads/batch={batch_id}")
        if destinations is not None:
            append.outbox_rows(written, destinations(written), F.col("recorded_at")).write.mode("overwrite").parquet(f"{root}/outbox/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/checkpoint")
    return writer.trigger(**({"processingTime": continuous} if continuous else {"availableNow": True})).start()


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Head rows left by earlier batches: one per stream that a batch moved, never the log itself."""
    if batch_id == 0:
        return spark.createDataFrame([], HEAD_DDL)
    rows = spark.read.schema(HEAD_DDL + ", batch bigint").parquet(path)
    return rows.where(F.col("batch") < batch_id).drop("batch")


def publish_stream(spark: SparkSession, outbox_path: str, out_path: str, checkpoint: str, destination: str | None = None, callback: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Publish outbox rows as JSON lines (exactly once by the file sink's log), or hand each batch to ``callback``."""
    rows = spark.readStream.schema(OUTBOX_DDL).parquet(outbox_path).where("published_at is null")
    if destination is not None:
        rows = rows.where(F.col("destination") == destination)
    if callback is not None:
        writer = rows.writeStream.foreachBatch(callback)
    else:
        writer = rows.writeStream.format("json").option("path", out_path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
