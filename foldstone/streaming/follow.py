"""Read models kept current by Structured Streaming.

Each read model is its own query with its own checkpoint. A model that has parts is never folded over its history again: a
micro-batch adds its own parts, whose size goes with the batch, and now and then the parts of earlier batches are merged
into one. Parts merge in any order, so events may arrive late. A model without parts folds the keys a batch touches over
the events that it has been given so far. All that a batch writes lies in folders named by the batch, so a repeated batch
replaces itself.

A batch that fails is tried again, then halved by position until single events are left; those that still fail go to
quarantine, and the rest goes on.
"""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from py4j.protocol import Py4JJavaError

from foldstone.operators.model import ReadModel, application_key
from foldstone.schema import LEDGER_COLUMNS, LEDGER_DDL
from foldstone.session import stage

# Number of key buckets of a new log; a large log wants thousands. It is recorded with the log and never changes.
BUCKETS = 32
# Earlier batches whose parts are merged into one.
MERGE_EVERY = 8
_BUCKETED = LEDGER_DDL + ", key_bucket int"
QUARANTINE = "event_id string, event_type string, global_position bigint, error string, attempts int, batch_id bigint"
OBSERVED = "followed"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Folders ``name=number`` of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return [(n, int(n.split("=")[1])) for n in names if "=" in n]


def log_buckets(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int:
    """Number of buckets of a log; recorded when the log is new, read from there ever after."""
    record = f"{path}/_buckets"
    if not _exists(spark, record):
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.json(record)
    return spark.read.schema("buckets int").json(record).first()[0]


def write_log(events: DataFrame, path: str, model_key: Column | None = None, buckets: int = BUCKETS) -> None:
    """Append events to a log that is partitioned by a hash of their application."""
    key = model_key if model_key is not None else application_key(events)
    number = F.lit(log_buckets(events.sparkSession, path, buckets))
    bucketed = events.select(*LEDGER_COLUMNS, F.coalesce(F.pmod(F.xxhash64(key), number).cast("int"), F.lit(0)).alias("key_bucket"))
    bucketed.write.mode("append").partitionBy("key_bucket").parquet(path)


def follow(spark: SparkSession, log_path: str, model: ReadModel, root: str, max_attempts: int = 3, continuous: str | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    """Start following the log. Without ``continuous`` (a processing interval) the query stops when caught up."""
    reader = spark.readStream.schema(_BUCKETED)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    seen = [F.max("global_position").alias("position"), F.max_by("recorded_at", "global_position").alias("recorded_at"), F.count("*").alias("events")]
    stream = reader.parquet(log_path).observe(OBSERVED, *seen)

    def fold_batch(batch: DataFrame, batch_id: int) -> None:
        _fold_batch(model, root, max_attempts, batch, batch_id)

    writer = stream.writeStream.foreachBatch(fold_batch).option("checkpointLocation", f"{root}/{model.name}/checkpoint").queryName(f"{model.name}")
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


def _fold_batch(model: ReadModel, root: str, max_attempts: int, batch: DataFrame, batch_id: int) -> None:
    base = f"{root}/{model.name}"
    fresh = stage(batch)
    handled = model.handled(fresh)
    quarantine = handled.limit(0).select("event_id", "event_type", "global_position", F.lit("").alias("error"), F.lit(0).alias("attempts"))
    if model.problem is not None:
        handled, pending, attempts = _examined(model, handled, max_attempts)
        quarantine = pending.select("event_id", "event_type", "global_position", "error", F.lit(attempts).alias("attempts"))
    try:
        _write_batch(model, base, handled, batch_id)
    except (PySparkException, Py4JJavaError):
        bad = _poison(model, handled, max_attempts)
        schema = "global_position bigint, error string, attempts int"
        failing = stage(handled.sparkSession.createDataFrame(bad, schema))
        named = handled.select("event_id", "event_type", "global_position").join(failing, "global_position")
        quarantine = quarantine.unionByName(named.select(*quarantine.columns))
        # Written first: the optimizer may else move failing expressions below the join.
        handled = stage(handled.join(failing, "global_position", "left_anti").select(*handled.columns))
        _write_batch(model, base, handled, batch_id)
    quarantine.withColumn("batch_id", F.lit(batch_id).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{base}/quarantine/batch={batch_id}")
    progress = fresh.agg(
        (F.max("global_position") + 1).alias("last_position"), F.max_by("recorded_at", "global_position").alias("last_processed_at"), F.count("*").alias("events")
    ).select(F.lit(model.name).alias("projection_name"), "*", F.current_timestamp().alias("updated_at"))
    progress.write.mode("overwrite").parquet(f"{base}/progress/batch={batch_id}")


def _examined(model: ReadModel, events: DataFrame, max_attempts: int) -> tuple[DataFrame, DataFrame, int]:
    """Events without a problem, those that still have one, and how often these were examined."""
    looked_at = stage(events.withColumn("error", model.problem(events)))
    good, pending, attempts = looked_at.where("error is null").drop("error"), looked_at.where("error is not null"), 1
    while attempts < max_attempts and not pending.isEmpty():
        again = pending.drop("error")
        again = stage(again.withColumn("error", model.problem(again)))
        good, pending, attempts = good.unionByName(again.where("error is null").drop("error")), again.where("error is not null"), attempts + 1
    return good, pending, attempts


def _write_batch(model: ReadModel, base: str, events: DataFrame, batch_id: int) -> None:
    spark = events.sparkSession
    if model.parts is not None:
        for table, rows in model.parts.split(events).items():
            rows.write.mode("overwrite").parquet(f"{base}/parts/{table}/batch={batch_id}")
            if batch_id % MERGE_EVERY == MERGE_EVERY - 1:
                merged = model.parts.merge[table](_table(spark, base, table, batch_id))
                merged.write.mode("overwrite").parquet(f"{base}/parts/{table}/merged={batch_id}")
        return
    events.write.mode("overwrite").partitionBy("key_bucket").parquet(f"{base}/events/batch={batch_id}")
    given = spark.read.schema(_BUCKETED + ", batch bigint").parquet(f"{base}/events").where(F.col("batch") <= batch_id).drop("batch")
    if model.key is not None:
        touched = stage(events.select(model.key(events).alias("_key"), "key_bucket").where("_key is not null").distinct())
        # One small number per bucket of the log comes to the driver, so only those buckets are read.
        buckets = [r[0] for r in touched.select("key_bucket").distinct().collect()]
        given = given.where(F.col("key_bucket").isin(*buckets)).withColumn("_key", model.key(given))
        given = given.join(touched.select("_key").distinct(), "_key", "left_semi").drop("_key")
    model.fold(given.select(*LEDGER_COLUMNS)).write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")


def _poison(model: ReadModel, events: DataFrame, max_attempts: int) -> list[tuple[int, str, int]]:
    """(position, error, attempts) of the events that fail by themselves, found by halving ranges of positions."""
    def attempt(part: DataFrame) -> str | None:
        try:
            rows = model.parts.split(part).values() if model.parts is not None else [model.fold(part.select(*LEDGER_COLUMNS))]
            for table in rows:
                table.write.format("noop").mode("overwrite").save()
        except (PySparkException, Py4JJavaError) as error:
            return str(error).splitlines()[0][:500]
        return None

    low, high = events.agg(F.min("global_position"), F.max("global_position")).first()
    bad, ranges = [], [(low, high)] if low is not None else []
    while ranges:
        low, high = ranges.pop()
        part = events.where(F.col("global_position").between(low, high))
        error, attempts = attempt(part), 1
        if error is None:
            continue
        if low == high:
            while error is not None and attempts < max_attempts:
                error, attempts = attempt(part) or None, attempts + 1
            if error is not None:
                bad.append((low, error, attempts))
        else:
            middle = (low + high) // 2
            # Ranges shrink to the events they hold, so gaps between positions cost nothing.
            for first, last in ((low, middle), (middle + 1, high)):
                inside = events.where(F.col("global_position").between(first, last)).agg(F.min("global_position"), F.max("global_position")).first()
                if inside[0] is not None:
                    ranges.append((inside[0], inside[1]))
    return bad


def _table(spark: SparkSession, base: str, table: str, upto: int | None = None) -> DataFrame:
    """Rows of the latest merge and of the batches after it (of those up to a batch)."""
    folders = [(name, n) for name, n in _folders(spark, f"{base}/parts/{table}") if upto is None or n <= upto]
    merged = max((n for name, n in folders if name.startswith("merged=") and n != upto), default=-1)
    wanted = [f"{base}/parts/{table}/{name}" for name, n in folders if (name.startswith("merged=") and n == merged) or (name.startswith("batch=") and n > merged)]
    return spark.read.parquet(*wanted)


def current_rows(spark: SparkSession, model: ReadModel, root: str) -> DataFrame:
    """The rows of a followed model."""
    base = f"{root}/{model.name}"
    if model.parts is not None:
        return model.parts.finish({table: merge(_table(spark, base, table)) for table, merge in model.parts.merge.items()})
    rows = spark.read.parquet(f"{base}/rows").withColumnRenamed("batch", "_batch")
    keys = [model.key_name] if model.key is not None else []
    newest = rows.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return rows.join(newest, [*keys, "_batch"], "left_semi").drop("_batch")


def checkpoints(spark: SparkSession, models, root: str) -> DataFrame:
    """Next position and update time per followed model, for lag reports."""
    parts = [spark.read.parquet(f"{root}/{m.name}/progress").drop("batch") for m in models]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("projection_name").agg(F.max("last_position").alias("last_position"), F.max_by("updated_at", "last_position").alias("updated_at"))


def freshness(queries: list[StreamingQuery]) -> DataFrame:
    """What running (or ended) followers report of themselves: one row per micro-batch, from their recent progress."""
    rows = []
    for query in queries:
        for progress in query.recentProgress:
            report = json.loads(progress.json)
            seen = report.get("observedMetrics", {}).get(OBSERVED)
            if seen and seen.get("events"):
                rows.append((report["name"], report["batchId"], seen["position"] + 1, seen["recorded_at"], seen["events"], report["timestamp"], report["durationMs"].get("triggerExecution")))
    ddl = "projection_name string, batch_id bigint, last_position bigint, last_processed_at string, events bigint, updated_at string, took_ms bigint"
    out = SparkSession.getActiveSession().createDataFrame(rows, ddl)
    return out.withColumn("last_processed_at", F.to_timestamp("last_processed_at")).withColumn("updated_at", F.to_timestamp("updated_at"))


def quarantined(spark: SparkSession, model: ReadModel, root: str) -> DataFrame:
    return spark.read.schema(QUARANTINE + ", batch bigint").parquet(f"{root}/{model.name}/quarantine").drop("batch").dropDuplicates(["event_id"])
