"""Reading and writing the event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldstone.functions import ids
from foldstone.operators.scan import number_rows
from foldstone.schema import LEDGER_COLUMNS, LEDGER_DDL

_LINE = "event_id string, stream_id string, event_type string, event_version int, payload string, metadata string, recorded_at string"


def read_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One event per line; blank lines are skipped; positions follow file order (files by name).

    A line's place is its file, the split it was read from and its order in that split, so numbering needs no single
    ordered pass: lines are counted per split and the counts carried forward.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), "value"
    ).where(F.trim("value") != "")
    e = F.from_json("value", _LINE)
    rows = lines.select("_file", "_start", "_row", e.alias("e"))
    place = F.concat_ws("#", "_file", F.lpad(F.col("_start").cast("string"), 20, "0"))
    ordered = number_rows(rows.withColumn("_place", place), [], "_place", "global_position", ties=["_row"], block=F.col("_place"))
    parsed = ordered.select(
        F.coalesce("e.event_id", F.concat(F.lit("seed-"), F.col("global_position").cast("string"))).alias("event_id"), "e.stream_id", "global_position",
        "e.event_type", F.coalesce("e.event_version", F.lit(1)).alias("event_version"), F.coalesce("e.payload", F.lit("{}")).alias("payload"),
        F.coalesce("e.metadata", F.lit("{}")).alias("metadata"), F.col("e.recorded_at").cast("timestamp").alias("recorded_at"),
    )
    return number_rows(parsed, ["stream_id"], "global_position", "stream_position").select(*LEDGER_COLUMNS)


def write_ledger(ledger: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by stream family, clustered by position inside it."""
    laid_out = ledger.withColumn("stream_family", ids.stream_family()).repartitionByRange("stream_family", "global_position")
    laid_out.sortWithinPartitions("stream_family", "global_position").write.mode(mode).partitionBy("stream_family").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_DDL + ", stream_family string").parquet(path)


def _in_family(ledger: DataFrame, family: str) -> DataFrame:
    if "stream_family" in ledger.columns:
        return ledger.where(F.col("stream_family") == family)
    return ledger.where(F.col("stream_id").startswith(family + "-"))


def log_after(ledger: DataFrame, position: int) -> DataFrame:
    """Events after a global position; the filter reaches the Parquet row groups."""
    return ledger.where(F.col("global_position") > position)


def stream_events(
    ledger: DataFrame, stream_id: str | None = None, family: str | None = None, from_position: int | None = None, to_position: int | None = None
) -> DataFrame:
    """Events of one stream (or of all streams of a family) between two positions, both included."""
    rows = ledger
    if stream_id is not None:
        rows = _in_family(rows, stream_id.split("-", 1)[0]).where(F.col("stream_id") == stream_id)
    elif family is not None:
        rows = _in_family(rows, family)
    if from_position is not None:
        rows = rows.where(F.col("stream_position") >= from_position)
    if to_position is not None:
        rows = rows.where(F.col("stream_position") <= to_position)
    return rows.orderBy("stream_position") if stream_id is not None else rows


def events_by_id(ledger: DataFrame, wanted: DataFrame | Sequence[str]) -> DataFrame:
    """Point lookups: a few ids as a pushed filter, many ids as a semi join."""
    if isinstance(wanted, DataFrame):
        return ledger.join(wanted.select("event_id").distinct(), "event_id", "left_semi")
    return ledger.where(F.col("event_id").isin(*wanted))
