"""Exact deduplication (operator 1): two passes of Bloom filtering, then only possibly repeated rows are grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.native import SPACES, repeated_filter, unused, whole_text, with_hits
from foldstone.session import stage


def _digest():
    return F.sha2(F.regexp_replace(whole_text(), SPACES, " "), 256)


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space became one space; a null text counts as
    empty, and empty texts form a group. The row with the smallest doc_id stays (null ids come last); of rows that repeat
    both text and doc_id each has ``kept`` set, as they are the same document. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = stage(documents.select("doc_id", _digest().alias("text_sha256")))
    bits = repeated_filter(rows.select(F.xxhash64("text_sha256").alias("h")), "h")
    flagged = with_hits(rows, F.xxhash64("text_sha256"), bits, "__maybe")
    maybe = stage(flagged.where("__maybe").select("doc_id", "text_sha256"))
    groups = stage(maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    result = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    grouped = maybe.join(groups, "text_sha256").select(result)
    alone = flagged.where("NOT __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return grouped.unionByName(alone)


def keep_first(documents: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts.

    Rows whose hash cannot be repeated pass straight through. Of the others every task first keeps one row for each text,
    so a group of any size shuffles at most one row per task. The smallest doc_id stays, null ids come last, and the text decides
    among rows of one doc_id.
    """
    digest, maybe, row = unused(documents, "__digest", "__maybe", "__row")
    digested = documents.withColumn(digest, _digest())
    keys = stage(digested.select(F.xxhash64(digest).alias("h")))
    flagged = with_hits(digested, F.xxhash64(digest), repeated_filter(keys, "h"), maybe)
    columns = documents.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"))
    first = flagged.where(F.col(maybe)).groupBy(digest).agg(F.min_by(whole, order).alias(row))
    return first.select(f"{row}.*").unionByName(flagged.where(~F.col(maybe)).select(*[f"`{c}`" for c in columns]))
