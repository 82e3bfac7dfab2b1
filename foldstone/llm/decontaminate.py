"""Benchmark decontamination (operator 9): size-partitioned MinHash containment search, then exact containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.native import blocked_filter, possible_hits, unused, whole_text, with_hits
from foldstone.session import stage

WORDS = 5
CONTAINMENT = 0.8
BETWEEN = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def _split(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The given columns and the words, in a projection of their own: expressions over them must not split again."""
    return df.select(*columns, _words(whole_text()).alias("words"))


def _starts(words: Column, n: int) -> Column:
    return F.when(F.size(words) < n, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(words) - n))


def _hashes(words: Column, n: int) -> Column:
    return F.transform(_starts(words, n), lambda i: F.xxhash64(*[words[i + k] for k in range(n)]))


def _runs(words: Column, n: int) -> Column:
    return F.transform(_starts(words, n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def _of_item(words: Column, n: int, kind) -> Column:
    """Distinct shingles of an item; one of fewer words has its whole sequence as one."""
    short = F.array_distinct(kind(words, n))
    for fewer in range(n - 1, 0, -1):
        short = F.when(F.size(words) == fewer, kind(words, fewer)).otherwise(short)
    return short


def _of_document(words: Column, sizes: list[int], kind) -> Column:
    """Distinct runs of all sizes that shingles of items have."""
    return F.array_distinct(F.concat(*[kind(words, n) for n in sizes]))


def _sizes(items: DataFrame, words: int) -> list[int]:
    """The sizes of shingles that items have: ``words``, and those of shorter items. At most ``words`` numbers."""
    size = F.least(F.size("words"), F.lit(words))
    return sorted({words, *[r[0] for r in _split(items, "item_id").select(size.alias("n")).where("n > 0").distinct().collect()]})


def sketches(items: DataFrame, words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, h): the smallest shingle hashes of every item, as many as its size partition needs.

    Items are partitioned by size into (2^(c-1), 2^c]. A text that holds at least the share ``containment`` of an item of
    at most u = 2^c shingles lacks at most (1 - containment) * u of them, so one more of the smallest hashes must meet one
    of its own. The sketch of a long document is never needed, however small the item is beside it.
    """
    hashed = _split(items, "item_id").select("item_id", F.array_sort(_of_item(F.col("words"), words, _hashes)).alias("hs")).where(F.size("hs") > 0)
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("hs"))))
    sized = hashed.withColumn("k", F.floor(upper * F.lit(1 - containment) + F.lit(1e-9)).cast("int") + 1)
    return sized.select("item_id", F.explode(F.slice("hs", F.lit(1), F.col("k"))).alias("h"))


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, item_size, n_shared, containment) of every document that holds so much of an item.

    Shingles are runs of ``words`` words, lower-cased, punctuation and spacing aside; an item of fewer words has its whole
    sequence as one. Containment is the share of an item's distinct shingles that the document has. Null and empty
    texts and items, and items without an id, match nothing. Repeated items match apart, repeated documents give one row for
    each doc_id and item; empty tables give an empty result and other columns are ignored.
    """
    return _verified(documents.select("doc_id", "text"), items, words, containment)


def _verified(documents: DataFrame, items: DataFrame, words: int, containment: float) -> DataFrame:
    sizes = _sizes(items, words)
    sketch = stage(sketches(items, words, containment))
    key = F.xxhash64("doc_id", "text")
    met = _split(documents, key.alias("key")).select("key", F.explode(_of_document(F.col("words"), sizes, _hashes)).alias("h"))
    pairs = stage(possible_hits(met, F.col("h"), blocked_filter(sketch, "h")).join(sketch, "h").select("key", "item_id").distinct())
    near = possible_hits(documents.withColumn("key", key), F.col("key"), blocked_filter(pairs.select("key").distinct(), "key"))
    parts = _split(items, "item_id").select("item_id", _of_item(F.col("words"), words, _runs).alias("all"))
    parts = stage(parts.select("item_id", F.size("all").cast("long").alias("item_size"), F.explode("all").alias("shingle")))
    found = _split(near, "doc_id", "key").select("doc_id", "key", F.explode(_of_document(F.col("words"), sizes, _runs)).alias("shingle"))
    # Only what may be part of an item is joined, and by item and shingle, so a phrase that many items have stays a narrow key.
    found = possible_hits(found, F.xxhash64("shingle"), blocked_filter(parts.select(F.xxhash64("shingle").alias("h")), "h"))
    shared = found.join(pairs, "key").join(parts, ["item_id", "shingle"])
    counted = shared.groupBy("doc_id", "key", "item_id", "item_size").agg(F.countDistinct("shingle").alias("n_shared"))
    share = F.col("n_shared") / F.col("item_size")
    held = counted.where(share >= containment).select("doc_id", "item_id", "item_size", "n_shared", F.round(share, 6).alias("containment"))
    return held.groupBy("doc_id", "item_id", "item_size").agg(F.max("n_shared").alias("n_shared"), F.max("containment").alias("containment"))


def without_leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no item, all columns unchanged. Only rows whose id may be affected are moved."""
    flag, gone = unused(documents, "__maybe", "__held")
    held = stage(leaks(documents, items, words, containment).select("doc_id").distinct())
    flagged = with_hits(documents, F.xxhash64("doc_id"), blocked_filter(held.select(F.xxhash64("doc_id").alias("h")), "h"), flag)
    maybe = flagged.where(F.col(flag)).drop(flag)
    kept = maybe.join(held.withColumnRenamed("doc_id", gone), F.col("doc_id").eqNullSafe(F.col(gone)), "left_anti")
    return kept.unionByName(flagged.where(~F.col(flag)).drop(flag))
