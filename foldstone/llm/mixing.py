"""Mixing sources to target weights (operator 3): hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstone.llm.native import whole_text, word_count
from foldstone.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
# Rows of one source are ordered in ranges of about this many, each in one task.
RANGE_ROWS = 20_000
KEY_DIGITS = 8


def hash_key(seed: str = SEED) -> Column:
    """Random but repeatable order: the digest of seed and doc_id, as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets for sources given as (source, source_size, n_rows).

    Sources in code point order, null last, take the weights in turn and share ``share`` times all words; none gets more
    than ``most`` times its size, the excess going to the others by weight. Sorted by cap / weight the capped sources come
    first, so the level is found with prefix sums. The table has one row per source.
    """
    turn = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")), "weight", F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = weighed.withColumn("level", left.cast("double") / weight_left)
    fits = leveled.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    level = F.first("fits", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = fits.withColumn("found", level)
    target = F.when(F.col("found").isNull() | (F.col("found") * F.col("weight") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("found") * F.col("weight"))
    return found.select("source", "source_size", "n_rows", target.alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    The size of a document is its number of words. Each source's documents are put in hash-random order; whole epochs are
    taken while the target allows, and of the last epoch the documents up to the exact budget, so the words taken of a
    source are its target rounded to a word (the document at the cut gives only the words up to it). Null text has size 0,
    null sources form a source of their own that comes last, repeated rows count apart, rows with equal keys are ordered
    by id and size, an empty table gives an empty result, and other columns are ignored.
    """
    rows = stage(documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count(whole_text()).alias("size"), hash_key(seed).alias("key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = stage(source_targets(sizes, weights, share, most))
    # Keys are uniform, so ranges of equal width hold about equally many rows of a source, however large it is.
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / range_rows)).cast("long")
    part = F.floor(F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("double") / float(16**KEY_DIGITS) * ranges).cast("long")
    same = F.col("r.source").eqNullSafe(F.col("t.source"))
    placed = rows.alias("r").join(targets.alias("t"), same).select("r.doc_id", "r.source", "r.size", "r.key", "t.source_size", "t.target", part.alias("part"))
    inside = Window.partitionBy("source", "part").orderBy("key", F.col("doc_id").isNull(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = stage(placed.withColumn("upto", F.sum("size").over(inside)))
    sums = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    at = F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.part") == F.col("o.part"))
    before = F.col("p.upto") - F.col("p.size") + F.col("o.offset")
    budget = F.round("p.target").cast("long")
    epochs = F.when(F.col("p.source_size") > 0, F.floor(budget / F.col("p.source_size"))).otherwise(0).cast("long")
    rest = F.least(F.col("p.size"), F.greatest(F.lit(0), budget - epochs * F.col("p.source_size") - before))
    return placed.alias("p").join(offsets.alias("o"), at).select("p.doc_id", "p.source", "p.size", "p.source_size", "p.target", (epochs * F.col("p.size") + rest).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The documents that the mix takes words of, all columns and texts whole, with mix_size, mix_target and mix_taken.

    Each document is one row, however often it is taken: mix_taken words, in whole epochs and the rest of one, are for readers
    to apply, as the rows alone don't have the target weights. Documents are joined with their decision by id; rows without an id, or that repeat one, share the decision of the row
    that takes most; columns of those names are replaced.
    """
    taken = mix(documents, weights, share, most, seed).where("taken > 0").groupBy(F.col("doc_id").alias("__id"))
    taken = stage(taken.agg(F.max("size").alias("mix_size"), F.max("target").alias("mix_target"), F.max("taken").alias("mix_taken")))
    return documents.drop("mix_size", "mix_target", "mix_taken").join(taken, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")
