"""Column expressions and joins that the DataFrame-only operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A filter has at most this many blocks of 64 bits, so what is broadcast never exceeds 2^20 rows of two longs. With more
# keys than the bits can tell apart it lets more rows pass; the exact step behind it stays right.
FILTER_BLOCKS = 1 << 20


def whole_text(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of characters outside ``[\\x20\\x09-\\x0D]``."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _block(key: Column, blocks: int) -> Column:
    return key.bitwiseAND(F.lit(blocks - 1))


def _mask(key: Column) -> Column:
    """Four of 64 bits, taken from the upper half of a 64-bit hash."""
    bit = [F.shiftright(key, s).bitwiseAND(F.lit(63)).cast("int") for s in (28, 36, 44, 52)]
    one = [F.expr("1L")] * 4
    masks = [F.call_function("shiftleft", o, b) for o, b in zip(one, bit)]
    return masks[0].bitwiseOR(masks[1]).bitwiseOR(masks[2]).bitwiseOR(masks[3])


def blocked_filter(keys: DataFrame, key: str, blocks: int = FILTER_BLOCKS) -> DataFrame:
    """Blocked Bloom filter of a column of 64-bit hashes: one row (block, bits) for each block that is not empty."""
    hashed = keys.select(_block(F.col(key), blocks).alias("__block"), _mask(F.col(key)).alias("__mask"))
    return hashed.groupBy("__block").agg(F.bit_or("__mask").alias("__bits"))


def repeated_filter(keys: DataFrame, key: str, blocks: int = FILTER_BLOCKS) -> DataFrame:
    """Blocked Bloom filter of the hashes that may occur more than once.

    First pass: (block, bits) of every hash are counted, combined before the shuffle. Second pass: only those that met
    twice set their bits. A hash that is repeated always passes; one that is not seldom does.
    """
    hashed = keys.select(_block(F.col(key), blocks).alias("__block"), _mask(F.col(key)).alias("__mask"))
    met = hashed.groupBy("__block", "__mask").count().where("count > 1")
    return met.groupBy("__block").agg(F.bit_or("__mask").alias("__bits"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores behind them as no column of the table has yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _probed(df: DataFrame, key: Column, bits: DataFrame, blocks: int, how: str) -> tuple[DataFrame, Column, list[str]]:
    """The rows with the bits of their key's block, whether all bits of the key are set there, and the names added."""
    probe, at, block, found = added = unused(df, "__probe", "__at", "__block", "__bits")
    mask = _mask(F.col(probe))
    hit = F.col(found).bitwiseAND(mask) == mask
    on = F.col(at) == F.col(block)
    joined = df.withColumn(probe, key).withColumn(at, _block(F.col(probe), blocks))
    joined = joined.join(F.broadcast(bits.select(F.col("__block").alias(block), F.col("__bits").alias(found))), on if how == "left" else on & hit, how)
    return joined, hit, added


def with_hits(df: DataFrame, key: Column, bits: DataFrame, name: str, blocks: int = FILTER_BLOCKS) -> DataFrame:
    """Adds a boolean: may the key be in the filter? No row moves; the filter is broadcast, its size being bounded."""
    joined, hit, added = _probed(df, key, bits, blocks, "left")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop(*added)


def possible_hits(df: DataFrame, key: Column, bits: DataFrame, blocks: int = FILTER_BLOCKS) -> DataFrame:
    """Only the rows whose key may be in the filter."""
    joined, _, added = _probed(df, key, bits, blocks, "inner")
    return joined.drop(*added)
