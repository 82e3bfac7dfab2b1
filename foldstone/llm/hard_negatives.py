"""Hard-negative mining (operator 13): exact scores from products of residues in float32, then selection by windows.

Vectors are integers. For a few small primes their residues are multiplied as float32 matrices, which is exact as long as
the sums stay below 2^24; Chinese remaindering gives the signed score back. As many primes are used as the longest vector
needs. Anchors and rows are dealt into blocks, and every meeting of two blocks is one unit of work, so no task holds
all anchors or all rows and nothing is broadcast. Units report their best few rows for each anchor, windows choose among them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstone.session import stage

# The largest primes below 512; products of centred residues stay below 2^16, so DEPTH of them add up below 2^24.
PRIMES = (509, 503, 499, 491, 487, 479, 467)
DEPTH = 256
# Rows of a block, and scores that a unit computes at a time.
ANCHOR_BLOCK, ROW_BLOCK, CELLS = 16_384, 1_024, 1 << 20


def primes_for(bound: float) -> tuple[int, ...]:
    """So many primes that their product exceeds twice the largest absolute score, with a margin for rounding of ``bound``."""
    product = 1
    for count, prime in enumerate(PRIMES, 1):
        product *= prime
        if product > 2.001 * bound + 2:
            return PRIMES[:count]
    raise ValueError(f"scores of up to {bound:g} do not fit a long; use a smaller scale")


def centred(matrix: np.ndarray, prime: int) -> np.ndarray:
    """Residues between -(prime - 1) / 2 and (prime - 1) / 2."""
    rest = matrix % prime
    return np.where(rest > prime // 2, rest - prime, rest).astype(np.float32)


def residue_product(left: np.ndarray, right: np.ndarray, prime: int) -> np.ndarray:
    """left @ right.T modulo the prime, between 0 and prime - 1, from float32 products of at most DEPTH terms."""
    total = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, left.shape[1], DEPTH):
        part = left[:, k : k + DEPTH] @ right[:, k : k + DEPTH].T
        part -= np.rint(part / np.float32(prime)) * np.float32(prime)
        total += part
    return total.astype(np.int64) % prime


def remaindered(residues: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed numbers with these residues, by mixed radix digits: all steps stay below the product of the primes."""
    value, product = residues[0], primes[0]
    for rest, prime in zip(residues[1:], primes[1:]):
        digit = (rest - value % prime) * pow(product, -1, prime) % prime
        value, product = value + digit * product, product * prime
    return np.where(value > product // 2, value - product, value)


def scores(anchors: list[np.ndarray], rows: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Inner products of integer vectors, given as their residues for each prime."""
    return remaindered([residue_product(a, r, p) for a, r, p in zip(anchors, rows, primes)], primes)


def share_floor(x: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * x / 100) without overflow."""
    return x // 100 * percent + x % 100 * percent // 100


def matrix(table: pa.Table, width: int) -> np.ndarray:
    """The vectors of a table as rows; shorter ones end in zeros."""
    column = table.column("vector").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers, null as the largest, and which are null."""
    column = table.column("vec_id").combine_chunks()
    return column.fill_null(np.iinfo(np.int64).max).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)


def _tiles(anchors: pa.Table, rows: pa.Table, width: int, primes: tuple[int, ...]):
    """(first anchor, scores of some anchors with all rows)."""
    left, right = matrix(anchors, width), matrix(rows, width)
    row_residues = [centred(right, p) for p in primes]
    step = max(1, CELLS // max(1, len(right)))
    for begin in range(0, len(left), step):
        part = left[begin : begin + step]
        yield begin, scores([centred(part, p) for p in primes], row_residues, primes)


def _positives(width: int, primes: tuple[int, ...], count: int):
    def of(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if len(anchors) and len(rows):
            label, row_label = anchors["label"].to_numpy(), rows["label"].to_numpy()
            (own, _), (other, _) = ids(anchors), ids(rows)
            least = np.iinfo(np.int64).min
            for begin, score in _tiles(anchors, rows, width, primes):
                part = slice(begin, begin + len(score))
                allowed = (label[part, None] == row_label) & (own[part, None] != other)
                masked = np.where(allowed, score, least)
                if masked.shape[1] > count:  # ties with the last one stay until ids decide
                    last = np.partition(masked, masked.shape[1] - count, axis=1)[:, masked.shape[1] - count]
                    allowed &= masked >= last[:, None]
                a, r = np.nonzero(allowed)
                value = score[a, r]
                order = np.lexsort((other[r], -value, a))
                a, r, value = a[order], r[order], value[order]
                nth = np.arange(len(a)) - np.searchsorted(a, a)
                first = nth < count
                found.append((a[first] + begin, r[first], value[first]))
        return _found(anchors, rows, found)

    return of


def _negatives(width: int, primes: tuple[int, ...], count: int, low: int, high: int):
    def of(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found, which = [], []
        if len(anchors) and len(rows):
            label, row_label = anchors["label"].to_numpy(), rows["label"].to_numpy()
            (other, _), windows = ids(rows), anchors["positives"].combine_chunks()
            sizes = np.diff(windows.offsets.to_numpy())
            of_anchor = np.repeat(np.arange(len(anchors)), sizes)
            score_of = windows.flatten().to_numpy()
            rank = np.arange(len(of_anchor)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            begin_at, end_at = -share_floor(-score_of, low), share_floor(score_of, high)
            lowest, highest = np.full(len(anchors), np.iinfo(np.int64).max), np.full(len(anchors), np.iinfo(np.int64).min)
            np.minimum.at(lowest, of_anchor, begin_at)
            np.maximum.at(highest, of_anchor, end_at)
            for begin, score in _tiles(anchors, rows, width, primes):
                part = slice(begin, begin + len(score))
                a, r = np.nonzero((score >= lowest[part, None]) & (score <= highest[part, None]) & (label[part, None] != row_label))
                value = score[a, r]
                order = np.lexsort((other[r], -value, a))
                a, r, value = a[order], r[order], value[order]
                bounds = np.searchsorted(a, np.arange(len(score) + 1))
                # A window's rows lie side by side in the order of its anchor; the first few are taken.
                for w in np.flatnonzero((of_anchor >= begin) & (of_anchor < begin + len(score))).tolist():
                    first, last = bounds[of_anchor[w] - begin], bounds[of_anchor[w] - begin + 1]
                    falling = -value[first:last]
                    at = first + np.searchsorted(falling, -end_at[w])
                    stop = min(at + count, first + np.searchsorted(falling, -begin_at[w], side="right"))
                    if at < stop:
                        found.append((a[at:stop] + begin, r[at:stop], value[at:stop]))
                        which.append(np.full(stop - at, rank[w]))
        out = _found(anchors, rows, found)
        return out.append_column("positive", pa.array(np.concatenate(which) if which else np.zeros(0, np.int64), pa.int32()))

    return of


def _found(anchors: pa.Table, rows: pa.Table, found: list[tuple]) -> pa.Table:
    a, r, value = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return pa.table({"anchor": anchors["row"].take(pa.array(a, pa.int64())), "vec_id": rows["vec_id"].take(pa.array(r, pa.int64())), "score": pa.array(value, pa.int64())})


def _first(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= count)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for vectors with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def hard_negatives(
    vectors: DataFrame, anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK
) -> DataFrame:
    """For each anchor and each of its positives the hardest rows of other labels that don't score too high.

    ``vectors`` has vec_id, label and embedding; components become floor(scale * x), a score is the inner product of these
    whole numbers, higher scores come first, ties by smaller vec_id. ``anchor`` tells from the id which rows are anchors. An
    anchor's positives are its first ``positives`` rows of its label and another id; the negatives of a positive are
    the first ``negatives`` rows of another label whose score is between ``low`` and ``high`` percent of the
    positive's. Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label or vector or a null or non-finite component take no part. A row without an id is no anchor and
    comes last among ties. A shorter vector counts as if it ended in zeros. Repeated rows count apart, as anchors and as
    found rows. Vectors whose squared length exceeds 2^61 raise an error, as scores would not fit a long. An empty table
    gives an empty result, and other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where("label IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole_numbers(F.col("embedding"), scale).alias("vector"))
    rows = stage(rows.where("vector IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    squared = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    total, anchors_total, bound, width = rows.agg(F.count("*"), F.count_if(anchor(F.col("vec_id"))), F.max(squared), F.max(F.size("vector"))).first()
    primes, width = primes_for(bound or 0.0), width or 0
    anchor_blocks, row_blocks = -(-anchors_total // anchor_block) or 1, -(-total // row_block) or 1
    units = anchor_blocks * row_blocks
    tasks = min(units, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), units // 64 + 1))

    def dealt(df: DataFrame, own: int, others: int, unit: Callable[[Column, Column], Column]) -> DataFrame:
        """Every row goes to the units of its block with each block of the other side."""
        block = F.pmod(F.xxhash64("row"), F.lit(own))
        met = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return met.withColumn("unit", unit(block, F.col("other"))).drop("other").repartition(tasks, "unit").groupBy("unit")

    def met(anchors: DataFrame, function, schema: str) -> DataFrame:
        left = dealt(anchors, anchor_blocks, row_blocks, lambda block, other: block * row_blocks + other)
        right = dealt(rows, row_blocks, anchor_blocks, lambda block, other: other * row_blocks + block)
        return left.cogroup(right).applyInArrow(function, schema)

    anchors = rows.where(anchor(F.col("vec_id"))).select(*[F.col(c).alias(c) for c in rows.columns])
    found = met(anchors, _positives(width, primes, positives), "anchor long, vec_id long, score long")
    chosen = stage(_first(found, ["anchor"], positives).select("anchor", F.col("vec_id").alias("positive_id"), "score", "nth"))
    windows = chosen.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "score"))), lambda x: x["score"]).alias("positives"))
    found = met(anchors.join(windows, "row"), _negatives(width, primes, negatives, low, high), "anchor long, vec_id long, score long, positive int")
    best = _first(found, ["anchor", "positive"], negatives).select("anchor", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), (F.col("positive") + 1).alias("of"), F.col("nth").cast("int").alias("rank"))
    named = chosen.withColumnRenamed("score", "positive_score").join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    joined = best.join(named.withColumnRenamed("nth", "of"), ["anchor", "of"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
