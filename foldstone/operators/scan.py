"""Ordered per-key scans that stay bounded when one key holds a large part of the log.

A window over a whole stream puts that stream into one task. Here a key's rows are cut into blocks of consecutive
positions: a window runs inside each (key, block), one aggregated row per block travels to a second window that
produces the value carried into each block, and both are combined. Rows of a hot key therefore spread over many
tasks, and only block summaries meet in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldstone.session import block_rows

BLOCK = "_block"


@dataclass(frozen=True)
class Running:
    """A running value: ``last`` non-null, ``sum``, ``max`` or ``min`` of the rows up to (or before) each row."""

    kind: str
    value: Column
    inclusive: bool = True


def last(value: Column, inclusive: bool = True) -> Running:
    return Running("last", value, inclusive)


def before(value: Column) -> Running:
    return Running("last", value, False)


def total(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def highest(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def count_so_far(inclusive: bool = True) -> Running:
    return Running("sum", F.lit(1).cast("bigint"), inclusive)


def position_block(df: DataFrame, position: str) -> Column:
    return F.floor(F.col(position) / F.lit(block_rows(df.sparkSession)))


def running(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    outputs: Mapping[str, Running],
    ties: Sequence[str] = (),
    block: Column | None = None,
) -> DataFrame:
    """Add running values per key in order of ``position`` (then ``ties``). Keys must not be null."""
    order = [position, *ties]
    ordinal = F.struct(*order) if ties else F.col(position)
    staged = df.withColumn(BLOCK, block if block is not None else position_block(df, position))
    for name, spec in outputs.items():
        staged = staged.withColumn(f"_in_{name}", spec.value)

    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    local = staged
    for name, spec in outputs.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        local = local.withColumn(f"_local_{name}", _fold(spec.kind, F.col(f"_in_{name}")).over(frame))

    per_block = staged.groupBy(*keys, BLOCK).agg(
        *[_block_value(spec.kind, F.col(f"_in_{name}"), ordinal).alias(f"_blk_{name}") for name, spec in outputs.items()]
    )
    # Without keys this window sees one row per block of the whole input, never the rows themselves.
    across = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys, BLOCK, *[_fold(spec.kind, F.col(f"_blk_{name}")).over(across).alias(f"_carry_{name}") for name, spec in outputs.items()]
    )
    merged = local.join(carried, [*keys, BLOCK], "left")
    return merged.select(
        *df.columns,
        *[_combine(spec.kind, F.col(f"_carry_{name}"), F.col(f"_local_{name}")).alias(name) for name, spec in outputs.items()],
    )


def _fold(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _block_value(kind: str, value: Column, ordinal: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), ordinal))
    return _fold(kind, value)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carried)
    if kind == "sum":
        return F.coalesce(carried + local, carried, local, F.lit(0))
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def number_rows(df: DataFrame, keys: Sequence[str], position: str, name: str = "ordinal", ties: Sequence[str] = (), block: Column | None = None) -> DataFrame:
    """1-based row number per key."""
    return running(df, keys, position, {name: count_so_far()}, ties, block)


def listed(df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """Ordered lists as rows: per key every item with its 1-based ``ordinal``."""
    items = df.select(*keys, position, *ties, value.alias(name))
    return number_rows(items, keys, position, "ordinal", ties).select(*keys, "ordinal", name)


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], position: str, value: str, inclusive: bool = False,
    ties: Sequence[str] = (), block: Column | None = None,
) -> DataFrame:
    """Attach to each left row the ``value`` of the latest right row of its key placed before it (or at it).

    ``ties`` orders right rows of one position. No pairs are formed: both sides are merged in order and scanned once.
    """
    right_first = inclusive
    tied = [F.col(c).alias(f"_tie_{c}") for c in ties]
    blank = [F.lit(None).cast(right.schema[c].dataType).alias(f"_tie_{c}") for c in ties]
    tagged_right = right.select(
        *keys, position, F.lit(0 if right_first else 1).alias("_side"), *tied, F.lit(None).alias("_row"), F.col(value).alias("_val")
    )
    tagged_left = left.select(
        *keys, position, F.lit(1 if right_first else 0).alias("_side"), *blank, F.struct(*left.columns).alias("_row"), F.lit(None).alias("_val")
    )
    merged = running(
        tagged_left.unionByName(tagged_right), keys, position, {"_found": last(F.col("_val"))}, ["_side", *[f"_tie_{c}" for c in ties]], block
    )
    return merged.where(F.col("_row").isNotNull()).select("_row.*", F.col("_found").alias(value))
