"""Append-only digests of ordered sequences: a range of complete hash trees (a Merkle mountain range).

Level 0 has the digests of the items; node i of level j hashes the ``fan_in`` nodes from i * fan_in of the level below and
exists once these do. Nodes never change when items are added, so later digests need only the peaks, the nodes that no
complete node stands above (at most ``fan_in`` - 1 per level), and the new items. The digest of n items hashes n and its peaks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from foldstone.session import stage


class Range(NamedTuple):
    """Shape of a range; it is part of the digest's definition. ``fan_in ** levels`` items share one highest node."""

    fan_in: int = 64
    levels: int = 6


RANGE = Range()


def leaves(items: DataFrame, keys: Sequence[str], ordinal: str, digest: str) -> DataFrame:
    """Nodes of level 0: keys, level, idx, digest."""
    return items.select(*keys, F.lit(0).alias("level"), (F.col(ordinal) - 1).alias("idx"), F.col(digest).alias("digest"))


def grown(fresh: DataFrame, known: DataFrame | None, keys: Sequence[str], shape: Range = RANGE) -> DataFrame:
    """All nodes that come into being with ``fresh`` nodes of level 0, these included; ``known`` has the peaks so far."""
    new, out = fresh, [fresh]
    for level in range(shape.levels):
        below = new if known is None else new.unionByName(known.where(F.col("level") == level).select(*new.columns))
        members = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda m: m["digest"])
        made = below.groupBy(*keys, F.floor(F.col("idx") / shape.fan_in).alias("up")).agg(F.count("*").alias("n"), F.sha2(F.concat(F.lit("node:"), F.array_join(members, "")), 256).alias("digest"))
        new = made.where(F.col("n") == shape.fan_in).select(*keys, F.lit(level + 1).alias("level"), F.col("up").alias("idx"), "digest")
        out.append(new)
    return reduce(DataFrame.unionByName, out)


def is_peak(count: Column, shape: Range = RANGE) -> Column:
    """Whether the node (level, idx) is a peak of ``count`` items."""
    width = F.pow(F.lit(float(shape.fan_in)), F.col("level")).cast("bigint")
    inside = F.col("idx") < F.floor(count / width)
    return inside & ((F.col("level") == shape.levels) | (F.col("idx") >= F.floor(count / (width * shape.fan_in)) * shape.fan_in))


def peaks(nodes: DataFrame, counts: DataFrame, keys: Sequence[str], count: str, shape: Range = RANGE) -> DataFrame:
    """The peaks of the first ``count`` items of each key."""
    return nodes.join(counts.select(*keys, F.col(count).alias("_count")), [*keys]).where(is_peak(F.col("_count"), shape)).drop("_count")


def roots(peak_nodes: DataFrame, counts: DataFrame, keys: Sequence[str], count: str, name: str) -> DataFrame:
    """keys, ``count`` and the digest of so many items, from their peaks."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("l"), "idx", "digest")))
    joined = peak_nodes.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda p: p["digest"]), "").alias("_peaks"))
    root = F.sha2(F.concat(F.lit("root:"), F.col(count).cast("string"), F.lit(":"), F.coalesce("_peaks", F.lit(""))), 256)
    return counts.select(*keys, count).join(joined, [*keys], "left").select(*keys, count, root.alias(name))


def differing(known: DataFrame, recomputed: DataFrame, keys: Sequence[str], shape: Range = RANGE) -> DataFrame:
    """Items (keys, idx, digest, found) whose known digest is not the recomputed one (``found`` null: there is no such item).

    Both tables have all nodes. Level by level from the top, only nodes without a node above and those below one that differs
    are compared, so what agrees is settled near the top.
    """
    by, wrong = [*keys, "idx"], None
    for level in range(shape.levels, -1, -1):
        here = known.where(F.col("level") == level).withColumn("_up", F.floor(F.col("idx") / shape.fan_in))
        if wrong is not None:
            above = known.where(F.col("level") == level + 1).select(*keys, F.col("idx").alias("_up"))
            here = here.join(above, [*keys, "_up"], "left_anti").unionByName(here.join(wrong.select(*keys, F.col("idx").alias("_up")), [*keys, "_up"], "left_semi"))
        found = recomputed.where(F.col("level") == level).select(*by, F.col("digest").alias("found"))
        wrong = stage(here.join(found, by, "left").where(~F.col("digest").eqNullSafe(F.col("found"))).select(*by, "digest", "found"))
    return wrong
