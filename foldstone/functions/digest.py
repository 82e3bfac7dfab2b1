"""Canonical text and SHA-256 digests of events, ordered streams and chains."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType


class Tree(NamedTuple):
    """Shape of a sequence digest; it is part of the digest's definition. ``fan_in ** levels`` items are the most it holds."""

    fan_in: int = 4096
    levels: int = 4


TREE = Tree()


def canonical_json(text: Column) -> Column:
    """Keys sorted, no blanks; equal documents give equal text."""
    return F.to_json(F.parse_json(text))


def event_digest(df: DataFrame) -> Column:
    """Digest over all nine stored columns of an event as written (never the upgraded form)."""
    envelope = F.to_json(
        F.struct(
            "event_id",
            "event_type",
            "event_version",
            "global_position",
            canonical_json(F.col("metadata")).alias("metadata"),
            canonical_json(F.col("payload")).alias("payload"),
            F.unix_micros("recorded_at").alias("recorded_at"),
            "stream_id",
            "stream_position",
        )
    )
    return F.sha2(envelope, 256)


def _hashed(tag: str, binary: bool = False) -> Column:
    """Digest of a group: its tag and its members' digests in order, as text also where they came as bytes."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_d"))), lambda x: F.lower(F.hex(x["_d"])) if binary else x["_d"])
    return F.sha2(F.concat(F.lit(tag), F.array_join(members, "")), 256)


def _is_binary(df: DataFrame, digest: str) -> bool:
    return isinstance(df.schema[digest].dataType, BinaryType)


def _climb(level: DataFrame, keys: Sequence[str], name: str, tree: Tree) -> DataFrame:
    """Hash groups of digests level by level. Every level hashes, also a group of one, so all sizes have one definition."""
    for _ in range(tree.levels - 1):
        level = level.groupBy(*keys, F.floor(F.col("_i") / tree.fan_in).alias("_g")).agg(_hashed("node:").alias("_d")).withColumnRenamed("_g", "_i")
    fits = F.when(F.col("_i") == 0, F.col("_d")).otherwise(F.raise_error(F.lit("a sequence is longer than its digest tree holds")))
    return level.select(*keys, fits.alias(name))


def _leaves(df: DataFrame, keys: Sequence[str], ordinal: str, digest: str, tree: Tree) -> DataFrame:
    items = df.select(*keys, (F.col(ordinal) - 1).alias("_i"), F.col(digest).alias("_d"))
    grouped = items.groupBy(*keys, F.floor(F.col("_i") / tree.fan_in).alias("_g")).agg(_hashed("leaf:", _is_binary(df, digest)).alias("_d"))
    return grouped.withColumnRenamed("_g", "_i")


def ordered_digest(df: DataFrame, keys: Sequence[str], ordinal: str, digest: str, name: str, tree: Tree = TREE) -> DataFrame:
    """One digest per key over ``digest`` (hex text, or the same as bytes, which are half as long) in order of the dense 1-based ``ordinal``.

    A tree of ``levels`` levels: ``fan_in`` items make a leaf, as many leaves a node, and so on up to the root, so no task
    joins more than that many digests.
    """
    return _climb(_leaves(df, keys, ordinal, digest, tree), keys, name, tree)


def prefix_digests(df: DataFrame, keys: Sequence[str], ordinal: str, digest: str, probes: DataFrame, count: str, name: str, tree: Tree = TREE) -> DataFrame:
    """Digest of the first ``count`` items for each probe row (columns ``keys``, ``count`` and ``probe_id``).

    Whole leaves are hashed once and shared by all probes of a key; a probe adds only its last, partial leaf. No items
    have the digest of an empty text.
    """
    leaves = _leaves(df, keys, ordinal, digest, tree)
    asked = probes.select(*keys, F.col(count).cast("bigint").alias("_n"), "probe_id")
    whole = leaves.join(asked, [*keys]).where(F.col("_i") < F.floor(F.col("_n") / tree.fan_in)).select("probe_id", "_i", "_d")
    rest = asked.where(F.col("_n") % tree.fan_in > 0).withColumn("_g", F.floor(F.col("_n") / tree.fan_in))
    tail = df.select(*keys, (F.col(ordinal) - 1).alias("_i"), F.col(digest).alias("_d")).withColumn("_g", F.floor(F.col("_i") / tree.fan_in))
    partial = tail.join(rest, [*keys, "_g"]).where("_i < _n").groupBy("probe_id", "_g").agg(_hashed("leaf:", _is_binary(df, digest)).alias("_d"))
    level = whole.unionByName(partial.select("probe_id", F.col("_g").alias("_i"), "_d"))
    found = _climb(level, ["probe_id"], name, tree)
    return asked.select("probe_id").join(found, "probe_id", "left").withColumn(name, F.coalesce(name, F.sha2(F.lit(""), 256)))


def chain_digest(previous: Column, stream_digest: Column) -> Column:
    """Link of a check to the one before it; an empty stream hashes as the digest of no events."""
    empty = F.sha2(F.lit(""), 256)
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.lit(":"), F.coalesce(stream_digest, empty)), 256)
