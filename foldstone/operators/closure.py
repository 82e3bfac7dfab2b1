"""Reachability over reference edges: an edge says "child refers to parent", and a node is reached when it is a seed or
refers to a reached node.

``reachable`` is for chains, where a node has one reference. In every round an edge into a node that has one reference of
its own is redirected to that reference (same truth, half the distance), an edge into a node that leads nowhere is dropped,
and edges into reached nodes resolve. Chains of length n take about log2(n) rounds. With several references per node the
rounds grow with depth.

``reached_in_order`` is for nodes that have a place in an order and refer to earlier ones only, by any number of
references. Places are cut into blocks; a block is folded in order in one go, whatever the depth inside it, and only what
it reached goes on to later blocks. Rounds are the block borders that a path of references crosses, at most the number of
blocks. In both the driver only learns whether something is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from foldstone.session import block_rows, cut_lineage


def _reached_in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Children that refer to a hit, or to a child found before them in their block. Blocks come one after the other, each in
    order of its places, and may go on from one batch to the next; only what was found in the present one is held."""
    at, found = None, set()
    for batch in batches:
        fresh = []
        for key, block, child, parent, hit in zip(*(batch[c].tolist() for c in ("key", "block", "child", "parent", "hit"))):
            if (key, block) != at:
                at, found = (key, block), set()
            if (hit or parent in found) and child not in found:
                found.add(child)
                fresh.append(child)
        yield pd.DataFrame({"id": pd.Series(fresh, dtype=object)})


def reached_in_order(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All ids reached from ``seeds(id)`` over ``edges(key, place, child, parent)``, seeds included.

    ``place`` is the child's 1-based place among the nodes of its key; parents of a node come before it. A block has as many
    places as ``foldstone.block.rows``, so a task holds the references of so many nodes, however large a key is. Most keys
    are small, so a task folds many blocks in one pass. Blocks are dealt over a given number of tasks, as edges are few bytes
    for their work; by a hash, as the partitions of the join before would be taken over and joined to a few.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor((F.col("place") - 1) / F.lit(block_rows(edges.sparkSession)))
    found = [cut_lineage(seeds.select("id").distinct())]
    left = _without_children(edges.select("key", block.alias("block"), "place", "child", "parent"), found[0])
    left = cut_lineage(left)
    while not left.isEmpty():
        hits = found[-1].select(F.col("id").alias("parent"), F.lit(True).alias("hit"))
        marked = cut_lineage(left.join(hits, "parent", "left").withColumn("hit", F.coalesce("hit", F.lit(False))))
        touched = marked.join(marked.where("hit").select("key", "block").distinct(), ["key", "block"], "left_semi")
        dealt = touched.repartition(parts, F.xxhash64("key", "block")).sortWithinPartitions("key", "block", "place")
        fresh = cut_lineage(dealt.mapInPandas(_reached_in_blocks, "id string"))
        if fresh.isEmpty():
            break
        left = cut_lineage(_without_children(marked.drop("hit"), fresh))
        found.append(fresh)
    return reduce(DataFrame.unionByName, found)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All ids reached from ``seeds(id)`` over ``edges(child, parent)``, seeds included."""
    found = [cut_lineage(seeds.select("id").distinct())]
    open_edges = _without_children(edges.select("child", "parent").where("child <> parent").distinct(), found[0])
    open_edges = cut_lineage(open_edges)
    while not open_edges.isEmpty():
        reached = reduce(DataFrame.unionByName, found)
        own = open_edges.groupBy("child").agg(F.count("*").alias("n"), F.max("parent").alias("up"))
        nodes = own.select(F.col("child").alias("parent"), "n", "up", F.lit(False).alias("hit")).unionByName(
            reached.select(F.col("id").alias("parent"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("up"), F.lit(True).alias("hit"))
        )
        looked_up = cut_lineage(open_edges.join(nodes, "parent", "left").where("n is not null"))
        fresh = cut_lineage(looked_up.where("hit").select(F.col("child").alias("id")).distinct())
        redirected = looked_up.where("not hit").select("child", F.when(F.col("n") == 1, F.col("up")).otherwise(F.col("parent")).alias("parent"))
        open_edges = cut_lineage(_without_children(redirected.where("child <> parent").distinct(), fresh))
        found.append(fresh)
    return reduce(DataFrame.unionByName, found)


def _without_children(edges: DataFrame, done: DataFrame) -> DataFrame:
    return edges.join(done.select(F.col("id").alias("child")), "child", "left_anti")
