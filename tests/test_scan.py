import hashlib
import random

import pandas as pd
from pyspark.sql import functions as F

from foldstone.functions import digest
from foldstone.operators import closure
from foldstone.operators.closure import reachable, reached_in_order
from foldstone.operators.scan import asof, before, count_so_far, highest, last, listed, number_rows, running, total


def _rows(seed=1, n=200):
    rng = random.Random(seed)
    # One key holds most rows.
    return [(("hot" if rng.random() < 0.6 else f"k{rng.randint(1, 9)}"), i, rng.choice([None, rng.randint(0, 9)])) for i in range(n)]


def test_running_values_equal_a_plain_loop(spark, tiny_blocks):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    got = running(df, ["k"], "pos", {"l": last(F.col("v")), "b": before(F.col("v")), "s": total(F.col("v")), "n": count_so_far(), "x": highest(F.col("v"))})
    state, want = {}, {}
    for k, pos, v in rows:
        lv, sv, nv, xv = state.get(k, (None, 0, 0, None))
        new = (v if v is not None else lv, sv + (v or 0), nv + 1, v if xv is None else xv if v is None else max(xv, v))
        want[pos] = (new[0], lv, new[1], new[2], new[3])
        state[k] = new
    assert {r.pos: (r.l, r.b, r.s, r.n, r.x) for r in got.collect()} == want


def test_numbering_without_keys(spark, tiny_blocks):
    df = spark.createDataFrame([(i * 7,) for i in range(40)], "pos bigint")
    assert [r.n for r in number_rows(df, [], "pos", "n").orderBy("pos").collect()] == list(range(1, 41))


def test_asof_takes_latest_before_and_at(spark, tiny_blocks):
    left = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("b", 3, 3)], "k string, pos bigint, id int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("b", 4, "z")], "k string, pos bigint, v string")
    assert {r.id: r.v for r in asof(left, right, ["k"], "pos", "v").collect()} == {1: None, 2: "y", 3: None}
    assert {r.id: r.v for r in asof(left, right, ["k"], "pos", "v", inclusive=True).collect()} == {1: "x", 2: "y", 3: None}


def test_lists_keep_order_and_everything(spark, tiny_blocks):
    df = spark.createDataFrame([("a", i, str(i)) for i in range(25)], "k string, pos bigint, v string")
    got = listed(df, ["k"], "pos", F.col("v"), "item").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["item"]) for r in got] == [(i + 1, str(i)) for i in range(25)]


def test_reachability_of_chains_and_random_graphs(spark):
    chain = [(str(i + 1), str(i)) for i in range(300)]
    edges = spark.createDataFrame(chain, "child string, parent string")
    assert reachable(edges, spark.createDataFrame([("0",)], "id string")).count() == 301
    rng = random.Random(5)
    pairs = [(str(c), str(rng.randint(0, c - 1))) for c in range(1, 80) for _ in range(rng.choice([0, 1, 1, 2, 3]))]
    seeds = {"3", "17"}
    want = set(seeds)
    for c in range(80):
        if any(a == str(c) and b in want for a, b in pairs):
            want.add(str(c))
    got = reachable(spark.createDataFrame(pairs, "child string, parent string"), spark.createDataFrame([(s,) for s in seeds], "id string"))
    assert {r.id for r in got.collect()} == want


def _backward(nodes, references, seed):
    """Nodes of two keys in order, each with up to ``references`` references to earlier ones of its key."""
    rng = random.Random(seed)
    pairs = [(key, c, f"{key}{c}", f"{key}{p}") for key in "ab" for c in range(2, nodes + 1) for p in {rng.randint(max(1, c - 6), c - 1) for _ in range(rng.randint(0, references))}]
    want = {"a3", "b1", "b9"}
    for key, c, child, parent in sorted(pairs, key=lambda x: x[1]):
        if parent in want:
            want.add(child)
    return pairs, want


def test_references_to_earlier_nodes_in_blocks(spark, tiny_blocks):
    for references in (1, 2, 3):
        pairs, want = _backward(40, references, references)
        edges = spark.createDataFrame(pairs, "key string, place bigint, child string, parent string")
        got = reached_in_order(edges, spark.createDataFrame([("a3",), ("b1",), ("b9",)], "id string")).collect()
        assert sorted(r.id for r in got) == sorted(want)


def test_rounds_do_not_grow_with_depth(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(closure, "cut_lineage", lambda df, own=closure.cut_lineage: cuts.append(1) or own(df))
    seen = set()
    for depth in (50, 1500):
        pairs = [("a", c, str(c), str(p)) for c in range(2, depth + 1) for p in {c - 1, max(1, c - 2)}]
        cuts.clear()
        assert reached_in_order(spark.createDataFrame(pairs, "key string, place bigint, child string, parent string"), spark.createDataFrame([("1",)], "id string")).count() == depth
        seen.add(len(cuts))
    assert len(seen) == 1 and max(seen) <= 5


def test_small_keys_are_folded_side_by_side(spark):
    pairs = [(f"k{k}", c, f"k{k}-{c}", f"k{k}-{c - 1}") for k in range(60) for c in range(1, 4)]
    seeds = spark.createDataFrame([(f"k{k}-0",) for k in range(60)], "id string")
    got = reached_in_order(spark.createDataFrame(pairs, "key string, place bigint, child string, parent string"), seeds).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.id for r in got) == sorted([f"k{k}-{c}" for k in range(60) for c in range(4)])
    assert len({r.task for r in got if not r.id.endswith("-0")}) > 1


def test_blocks_go_on_over_batches_and_end_with_their_key():
    rows = [("a", 0, "x2", "x1", True), ("a", 0, "x3", "x2", False), ("a", 0, "x3", "x1", True), ("a", 1, "x9", "x3", False), ("b", 0, "y2", "x3", False)]
    edges = pd.DataFrame(rows, columns=["key", "block", "child", "parent", "hit"])
    for cut in range(len(rows) + 1):
        assert [i for found in closure._reached_in_blocks(iter([edges[:cut], edges[cut:]])) for i in found["id"]] == ["x2", "x3"]


def tree_root(items, fan_in, levels):
    level, tag = items, "leaf:"
    for _ in range(levels):
        level = [hashlib.sha256((tag + "".join(level[i : i + fan_in])).encode()).hexdigest() for i in range(0, len(level), fan_in)]
        tag = "node:"
    return level[0]


def test_digest_trees_have_one_definition_and_prefixes_agree(spark):
    rows = [("a", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "k string, n bigint, h string")
    hashes = [r[2] for r in rows]
    assert digest.ordered_digest(df, ["k"], "n", "h", "d").first().d == tree_root(hashes, 4096, 4)
    small = digest.Tree(3, 5)
    probes = spark.createDataFrame([("a", n, f"p{n}") for n in (0, 1, 3, 4, 9, 10, 27, 29)], "k string, count bigint, probe_id string")
    got = {r.probe_id: r.d for r in digest.prefix_digests(df, ["k"], "n", "h", probes, "count", "d", small).collect()}
    for n in (1, 3, 4, 9, 10, 27, 29):
        assert got[f"p{n}"] == tree_root(hashes[:n], 3, 5), n
    assert digest.ordered_digest(df, ["k"], "n", "h", "d", small).first().d == got["p29"]
    assert got["p0"] == hashlib.sha256(b"").hexdigest() and len(set(got.values())) == len(got)
