import hashlib

import pytest
from pyspark.sql import functions as F

from foldstone.functions import mountain
from foldstone.operators import integrity
from helpers import Log, approved_path


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(items, fan_in, levels):
    """Peaks from the left: the largest complete tree that fits, again and again."""
    out, at = [], 0
    while at < len(items):
        level = max(j for j in range(levels + 1) if at + fan_in**j <= len(items))
        nodes = items[at : at + fan_in**level]
        for _ in range(level):
            nodes = [sha("node:" + "".join(nodes[k : k + fan_in])) for k in range(0, len(nodes), fan_in)]
        out.append(nodes[0])
        at += fan_in**level
    return sha(f"root:{len(items)}:" + "".join(out))


@pytest.mark.parametrize("shape", [mountain.Range(2, 3), mountain.Range(3, 2), mountain.Range(4, 4)])
def test_ranges_grow_to_what_a_whole_one_is(spark, shape):
    sizes = {"a": (1, 9), "b": (7, 0), "c": (16, 1), "d": (0, 5), "e": (9, 18)}
    items = [(k, n, sha(f"{k}{n}")) for k, (x, y) in sizes.items() for n in range(1, x + y + 1)]
    ledger = spark.createDataFrame(items, "stream_id string, stream_position bigint, h string")
    early = spark.createDataFrame([r for r in items if r[1] <= sizes[r[0]][0]], ledger.schema)
    first = integrity.range_check(early, digest=F.col("h"), shape=shape)
    second = integrity.range_check(ledger, first.nodes, first.results, F.col("h"), shape)
    got = {r.stream_id: r for r in second.results.collect()}
    for k, (x, y) in sizes.items():
        assert got[k].root == plain_root([i[2] for i in items if i[0] == k], *shape) and got[k].verified == x + y
        assert got[k].hashed == y and got[k].consistent and (got[k].previous_root is None) == (x == 0)
    whole = integrity.range_check(ledger, digest=F.col("h"), shape=shape)
    kept = first.nodes.unionByName(second.nodes)
    assert kept.exceptAll(whole.nodes).count() == 0 and whole.nodes.exceptAll(kept).count() == 0
    forged = first.results.withColumn("root", F.when(F.col("stream_id") == "c", sha("other")).otherwise(F.col("root")))
    assert [r.stream_id for r in integrity.range_check(ledger, first.nodes, forged, F.col("h"), shape).results.where("not consistent").collect()] == ["c"]


def test_every_column_counts_and_tampering_is_located(spark):
    frame = approved_path(approved_path(Log(), "A1"), "B1", hard=True).frame(spark)
    shape = mountain.Range(2, 3)
    nodes = integrity.range_check(frame, shape=shape).nodes
    assert integrity.tampered_events(frame, nodes, shape=shape).count() == 0
    hit = (F.col("stream_id") == "loan-A1") & (F.col("stream_position") == 3)
    changes = {"event_id": F.lit("x"), "event_type": F.lit("x"), "event_version": F.lit(9), "payload": F.lit("{}"), "metadata": F.lit('{"a":1}'), "recorded_at": F.col("recorded_at") + F.expr("interval 1 microsecond"), "global_position": F.lit(999)}
    for column, value in changes.items():
        forged = frame.withColumn(column, F.when(hit, value.cast(frame.schema[column].dataType)).otherwise(F.col(column)))
        assert [(r.stream_id, r.stream_position, r.problem) for r in integrity.tampered_events(forged, nodes, shape=shape).collect()] == [("loan-A1", 3, "changed")], column
    assert [(r.stream_position, r.problem) for r in integrity.tampered_events(frame.where(~hit), nodes, shape=shape).collect()] == [(3, "missing")]
