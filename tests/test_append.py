import random

from pyspark.sql import functions as F

from foldstone.operators import append
from foldstone.sources.ledger import read_jsonl, read_ledger, stream_events, write_ledger
from helpers import START, Log

REQUEST = f"request_id string, request_order bigint, stream_id string, expected_version bigint, events {append.EVENTS_DDL}, causation_id string, metadata string"


def _events(n):
    return [(None, "Noted", 1, '{"a":1}', '{"own":true}', START)] * n


def test_one_of_two_same_version_appends_wins(spark):
    heads = append.stream_heads(Log().add("credit-1", "A").add("credit-1", "B").add("credit-1", "C").frame(spark))
    rows = spark.createDataFrame([("r1", 1, "credit-1", 3, _events(1), None, None), ("r2", 2, "credit-1", 3, _events(1), None, None)], REQUEST)
    got = {r.request_id: r for r in append.decide_appends(rows, heads).collect()}
    assert (got["r1"].status, got["r1"].first_position) == ("accepted", 4)
    assert (got["r2"].status, got["r2"].expected_version, got["r2"].actual_version, got["r2"].suggested_action) == ("conflict", 3, 4, "reload_stream_and_retry")


def test_random_batches_equal_a_sequential_writer(spark, tiny_blocks):
    rng = random.Random(11)
    heads = {"s0": 4, "s1": 0, "s2": -1, "gone": 2}
    stored = spark.createDataFrame([("s0", 4, None), ("gone", 2, START)], "stream_id string, current_version bigint, archived_at timestamp")
    heads["s1"] = -1
    rows, want, live = [], {}, dict(heads)
    for i in range(120):
        stream = rng.choice(["s0", "s0", "s0", "s1", "s2", "gone"])
        n = rng.choice([0, 1, 1, 2])
        expected = live[stream] + rng.choice([0, 0, 0, 1, -1])
        rows.append((f"r{i}", i, stream, expected, _events(n), f"c{i}", '{"shared":1,"own":false,"stream_metadata":{}}'))
        if n == 0:
            want[f"r{i}"] = "empty"
        elif expected != live[stream]:
            want[f"r{i}"] = "conflict"
        elif stream == "gone":
            want[f"r{i}"] = "archived"
        else:
            want[f"r{i}"] = "accepted"
            live[stream] = max(live[stream], 0) + n
    requests = spark.createDataFrame(rows, REQUEST)
    decided = append.decide_appends(requests, stored)
    assert {r.request_id: r.status for r in decided.collect()} == want
    written = append.accepted_events(requests, decided, 50)
    got = written.orderBy("global_position").collect()
    assert [r.global_position for r in got] == list(range(51, 51 + len(got)))
    assert {r.stream_id: r.stream_position for r in got} == {s: v for s, v in live.items() if v != heads[s]}
    assert append.check_log(written.where("stream_id <> 's0'")).count() == 0
    meta = written.select("metadata", F.get_json_object("metadata", "$.own").alias("own"), F.get_json_object("metadata", "$.shared").alias("shared"), F.get_json_object("metadata", "$.causation_id").alias("c")).first()
    assert (meta.own, meta.shared) == ("true", "1") and meta.c.startswith("c") and "stream_metadata" not in meta.metadata


def test_outbox_round(spark, tmp_path):
    events = Log().add("loan-1", "A", {"x": 1}).add("loan-1", "B").frame(spark)
    outbox = append.outbox_rows(events, F.array(F.lit("bus")), F.col("recorded_at"))
    after, published, remaining = append.publish_pending(outbox, lambda df: df.write.json(str(tmp_path / "out")), F.lit("2026-02-01").cast("timestamp"))
    assert (published, remaining) == (2, 0)
    assert {r.attempts for r in after.collect()} == {1} and spark.read.json(str(tmp_path / "out")).count() == 2


def test_archiving_keeps_the_first_time(spark):
    first = append.archive_streams(spark.createDataFrame([], "stream_id string, archived_at timestamp"), spark.createDataFrame([("a",)], "stream_id string"), F.lit("2026-01-01").cast("timestamp"))
    again = append.archive_streams(first, spark.createDataFrame([("a",), ("b",)], "stream_id string"), F.lit("2026-02-01").cast("timestamp"))
    assert {r.stream_id: r.archived_at.month for r in again.collect()} == {"a": 1, "b": 2}
    versions = append.stream_versions(append.stream_heads(Log().add("a", "X").frame(spark)), spark.createDataFrame([("a",), ("z",)], "stream_id string"))
    assert {r.stream_id: r.current_version for r in versions.collect()} == {"a": 1, "z": -1}


def test_log_problems_are_found(spark, tiny_blocks):
    log = Log().add("a", "X", event_id="same").add("a", "X", event_id="same").add("a", "X").add("b", "X")
    rows = [list(r) for r in log.rows]
    rows[2][2] = 5
    rows[1][3] = 0
    from foldstone.schema import LEDGER_DDL

    found = append.check_log(spark.createDataFrame([tuple(r) for r in rows], LEDGER_DDL)).collect()
    assert {(r.problem, r.subject) for r in found} == {("duplicate_event_id", "same"), ("gap", "a:5"), ("global_order", "a:2")}


def test_jsonl_positions_follow_file_order(spark, tmp_path, tiny_blocks):
    lines = ['{"stream_id":"loan-%d","event_type":"E","payload":{"n":%d,"m":"1.50"},"recorded_at":"2026-01-01T00:00:00"}' % (i % 3, i) for i in range(50)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:30]) + "\n\n")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[30:]))
    # Files are read in several splits.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    got = read_jsonl(spark, str(tmp_path)).orderBy("global_position").collect()
    assert [int(r.payload.split('"n":')[1].split(",")[0]) for r in got] == list(range(50))
    assert [r.global_position for r in got] == list(range(1, 51))
    assert [r.stream_position for r in got if r.stream_id == "loan-1"] == list(range(1, 18))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    out = str(tmp_path / "ledger")
    write_ledger(read_jsonl(spark, str(tmp_path / "*.jsonl")), out)
    part = stream_events(read_ledger(spark, out), stream_id="loan-2", from_position=3, to_position=4)
    assert [r.stream_position for r in part.collect()] == [3, 4]
    assert "PartitionFilters: [isnotnull(stream_family" in part._jdf.queryExecution().toString()
