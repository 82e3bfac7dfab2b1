import json
from dataclasses import replace

from pyspark.sql import functions as F

from foldstone.operators import views
from foldstone.operators.model import AGENT_PERFORMANCE, APPLICATION_SUMMARY, COMPLIANCE_AUDIT, READ_MODELS, ReadModel, application_key
from foldstone.operators.summary import application_summary
from foldstone.streaming import appends, follow, state
from helpers import START, Log, approved_path


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_models_follow_the_log_and_resume(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "root")
    first = approved_path(Log(), "A1")
    cut = 9
    frame = approved_path(first, "B1", hard=True).frame(spark)
    for lo, hi in ((0, cut), (cut, 10_000)):
        follow.write_log(frame.where((F.col("global_position") > lo) & (F.col("global_position") <= hi)), log)
        for model in READ_MODELS:
            follow.follow(spark, log, model, root).awaitTermination()
    for model in (APPLICATION_SUMMARY, COMPLIANCE_AUDIT, AGENT_PERFORMANCE):
        stored = follow.current_rows(spark, model, root)
        assert _same(stored.select(*model.rebuild(frame).columns), model.rebuild(frame)), model.name
    points = follow.checkpoints(spark, READ_MODELS, root)
    health = views.read_model_health(views.read_model_lag(points, frame), F.current_timestamp())
    assert {(r.projection_name, r.lag_positions, r.status) for r in health.collect()} == {(m.name, 0, "healthy") for m in READ_MODELS}


def test_poison_event_is_quarantined_once_and_others_finish(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "root")
    frame = approved_path(Log(), "A1").frame(spark)
    follow.write_log(frame, log)
    picky = ReadModel("picky", APPLICATION_SUMMARY.handled_types, application_summary, "application_id", application_key, lambda df: F.when(F.col("event_type") == "DecisionGenerated", F.lit("cannot read")))
    for model in (picky, COMPLIANCE_AUDIT):
        follow.follow(spark, log, model, root).awaitTermination()
    bad = follow.quarantined(spark, picky, root).collect()
    assert [(r.event_type, r.error, r.attempts) for r in bad] == [("DecisionGenerated", "cannot read", 3)]
    assert follow.current_rows(spark, picky, root).first().state == "FINAL_APPROVED"
    assert follow.current_rows(spark, COMPLIANCE_AUDIT, root).count() == 5 + 0


def _shuffled(frame, path, parts):
    """The events as files in an order that has nothing to do with their positions, some of them twice."""
    deal = F.pmod(F.xxhash64("event_id"), F.lit(parts))
    for k in range(parts):
        frame.where(deal == k).coalesce(1).write.mode("append").parquet(path)
    frame.where(deal == 0).coalesce(1).write.mode("append").parquet(path)


def test_stateful_fold_of_late_and_repeated_events_equals_the_batch_fold(spark, tmp_path):
    log = str(tmp_path / "log")
    frame = approved_path(approved_path(approved_path(Log(), "A1"), "B1", hard=True), "C1").frame(spark)
    _shuffled(frame, log, 6)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(log)
    out = str(tmp_path / "out")
    writer = state.stateful_summary(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp"))
    writer.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).start().awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.select("batch").distinct().count() >= 6
    want = application_summary(frame)
    latest = rows.groupBy("application_id").agg(F.max_by(F.struct(*[c for c in want.columns if c != "application_id"]), "batch").alias("s")).select("application_id", "s.*")
    assert _same(latest.select(*want.columns), want) and want.count() == 3


def test_idle_state_expires(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    frame = approved_path(Log(), "A1").frame(spark)
    first = frame.where("global_position <= 3")
    tick = frame.where("global_position = 4").withColumn("stream_id", F.lit("loan-Z")).withColumn("payload", F.lit("{}")).withColumn("event_type", F.lit("DecisionRequested"))
    late = frame.where("global_position = 5")
    for k, part in enumerate((first, tick.withColumn("recorded_at", F.expr("recorded_at + interval 90 days")), tick.withColumn("recorded_at", F.expr("recorded_at + interval 91 days")), late.withColumn("recorded_at", F.expr("recorded_at + interval 92 days")))):
        part.coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(frame.schema).parquet(log)
        writer = state.expiring_summary(stream, "30 days").writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp"))
        writer.foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).start().awaitTermination()
    rows = spark.read.parquet(out).where("application_id = 'A1'").orderBy("last_position").collect()
    assert rows[0].applicant_id is not None and rows[-1].last_position == 5 and rows[-1].applicant_id is None


def test_models_follow_a_shuffled_log_in_many_batches(spark, tmp_path, monkeypatch):
    """Files out of order and events delivered twice; parts of earlier batches are merged; batches don't read earlier events."""
    monkeypatch.setattr(follow, "MERGE_EVERY", 3)
    log, root = str(tmp_path / "log"), str(tmp_path / "root")
    frame = approved_path(approved_path(approved_path(Log(), "A1"), "B1", hard=True), "C1").frame(spark)
    deal = F.pmod(F.xxhash64("event_id"), F.lit(5))
    for k in (3, 0, 4, 1, 2, 3):
        follow.write_log(frame.where(deal == k).coalesce(1), log, buckets=1)
    for model in READ_MODELS:
        query = follow.follow(spark, log, model, root, files_per_batch=1)
        query.awaitTermination()
        stored, want = follow.current_rows(spark, model, root), model.rebuild(frame)
        assert _same(stored.select(*want.columns), want), model.name
        assert len(follow._folders(spark, f"{root}/{model.name}/parts/{next(iter(model.parts.merge))}")) >= 7
        assert {p["numInputRows"] for p in query.recentProgress} <= {0, *[frame.where(deal == k).count() for k in range(5)]}
        seen = follow.freshness([query])
        assert seen.agg(F.max("last_position")).first()[0] == frame.agg(F.max("global_position")).first()[0] + 1
        assert seen.agg(F.sum("events")).first()[0] == frame.count() + frame.where(deal == 3).count()


def test_a_failing_event_is_found_by_halving(spark, tmp_path):
    """The fold itself fails at two events; the other events of their batch are folded, other models don't notice."""
    log, root = str(tmp_path / "log"), str(tmp_path / "root")
    frame = approved_path(Log(), "A1").frame(spark)
    follow.write_log(frame, log)
    bad_types = ("DecisionGenerated", "FraudScreeningCompleted")

    def strict(events):
        failing = F.when(F.col("event_type").isin(*bad_types), F.raise_error(F.concat(F.lit("unreadable "), "event_id")).cast("string"))
        return events.withColumn("payload", F.coalesce(failing, F.col("payload")))

    for model in READ_MODELS:
        parts = replace(model.parts, split=lambda events, own=model.parts.split: own(strict(events)))
        for picky in (replace(model, name=f"{model.name}_parts", parts=parts), replace(model, name=f"{model.name}_fold", parts=None, key=None, fold=lambda events, own=model.fold: own(strict(events)))):
            follow.follow(spark, log, picky, root, max_attempts=2).awaitTermination()
            handled = [t for t in bad_types if t in model.handled_types]
            bad = follow.quarantined(spark, picky, root).collect()
            assert sorted(r.event_type for r in bad) == sorted(handled) and {r.attempts for r in bad} <= {2}
            assert all(f"unreadable {r.event_id}" in r.error for r in bad)
            want = model.rebuild(frame.where(~F.col("event_type").isin(*bad_types)))
            assert _same(follow.current_rows(spark, picky, root).select(*want.columns), want), picky.name


def test_bucket_number_is_kept_with_the_log(spark, tmp_path):
    log = str(tmp_path / "log")
    frame = approved_path(Log(), "A1").frame(spark)
    follow.write_log(frame.limit(3), log, buckets=7)
    follow.write_log(frame.limit(3), log, buckets=1000)
    assert follow.log_buckets(spark, log) == 7 and spark.read.parquet(log).agg(F.max("key_bucket")).first()[0] < 7


def test_streamed_appends_and_publication(spark, tmp_path):
    inbox, root = tmp_path / "inbox", str(tmp_path / "root")
    inbox.mkdir()

    def send(name, *requests):
        rows = [{"request_id": r, "request_order": i, "stream_id": s, "expected_version": v, "events": [{"event_type": "E", "payload": "{}", "recorded_at": START.isoformat()}], "metadata": "{}"} for i, (r, s, v) in enumerate(requests)]
        (inbox / name).write_text("\n".join(json.dumps(r) for r in rows))
        appends.append_stream(spark, str(inbox), root, lambda df: F.array(F.lit("bus"))).awaitTermination()

    send("1.json", ("a", "s1", -1), ("b", "s1", -1))
    send("2.json", ("c", "s1", 1), ("d", "s2", 4))
    decided = {r.request_id: r.status for r in spark.read.parquet(f"{root}/decisions").collect()}
    assert decided == {"a": "accepted", "b": "conflict", "c": "accepted", "d": "conflict"}
    events = spark.read.parquet(f"{root}/events").orderBy("global_position").collect()
    assert [(r.stream_id, r.stream_position, r.global_position) for r in events] == [("s1", 1, 1), ("s1", 2, 2)]
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):
        appends.publish_stream(spark, f"{root}/outbox", out, cp, "bus").awaitTermination()
    assert spark.read.json(out).count() == 2
    seen = []
    appends.publish_stream(spark, f"{root}/outbox", out, str(tmp_path / "cp2"), callback=lambda df, i: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 2
