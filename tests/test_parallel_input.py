"""Work that grows with the tables is dealt over tasks, done once, and leaves Python out where Spark can fold by itself."""

from pyspark.sql import functions as F

from foldstone.functions import digest
from foldstone.operators import commands as C, integrity, package, views
from foldstone.plans import commands
from foldstone.sources import adapters
from foldstone.streaming import state
from helpers import Log


def _customers(spark, folder, n=40):
    spark.range(n).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{folder}/customer.parquet")


def test_events_of_customers_in_one_file_are_built_by_many_tasks(spark, tmp_path):
    _customers(spark, tmp_path)
    ledger = adapters.lifecycle_ledger(spark, str(tmp_path))
    assert ledger.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = {r.k: r.n for r in ledger.groupBy((F.floor(F.col("global_position") / 32)).alias("k")).agg(F.count("payload").alias("n")).collect()}
    assert sizes == {k: min(k % 18 + 1, 15) if k % 5 == 0 else k % 18 + 1 for k in range(40)}


def test_commands_replay_the_log_once(spark, tmp_path, monkeypatch):
    _customers(spark, tmp_path)
    calls, replay = [], C.replay_states
    monkeypatch.setattr(C, "replay_states", lambda ledger: calls.append(1) or replay(ledger))
    states = commands._states(spark, str(tmp_path))
    assert (states.applications.count(), states.sessions.where("session_started").count(), len(calls)) == (40, 28, 1)


def test_state_of_the_summary_is_folded_without_python(spark, tmp_path):
    kinds = "event_id string, stream_id string, stream_position bigint, global_position bigint, event_type string, event_version int, payload string, metadata string, recorded_at timestamp"
    stream = spark.readStream.schema(kinds).parquet(str(tmp_path))
    assert "Pandas" not in state.stateful_summary(stream)._jdf.queryExecution().analyzed().toString()


def test_packages_shuffle_no_contents(spark, monkeypatch):
    log = Log()
    for n in range(7):
        log.add("loan-A", "DocumentUploaded", {"application_id": "A", "document_id": f"d{n}"})
    ledger, at, seen = log.frame(spark), F.lit("2027-01-01").cast("timestamp"), []
    keep = package.stage
    monkeypatch.setattr(package, "stage", lambda df: seen.append(df) or keep(df))
    entities = spark.createDataFrame([("loan", "A")], "entity_type string, entity_id string")
    results = keep(integrity.integrity_checks(ledger, entities, None, at))
    rows = keep(package.package_rows(ledger, integrity.check_events(results, 1000), results, at))
    assert all(df.where("s in (0, 4)").isEmpty() for df in seen if "content" in df.columns)
    told = rows.where("section in ('event_stream', 'narrative')").groupBy("section").agg(F.sort_array(F.collect_list("ordinal")).alias("o")).collect()
    assert [r.o for r in told] == [[*range(1, 8)]] * 2
    seen.clear()
    headers = package.package_digests(rows, at)
    assert [df.schema["_h"].dataType.typeName() for df in seen] == ["binary"]
    assert package.verify_packages(rows, keep(headers), at).first().ok


def test_digests_of_bytes_and_of_text_are_the_same(spark):
    items = spark.range(1, 30).select(F.lit("k").alias("k"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("text")).withColumn("bytes", F.unhex("text"))
    small = digest.Tree(4, 4)
    assert len({digest.ordered_digest(items, ["k"], "n", c, "d", small).first().d for c in ("text", "bytes")}) == 1


def test_documents_of_companies_are_built_by_many_tasks(spark, tmp_path):
    spark.range(90).selectExpr("id as o_orderkey", "id % 30 as o_custkey", "id * 1000.5 as o_totalprice").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    texts = adapters.statement_texts(spark, str(tmp_path))
    assert texts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and texts.count() == 90


def test_events_that_name_their_application_are_not_joined(spark):
    log = Log().add("agent-x-s1", "AgentSessionStarted", {"application_id": "A", "session_id": "s1"}).add("agent-x-s1", "AgentNodeExecuted", {"session_id": "s1"})
    log.add("docpkg-B", "PackageReadyForAnalysis", {"package_id": "docpkg-B"}).add("agent-y-s2", "AgentNodeExecuted", {"session_id": "s2"}).add("loan-C", "DocumentUploaded", {})
    grouped = views.grouped_events(log.frame(spark))
    assert sorted((r.application_id, r.event_id) for r in grouped.collect()) == [("A", "ev1"), ("A", "ev2"), ("B", "ev3"), ("C", "ev5")]
    plan = grouped._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.splitlines()[0] and "isnull(_application_id" in plan
