"""The pipeline's stages against brute force, on a small corpus with planted cases."""

import corpus_pipeline
import numpy as np
from documents import essay, linked, table
from test_text_operators import labelled


def test_stages_keep_what_they_should(spark, tmp_path):
    documents, labels = labelled(spark, 120)
    near = essay(3, 80).split()
    planted = [(2000, essay(1), "b"), (2001, essay(1), "b"), (2002, " ".join(near), "c"), (2003, " ".join([*near[:79], "x"]), "c"), (2004, "lead " + essay(6, 30) + " trail", None), (2005, essay(7), None)]
    both = documents.unionByName(table(spark, planted))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, essay(6, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        result = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert result.dtypes == both.dtypes
        result.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        after = {r["doc_id"] for r in docs.collect()}
        kept.append((before, after))
    ids = [({i for i, _, _ in before}, after) for before, after in kept]
    assert ids[0][1] >= {2000, 2001, 2002, 2003, 2004, 2005, 1100} and not ids[0][1] & {1000, 1001, 1003, 1103}
    assert ids[1][0] - ids[1][1] == {2001, *([1102] if 1102 in ids[1][0] else [])}
    assert ids[2][1] == {c for _, _, c, _ in linked(kept[2][0], 5, 80)}
    assert ids[3][0] - ids[3][1] == {2004}
    sizes = {(r["source"], r["mix_target"]) for r in docs.collect()}
    for source, target in sizes:
        assert abs(sum(r["mix_taken"] for r in docs.collect() if r["source"] == source) - target) <= 1
    assert np.isin([2000, 2002], list(ids[3][1])).all()


def test_run_applies_all_stages(spark, tmp_path):
    documents, labels = labelled(spark, 60)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count() < documents.count()
