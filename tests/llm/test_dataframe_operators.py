"""Exact dedup, mixing, url filter and decontamination against plain statements of their results."""

import pytest
from documents import SCHEMA, WORDS, awkward, essay, exact, table, tuples

from pyspark.sql import functions as F

from foldstone.llm import decontaminate, exact_dedup, mixing, native, ngram_join, url_filter


@pytest.fixture(scope="module")
def rows():
    return awkward()


def test_exact_groups(spark, rows):
    got = tuples(exact_dedup.exact_groups(table(spark, rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(exact(rows), key=str)
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


def test_keep_first_keeps_one_row_of_each_text(spark, rows):
    kept = exact_dedup.keep_first(table(spark, rows))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20]


def test_filter_lets_every_repeated_hash_pass(spark):
    keys = spark.range(4000).selectExpr("xxhash64(id % 3000) AS h")
    bits = native.repeated_filter(keys, "h", blocks=64)  # far too small: it may pass too much, never too little
    twice = native.possible_hits(spark.range(1000).selectExpr("xxhash64(id) AS h"), native.F.col("h"), bits, blocks=64)
    assert twice.count() == 1000
    fine = native.repeated_filter(keys, "h")
    assert native.possible_hits(spark.range(1000, 3000).selectExpr("xxhash64(id) AS h"), native.F.col("h"), fine).count() < 20


def targets(sizes):
    """Targets by resharing what is above the caps, again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("range_rows", [2, 1000])
def test_mix_meets_each_budget(spark, rows, range_rows):
    got = mixing.mix(table(spark, rows), range_rows=range_rows).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    want = targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert own[0]["target"] == pytest.approx(want[s])
        assert sum(r["taken"] for r in own) == int(want[s] + 0.5)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    again = mixing.mix(table(spark, rows[::-1]), range_rows=range_rows)
    assert tuples(again, "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=str)


def test_mix_of_nothing(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert tuples(mixing.mix(table(spark, [(1, None, None), (2, "", "a")])), "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0)]
    mixed = mixing.mixed_documents(table(spark, [(1, essay(1), "a"), (2, essay(2), "b")]))
    assert mixing.mixed_documents(mixed).columns == mixed.columns


URLS = [
    ("http://www.Example.com/en/x?q=/fr/", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("https://example.com/english", "example.com", "/english", "com/", "allow"), ("x://a.net/es/1#t", "a.net", "/es/1", "net/es/", "block"), ("x://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("x://a.net/de/", "a.net", "/de/", None, "allow"), ("x://a.com", "a.com", "", None, "allow"), ("x://b.com:80/", "b.com:80", "/", None, "allow"), ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://", "", "", None, "allow"), ("http://x.org?u=http://a.com/", "x.org", "", None, "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "h", "r", "v") for k, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], "h", "r", "v")], "page_id long, url string, html string, rule string, form string")
    rules = spark.createDataFrame([("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")], "rule string, verdict string")
    got = tuples(url_filter.judge(pages, rules), "page_id", "url", "host", "path", "rule", "verdict")
    assert got == sorted([(k, *u) for k, u in enumerate(URLS)] + [(0, *URLS[0])], key=str)
    assert url_filter.judge(pages.where("false"), rules).count() == 0


def test_leaks(spark, rows):
    items = spark.createDataFrame([(1, essay(30, 40)), (2, essay(31, 6)), (3, "too short"), (4, None), (5, "Seven  words, which stand\nin this item!")], "item_id long, text string")
    held = essay(30, 40).split()
    leaky = [(101, "start " * 500 + essay(30, 40).upper() + " end" * 500, "a"), (102, " ".join(held[:36]), "a"), (103, " ".join(held[:30]), "a"), (104, "- seven words; which stand in this ITEM", "b"), (105, essay(31, 6), None), (106, "it is Too - SHORT, they say", "b"), (107, "too much, too short", "b"), (108, "too very short", "b")]
    got = tuples(decontaminate.leaks(table(spark, rows + leaky), items), "doc_id", "item_id", "item_size", "n_shared")
    assert got == [(101, 1, 36, 36), (102, 1, 36, 32), (104, 5, 3, 3), (105, 2, 2, 2), (106, 3, 1, 1), (107, 3, 1, 1)]
    kept = decontaminate.without_leaks(table(spark, rows + leaky), items)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _, _ in [*rows, leaky[2], leaky[7]])
    assert decontaminate.leaks(table(spark, []), items).count() == 0
    assert decontaminate.leaks(table(spark, rows), items.where("false")).count() == 0


def test_columns_of_any_name_stay(spark):
    """Columns that are named like those the operators use inside pass through unchanged."""
    rows = [(1, essay(1), "a"), (2, essay(1), "a"), (2, essay(1).replace(" ", "  "), "b"), (3, essay(2), "a"), (4, " ".join(essay(2).split()[:59]), "a"), (5, essay(30, 40), "a")]
    names = ["__maybe", "__digest", "__row", "__probe", "__at", "__block", "__bits", "__gone", "__held", "__mask"]
    documents = table(spark, rows).select("*", *[F.lit(n).alias(n) for n in names])
    items = spark.createDataFrame([(1, essay(30, 40))], "item_id long, text string")
    exact = exact_dedup.keep_first(documents)
    near = ngram_join.one_of_each(documents)
    clean = decontaminate.without_leaks(documents, items)
    for kept, ids in ((exact, [1, 3, 4, 5]), (near, [1, 3, 5]), (clean, [1, 2, 2, 3, 4])):
        assert kept.columns == documents.columns and sorted(r["doc_id"] for r in kept.collect()) == ids
        assert {tuple(r) for r in kept.select(*names).collect()} == {tuple(names)}


def test_one_row_of_an_id_with_two_spellings(spark):
    rows = [(7, "a  b", "x"), (7, "a b", "y"), (8, "a b", "z")]
    for order in (rows, rows[::-1]):
        assert [(r["doc_id"], r["text"], r["source"]) for r in exact_dedup.keep_first(table(spark, order)).collect()] == [(7, "a  b", "x")]
