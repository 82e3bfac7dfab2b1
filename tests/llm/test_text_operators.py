"""Classifiers on held-out rows, token counts as an exact round trip, and page texts."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from documents import SCHEMA, awkward, table, tuples
from pyspark.sql import functions as F

from foldstone.llm import html_text, quality, token_counts, toxicity
from foldstone.llm.words import Words, runs, sliding_min

FOLDER = os.environ.get("LABELLED_DIR", "/root/testdata/sf0.1")
LABELS = "doc_id long, quality int, toxic int"


def held_out(spark, function, label):
    documents, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = function(documents, labels)
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    return np.array([(r[0], r[1], r[2]) for r in rows]), scored.count() == documents.count()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are not here")
def test_toxicity_on_held_out_rows(spark):
    rows, whole = held_out(spark, toxicity.toxicity, "toxic")
    assert whole and rows[rows[:, 2] == 1, 0].mean() > 4 * rows[rows[:, 2] == 0, 0].mean()
    assert (rows[:, 1] == rows[:, 2]).mean() > 0.93
    assert rows[rows[:, 2] == 0, 1].mean() < 0.03


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are not here")
def test_toxicity_in_every_language(spark):
    documents, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = toxicity.toxicity(documents, labels).where("held_out").join(labels.where("toxic = 1"), "doc_id").join(documents.select("doc_id", "lang"), "doc_id")
    found = {r["lang"]: r["found"] for r in rows.groupBy("lang").agg(F.avg("predicted").alias("found")).collect()}
    assert len(found) > 1 and min(found.values()) > 0.6 and rows.agg(F.avg("predicted")).first()[0] > 0.8


def plain_kernel(a, b):
    """Sums over all common subsequences of three letters within the span, one by one."""
    def vector(word):
        out = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    key = (word[i], word[j], word[k])
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    u, v = vector(a), vector(b)
    norm = lambda x: sum(w * w for w in x.values()) ** 0.5
    return sum(w * v.get(k, 0) for k, w in u.items()) / max(norm(u) * norm(v), 1e-9)


def letters(row):
    return [int(c) for c in row if c]


def test_kernel_and_scores_equal_plain_ones():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcde"), rng.integers(1, 19))) for _ in range(150)] + ["idiot", "idxiot", "moron", "zz"]
    units = toxicity.Units(pa.array([" ".join(words)], pa.large_string()))
    rows, _ = units.distinct()
    landmarks = rows[rng.choice(len(rows), 12, replace=False)]
    want = {(w, k): plain_kernel(letters(r), letters(m)) for w, r in enumerate(rows) for k, m in enumerate(landmarks)}
    got = {(w, k): v for w, k, v in zip(*(x.tolist() for x in toxicity.Table(landmarks).near(rows)))}
    assert {p for p, v in want.items() if v > toxicity.NEAR + 1e-6} <= set(got) <= {p for p, v in want.items() if v > toxicity.NEAR - 1e-6}
    assert all(abs(v - want[p]) < 1e-5 for p, v in got.items())
    model = toxicity.Model(landmarks, rng.normal(0, 1, 12), -0.3, 0.2, 1.5, -0.5)
    texts = [" ".join(words[:40]), "b a d  and c.a.b", "", None, words[3]]
    for text, score in zip(texts, model.scores(pa.array(texts, pa.string())).tolist()):
        own = toxicity.Units(pa.array([text], pa.large_string()))
        rows, which = own.distinct()
        total = sum(b * v for u in which for m, b in zip(landmarks, model.beta) if (v := plain_kernel(letters(rows[u]), letters(m))) >= toxicity.NEAR)
        root = max(1, int(own.plain.sum())) ** 0.5
        assert abs(score - 1 / (1 + np.exp(-(1.5 * (total / root - 0.3 * toxicity.SIZE_SCALE * root + 0.2) - 0.5)))) < 1e-5


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are not here")
def test_quality_on_held_out_rows(spark):
    rows, whole = held_out(spark, quality.quality, "quality")
    assert whole and (rows[:, 1] == rows[:, 2]).mean() > 0.97


def labelled(spark, n=240):
    """Plain sentences, and ones with insults; every third insult of the rows without a label is disguised."""
    rng = np.random.default_rng(4)
    syllables = "an er th in on re st ou ha le ti or".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, labels = [], []
    for k in range(n):
        words, toxic = [word() for _ in range(40)], int(k % 2)
        if toxic:
            words[rng.integers(40)] = ("blorgwick", "zumpfart")[k % 4 // 2]
        rows.append((k, " ".join(words[:20]) + ". " + " ".join(words[20:]), "a"))
        labels.append((k, 1, toxic))
    plain = " ".join(word() for _ in range(20))
    rows += [(1000 + k, f"{plain} {x} {plain}", "a") for k, x in enumerate(["b l o r g w i c k", "blorg-wick", "bloorgwick", "zumpxfart", "Z.u.m.p.f.a.r.t"])] + [(1100, plain, "a"), (1101, None, "a"), (1102, "", "a"), (1103, "blorgwick", "a")]
    return table(spark, rows), spark.createDataFrame(labels, LABELS)


def test_disguised_insults_are_seen(spark):
    documents, labels = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(documents, labels).collect()}
    assert [got[k]["predicted"] for k in (1000, 1001, 1002, 1003, 1004, 1103)] == [1] * 6
    assert [got[k]["predicted"] for k in (1100, 1101, 1102)] == [0] * 3
    assert got[1101]["score"] == got[1102]["score"] and got[1]["held_out"] is (__import__("zlib").crc32(b"1") % 3 == 1)
    kept = toxicity.without_toxic(documents, labels)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["predicted"]}


def test_insults_with_gaps_and_short_ones_are_seen(spark):
    documents, labels = labelled(spark)
    plain = "the rest of it is as others are"
    insults = ["moron", "scum", "stupid", "loser", "kek", "zz", "\u0431\u044f\u043a"]
    rows = [(2000 + k, f"{plain} {insults[k % len(insults)]} {plain}", "a") for k in range(420)]
    rows += [(3000 + k, f"{plain} {plain}", "a") for k in range(420)]
    more = spark.createDataFrame([(i, 1, int(i < 3000)) for i, _, _ in rows], LABELS)
    split = [(w[:k], w[k:]) for w in insults if len(w) > 3 for k in range(1, len(w))] + [("st", "up", "id"), ("mo", "r", "on"), ("lo", "se", "r"), ("kek",), ("zz",), ("\u0431\u044f\u043a",)]
    asked = [(5000 + k, f"{plain} {' '.join(parts)} {plain}", "a") for k, parts in enumerate(split)] + [(6000, plain, "a")]
    scored = toxicity.toxicity(documents.union(table(spark, rows + asked)), labels.union(more)).collect()
    got = {r["doc_id"]: r["predicted"] for r in scored if r["doc_id"] is not None and r["doc_id"] >= 5000}
    assert {split[k - 5000]: p for k, p in got.items() if k < 6000} == dict.fromkeys(split, 1) and got[6000] == 0


@pytest.mark.parametrize("function, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_without_labels_or_rows(spark, function, label):
    documents, none = table(spark, awkward()), spark.createDataFrame([(1, None, None), (None, 1, 1)], LABELS)
    assert {r["score"] for r in function(documents, none).collect()} == {0.0}
    one_class = spark.createDataFrame([(1, 1, 1), (3, 1, 1), (1, 1, 1)], LABELS)
    assert len({r["score"] for r in function(documents, one_class).collect()}) == 1
    some = spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)], LABELS)
    assert function(table(spark, []), some).count() == 0
    assert all(0 <= r["score"] <= 1 for r in function(documents, some).collect())


def test_tokens_add_up_and_spans_cover_the_text(spark):
    rows = [*awkward(), (30, "a\n\n\nb\r\n  c\n", "a"), (31, "\u00e9\u4e2d\n\U0001f600\U0001f600\nend", "a"), (32, "\n", "a")]
    got = token_counts.section_tokens(table(spark, rows)).collect()
    encoding, _ = token_counts._encoding(token_counts.VOCABULARY, token_counts.PATTERN)
    for i, text, _ in rows:
        if i in (None, 14):
            continue
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["section"])
        assert "".join((text or "")[r["start_char"] : r["end_char"]] for r in own) == (text or "")
        assert [(text or "")[r["start_char"] : r["end_char"]] for r in own] == (text or "").removesuffix("\n").split("\n") if len(own) == 1 and not text else True
        assert sum(r["n_tokens"] for r in own) == len(encoding.encode_ordinary(text or ""))
    assert token_counts.section_tokens(table(spark, [])).count() == 0


def test_very_long_runs(spark):
    """Runs of 5 million characters, alone and between words; and against the library where it can do them itself."""
    known = token_counts._encoding(token_counts.VOCABULARY, token_counts.PATTERN)[0]
    for text in [" " * 12_000 + "x", "a" + "\n" * 11_000, " \t" * 6_000 + "\n\ny " + " " * 10_000 + "12", "b" + " " * 9_999 + "\r" + " c", "\u00a0" * 10_500 + "'s"]:
        assert token_counts.encode(text, token_counts.VOCABULARY, token_counts.PATTERN).tolist() == known.encode_ordinary(text)
    n = 5_000_000
    rows = [(1, " " * n, "a"), (2, "w" + "\n" * 300_000 + "w", "a"), (3, "x" * n, "a"), (4, "-" * n, "a")]
    got = {r["doc_id"]: r for r in token_counts.section_tokens(table(spark, rows)).groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.max("end_char").alias("chars"), F.count("*").alias("sections")).collect()}
    assert {k: r["chars"] for k, r in got.items()} == {1: n, 2: 300_002, 3: n, 4: n} and got[2]["sections"] == 300_001
    assert all(r["tokens"] > 1000 for r in got.values())


def test_sections_equal_a_plain_attribution(spark):
    """Token by token: its characters are looked up one after the other, most of them decide, the earlier line on ties."""
    rng = np.random.default_rng(2)
    signs = ["\n", "\n", " ", "a", "the", "\r\n", "\n\n\n", "\u4e2d", "\U0001f600", "!", "  \n  "]
    rows = [(k, "".join(rng.choice(signs, 40)), "a") for k in range(60)]
    known, _ = token_counts._encoding(token_counts.VOCABULARY, token_counts.PATTERN)
    want = []
    for i, text, _ in rows:
        line_of, line = [], 0
        for c in text:
            line_of.append(line)
            line += c == "\n"
        lines = max(line_of) + 1
        tokens, crossing, done, at = [0] * lines, [0] * lines, 0, 0
        for token in known.encode_ordinary(text):
            done += len(known.decode_single_token_bytes(token))
            end = len(text.encode()[:done].decode("utf-8", "ignore"))
            whole = text.encode()[:done].decode("utf-8", "ignore").encode() == text.encode()[:done]
            own = line_of[at:end] if end > at else [line_of[min(at, len(text) - 1)]]
            best = min(sorted(set(own)), key=lambda x: -own.count(x))
            tokens[best] += 1
            crossing[best] += len(set(own)) > 1
            at = end if whole else at if end == at else end
        want += [(i, k, tokens[k], crossing[k]) for k in range(lines)]
    got = tuples(token_counts.section_tokens(table(spark, rows)), "doc_id", "section", "n_tokens", "n_crossing")
    assert got == sorted(want, key=str) and sum(w[3] for w in want) > 5


def test_attribution_rule():
    owner, crossing = token_counts.attribute(np.array([2, 5, 6, 9]), np.array([3, 4, 9]))
    assert owner.tolist() == [0, 0, 2, 2] and crossing.tolist() == [False, True, False, False]


def test_words_of_arrow_columns():
    texts = ["a  bb\tccc", None, "", "\u00e9\u00a0x y", "bb a"]
    words = Words(pa.array(["skipped", *texts]).slice(1))
    assert words.counts.tolist() == [3, 0, 0, 2, 2]
    h = words.hashes()
    assert h[0] == h[6] and h[1] == h[5] and len(set(h.tolist())) == 5
    assert len(runs(h, 2)) == 6 and sliding_min(np.array([3, 1, 2, 0, 5]), 3).tolist() == [1, 0, 0]


PAGES = [
    ("<html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a>Home</a></ul></nav><div class='ad'>Buy</div><article><h1>Head &amp; tail</h1><p><b>One<br>two.<p>Three\n  four&nbsp;&#233;<script>var t='</p>'</script></article><footer>&copy;</footer>", "Head & tail\nOne two.\nThree four \u00e9"),
    ("<main><!-- <p>no</p> --><p>Text</p><aside>side</aside><div id=comments><p>Reader</p></div><form><p>Name</p></form><p hidden>secret</p></main><p>after</p>", "Text"),
    ("<article><header><h1>Title</h1></header><p>Body <a href='x>y'>link</a></p><div class='share social'>Share</div></article>", "Title\nBody link"),
    ("", ""), (None, ""), ("plain text only", "plain text only"), ("<p>a < b</p><p>unclosed <b", "a < b\nunclosed <b"),
]


def test_pages(spark):
    rows = [(k, f"http://h{k}.org/", p, "x") for k, (p, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], "x"), (None, "u", "<p>x</p>" * 3, "x")]
    got = tuples(html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")), "page_id", "text", "n_chars")
    want = [(k, t, len(t)) for k, (_, t) in enumerate(PAGES)] + [(0, PAGES[0][1], len(PAGES[0][1])), (None, "x\nx\nx", 5)]
    assert got == sorted(want, key=str)
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


KEPT = [
    ('<p title="the hidden city">Real text</p>', "Real text"), ('<p data-id="banner">Kept</p>', "Kept"), ("<p title=it's>one</p><p>don't stop</p>", "one\ndon't stop"),
    ('<p class="related-work">Work</p><h2 id="social-history">History</h2>', "Work\nHistory"), ('<div class="ad-box">x</div><div class=comment-list>y</div><p hidden>z</p><p style="color:red; display: none">q</p><p>a</p>', "a"),
    ("a &lt;b&gt; < 3 <3 </> <p", "a <b> < 3 <3 <p"), ("<script>x</script >a<STYLE>b</style>c<textarea>d", "ac"), ('<p id="a>b">c</p><!-- <p>no --><?x y?><!doctype z>d', "c\nd"),
    ("<i><b>x</i>y</b>z", "xyz"), ('<p x="1>unclosed quote<p>b', "unclosed quote\nb"), ("</p></div>x", "x"),
]


def test_blocks_by_attributes_and_whole_names():
    for page, text in KEPT:
        assert "\n".join(html_text.blocks(page)[0]) == text, page


def test_parsing_is_linear():
    n = 1 << 20
    for page in ["<a " * (n // 3), "<a x='" * (n // 6), '<a x="y ' * (n // 8), "<" * n, "<b>" * (n // 3) + "</i>" * (n // 4), "<!--" * (n // 4), "<script>" * (n // 8), "</" * (n // 2), "<p>" * (n // 3), "<div><p>" * (n // 8), "<a " + "x=1 " * (n // 4)]:
        begin = time.process_time()
        html_text.blocks(page)
        assert time.process_time() - begin < 4, page[:20]


def test_suffix_classes_are_those_of_equal_sequences():
    rng = np.random.default_rng(3)
    for depth in (1, 3, 8, 11):
        words = rng.integers(0, 3, 200)
        classes = html_text.suffix_classes(words, depth)
        whole = [tuple(words[k : k + depth]) for k in range(len(words) - depth + 1)]
        assert len(set(zip(whole, classes.tolist()))) == len(set(whole)) == len(set(classes[: len(whole)].tolist()))


@pytest.mark.parametrize("shard", [1, 3, 20_000])
def test_host_repetitions_equal_brute_force(spark, monkeypatch, shard):
    """Sequences of eight words on three or more different pages of a host go, wherever they stand; also where keys are hot."""
    rng = np.random.default_rng(shard)
    parts = [" ".join(f"p{k}w{i}" for i in range(rng.integers(5, 15))) for k in range(6)]
    rows = []
    for k in range(60):
        own = [[f"own{k}x{j}"] * int(rng.integers(0, 2)) + [parts[i] for i in rng.integers(0, 6, rng.integers(1, 4))] + [f"end{k}"] * int(rng.integers(0, 2)) for j in range(3)]
        rows.append((k, f"http://h{k % 4}.org/", "".join(f"<div>{' '.join(b)}</div>" for b in own)))
    pages_of: dict[tuple, set] = {}
    blocks_of: dict[tuple, set] = {}
    parsed = [(k, k % 4, html_text.blocks(page)[0]) for k, _, page in rows]
    for k, host, own in parsed:
        for block in own:
            words = block.split(" ")
            blocks_of.setdefault((host, block), set()).add(tuple(own))
            for p in range(len(words) - 7):
                pages_of.setdefault((host, *words[p : p + 8]), set()).add(tuple(own))
    want = []
    for k, host, own in parsed:
        kept = []
        for block in own:
            words = block.split(" ")
            gone = {p + i for p in range(len(words) - 7) if len(pages_of[host, *words[p : p + 8]]) >= 3 for i in range(8)}
            if len(blocks_of[host, block]) < 3:
                kept.append(" ".join(w for i, w in enumerate(words) if i not in gone))
        want.append((k, "\n".join(b for b in kept if b)))
    monkeypatch.setattr(html_text, "_kept_blocks", lambda placed, own=html_text._kept_blocks: own(placed, shard))
    got = tuples(html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "text")
    assert got == sorted(want, key=str) and sum(len(t) for _, t in want) > 500


def test_host_repetitions_are_boilerplate(spark):
    notice = "this sentence of the house stands on every single page of it"
    rows = [(k, "http://one.org/", f"<div>{notice}</div><div>own{k} text{k} of{k}</div><div>lead{k} {notice} tail{k}</div><div>short line</div>") for k in range(4)]
    rows += [(10, "http://two.org/", f"<div>{notice}</div>"), (11, "http://two.org/", f"<div>{notice}</div>")]
    got = tuples(html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "text")
    assert got == sorted([(k, f"own{k} text{k} of{k}\nlead{k} tail{k}") for k in range(4)] + [(10, notice), (11, notice)], key=str)


def test_sequences_of_a_large_host_are_counted_as_a_whole(spark):
    """More than a million words of distinct blocks, all with one notice between words of their own."""
    notice = "this sentence of the house stands on every single page of it"
    own = [[f"{side}{k}n{i}" for i in range(2_000)] for k in range(280) for side in "lr"]
    rows = [(k, "http://large.org/", f"<div>{' '.join(own[2 * k])} {notice if k < 3 else ''} {' '.join(own[2 * k + 1])}</div>") for k in range(280)]
    got = dict(tuples(html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "text"))
    assert got == {k: " ".join(own[2 * k] + own[2 * k + 1]) for k in range(280)}


def test_repetitions_on_one_page_are_no_boilerplate(spark):
    phrase = "the lessee shall bear all costs of the repair"
    page = lambda k, n: "".join(f"<p>p{k}a{i} {phrase} p{k}b{i}</p>" for i in range(n))
    rows = [(0, "http://one.org/", page(0, 5)), *((10 + k, "http://two.org/", page(k, 2)) for k in range(2)), *((20 + k, "http://three.org/", page(k, 2)) for k in range(3))]
    got = dict(tuples(html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "text"))
    text = lambda k, n, middle: "\n".join(f"p{k}a{i} {middle}p{k}b{i}" for i in range(n))
    assert got == {0: text(0, 5, phrase + " "), **{10 + k: text(k, 2, phrase + " ") for k in range(2)}, **{20 + k: text(k, 2, "") for k in range(3)}}
