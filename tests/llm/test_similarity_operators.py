"""N-gram join and substring dedup against brute force, with tiny chunks and shards as well."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from documents import awkward, essay, linked, table, tuples, windows_removed

from foldstone.llm import components, ngram_join, substring_dedup
from foldstone.llm.fm_index import FmIndex
from foldstone.llm.words import slices


def family(seed=5):
    """Near copies of different closeness, copies, and documents that share only a passage."""
    rng, rows = random.Random(seed), []
    passage = [f"common{k}" for k in range(25)]
    base = [f"b{k}" for k in range(80)]
    for k in range(40):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            text[rng.randrange(80)] = f"n{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(text), "a"))
    rows += [(200 + k, " ".join([*passage, *(f"u{k}v{i}" for i in range(rng.choice([10, 40])))]), "b") for k in range(30)]
    rows += [(300, "One two three", "a"), (301, "one TWO three", "a"), (302, "one two", "a"), (303, "", "a"), (304, None, "a"), (305, "", "a")]
    return rows


@pytest.mark.parametrize("words, percent, chunk", [(4, 85, 400_000), (4, 85, 500), (5, 80, 800)])
def test_join_equals_all_pairs(spark, words, percent, chunk):
    rows = family()
    got = tuples(ngram_join.linked_sets(table(spark, rows), words, percent, chunk), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == sorted(linked(rows, words, percent), key=str)


def test_join_of_awkward_rows(spark):
    got = {(r["doc_id"], r["n_shingles"]): r for r in ngram_join.linked_sets(table(spark, awkward())).collect()}
    assert got[(2, 53)]["component_id"] == 1
    assert got[(None, 53)]["component_id"] == 1 and got[(None, 1)]["component_id"] is None
    assert got[(13, 29_998)]["component_id"] == 12
    assert got[(4, 0)]["component_id"] == 4 and got[(4, 0)]["n_links"] == 0
    assert ngram_join.linked_sets(table(spark, [])).count() == 0
    assert [r["doc_id"] for r in ngram_join.one_of_each(table(spark, [(2, essay(1), "a"), (1, essay(1), "a"), (3, essay(9), "a")])).orderBy("doc_id").collect()] == [1, 3]


@pytest.mark.parametrize("words, percent", [(1, 85), (1, 80), (1, 50), (5, 80)])
def test_join_of_every_pair_of_sizes(spark, words, percent):
    """For all sizes below 60 a pair that shares just enough; pairs share nothing with each other."""
    rows = []
    for n in range(1, 60):
        for m in range(-(-percent * n // 100), n + 1):
            least = -(-percent * (n + m) // (100 + percent))
            name = f"p{len(rows)}"
            if words == 1 and least <= m:
                sets = [[f"{name}s{i}" for i in range(least)] + [f"{name}{own}{i}" for i in range(size - least)] for own, size in (("x", n), ("y", m))]
                rows += [(len(rows) + k, " ".join(s), "a") for k, s in enumerate(sets)]
            elif words > 1:  # the same text without its last words
                rows += [(len(rows) + k, " ".join(f"{name}s{i}" for i in range(size + words - 1)), "a") for k, size in enumerate((n, m))]
    got = tuples(ngram_join.linked_sets(table(spark, rows), words, percent), "doc_id", "n_links")
    assert got == sorted([(i, 1) for i, _, _ in rows], key=str)


def test_cells_connect_sets_of_neighbouring_sizes_only(spark):
    """Two sets of 100 that share nothing with each other, only both something with one of 1000, don't meet; near copies do."""
    held = [(1, 100, [1, 5]), (2, 100, [2, 6]), (3, 1000, [1, 2]), (4, 100, [5, 8]), (5, 110, [5, 9])]
    held = spark.createDataFrame(held, "place long, n long, leads array<long>")
    cells: dict[int, set] = {}
    for r in ngram_join._cells(held, held.select("place", "n"), 85).collect():
        cells.setdefault(r["cell"], set()).add(r["place"])
    assert {frozenset(c) for c in cells.values()} == {frozenset({1, 4, 5})}


def test_guests_are_sent_once_for_each_chunk_of_natives(spark):
    placed_in = [(k, 100, 7, k < 2) for k in range(40)] + [(100 + k, 100, 8, k < 25) for k in range(50)] + [(200, 100, 9, True), (201, 100, 9, False), (300, 100, 10, False), (301, 100, 10, False)]
    rows = ngram_join._dealt(spark.createDataFrame(placed_in, "place long, n long, cell long, native boolean"), 500).collect()
    of = {(r["place"], r["cell"]): (r["own"], r["meets"]) for r in rows}
    assert len(of) == 92 and not any(c == 10 for _, c in of)
    assert {of[k, 7] for k in range(2)} == {(0, 9)} and all(1 <= of[k, 7][0] < 9 and of[k, 7][1] == 1 for k in range(2, 40))
    assert all(of[100 + k, 8][0] < 5 and of[100 + k, 8][1] == 10 for k in range(25)) and all(5 <= of[100 + k, 8][0] < 10 and of[100 + k, 8][1] == 5 for k in range(25, 50))
    assert of[200, 9] == of[201, 9] == (0, 1)


@pytest.mark.parametrize("chunk", [400_000, 300])
def test_join_of_sets_kept_as_texts_and_as_n_grams(spark, chunk):
    """Texts of long words or many repetitions have many bytes for each n-gram; sets of neighbouring classes in many chunks."""
    rng = random.Random(8)
    rows = [(k, " ".join([f"word{i}" if i != k else "other" for i in range(60)] + ["la"] * (700 + k)), "a") for k in range(12)]
    rows += [(20 + k, " ".join(f"{'long' * 9}{i if i != 3 * k else 'x'}" for i in range(50)), "a") for k in range(12)]
    rows += [(40 + k, " ".join(f"s{i if rng.random() > 0.01 else rng.randrange(99)}" for i in range(88 + k)), "a") for k in range(24)]
    got = tuples(ngram_join.linked_sets(table(spark, rows), 4, 85, chunk), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == sorted(linked(rows, 4, 85), key=str) and max(r[3] for r in got) > 5


def test_sets_kept_from_slices_of_batches():
    rng = random.Random(1)
    texts = [" ".join(f"\u00e9{rng.randrange(10**digits)}" for _ in range(rng.randrange(9000))) for digits in [3, 5, 30] * 100]
    ones = pa.array([1] * len(texts), pa.int64())
    batch = pa.RecordBatch.from_arrays([ones, ones, ones, pa.array(texts)], ["place", "n", "copies", "text"])
    want = [s.tolist() for part in slices(iter([batch])) for s in ngram_join._sets(part, 4)]
    kept = list(ngram_join._members(4, 85, np.zeros(ngram_join.FREQUENT_BLOCKS, np.int64))(iter([batch.slice(0, 100), batch.slice(100)])))
    assert [s.tolist() for b in kept for s in ngram_join._kept_sets(b.column("text"), b.column("grams"), 4)] == want
    assert 0 < sum(b.column("text").null_count for b in kept) < len(texts) and all(len(a) <= 16 * len(s) for b in kept for a, s in zip(b.column("text").to_pylist(), ngram_join._sets(b, 4)) if a)


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(60)]
    for percent in (30, 60, 85, 100):
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))}
        assert {(i, int(j)) for i, found in ngram_join.trie_join(sets, sets, percent) for j in found} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 50 + k) for k in range(40, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{k: 0 for k in range(31)}, **{k: 90 for k in (*range(90, 101),)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fm_index_finds_what_is_there():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 5, 90), 0) for _ in range(20)])
    index = FmIndex(text)
    patterns = np.vstack([np.lib.stride_tricks.sliding_window_view(text, 6)[:300], rng.integers(1, 6, (50, 6)) - 2 * (rng.random((50, 6)) < 0.02)])
    low, high, matched = index.search(patterns)
    joined = [tuple(text[k : k + 6]) for k in range(len(text) - 5)]
    for p, a, b, m in zip(patterns.tolist(), low, high, matched):
        if 0 in p or min(p) < 0:
            continue
        want = [k for k, t in enumerate(joined) if t == tuple(p)]
        assert (sorted(index.rows[a:b].tolist()) if m == 6 else []) == want
        longest = max(k for k in range(7) if k == 0 or any(tuple(text[i : i + k]) == tuple(p[6 - k :]) for i in range(len(text))))
        assert m == longest


@pytest.mark.parametrize("shard", [20_000, 3])
def test_repeats_equal_brute_force(spark, shard):
    rng = random.Random(2)
    passage = essay(77, 40)
    rows = awkward() + family() + [(400 + k, " ".join([essay(k, rng.randrange(20)), passage, essay(k + 50, 15), "la " * 30]), "a") for k in range(12)]
    got = tuples(substring_dedup.remove_repeats(table(spark, rows), shard_fragments=shard), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(windows_removed(rows), key=str)


def test_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0
    assert tuples(substring_dedup.remove_repeats(table(spark, [(1, None, "a"), (2, "a b", "a")])), "doc_id", "n_removed") == [(1, 0), (2, 0)]


def test_shards_grow_with_the_meetings_of_a_hot_anchor(spark):
    sizes = spark.createDataFrame([(1, 1_000, 10), (2, 100, 1)], "anchor long, fragments long, chunks int")
    assert substring_dedup.meeting_shards(sizes, 100, 4) == 191 and substring_dedup.meeting_shards(sizes.limit(0), 100, 4) == 4


def test_trie_join_equals_brute_force_in_little_memory():
    rng = np.random.default_rng(0)
    for _ in range(20):
        base = [rng.choice(200, rng.integers(3, 30), replace=False) for _ in range(8)]

        def changed():
            own = base[rng.integers(8)].copy()
            own[rng.integers(len(own), size=rng.integers(0, 4))] = rng.integers(200)
            return np.unique(own.astype(np.uint64))

        left, right = [changed() for _ in range(60)], [changed() for _ in range(50)]
        for percent in (60, 80, 85):
            got = {(i, int(j)) for i, found in ngram_join.trie_join(left, right, percent) for j in found}
            assert got == {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))}
    sets = [np.append(np.arange(8), 100 + i).astype(np.uint64) for i in range(4000)]  # a chunk of short sets that all link
    tracemalloc.start()
    assert sum(len(found) for _, found in ngram_join.trie_join(sets, sets, 80)) == 4000**2
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
