"""Byte-level BPE against tiktoken, spelling variants and hard negatives against brute force."""

import hashlib
import re
import zlib
from base64 import b64encode
from collections import Counter
from tempfile import NamedTemporaryFile

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from documents import awkward, table, tuples

from foldstone.llm import byte_bpe, hard_negatives, spelling
from foldstone.llm.catalog import QUERIES


def reference_encoding():
    known = byte_bpe.vocabulary_at(byte_bpe.VOCABULARY)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def digests(encoding, text):
    ids = encoding.encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_bpe_equals_the_library_and_goes_round(spark, tmp_path):
    odd = ["it's we're 'S don't''s x'll  y", "  \n\t two  spaces \n", "<|endoftext|> ok", "日本語 テキスト １２３ ½", "\x00\x1c\x85​", "a" * 3000 + "é" * 500, " " * 5000, "ababab" * 700, "한글 \U0001f600\U0001f600"]
    rows = [*awkward(), *[(100 + i, t, "a") for i, t in enumerate(odd)]]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    encoding = reference_encoding()
    got = sorted(tuples(QUERIES["op11_byte_bpe"](spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), key=repr)
    assert got == sorted([(i, *digests(encoding, t or "")) for i, t, _ in rows], key=repr)
    assert byte_bpe.encode(table(spark, rows).where("false")).count() == 0


def test_bpe_of_very_long_words():
    """Longer than the library itself can split."""
    known, split = byte_bpe.vocabulary_at(byte_bpe.VOCABULARY), regex.compile(byte_bpe.PATTERN)
    text = " " * 5_000_000 + "x"
    ids = np.frombuffer(byte_bpe.encode_texts([text], known, split)[0], "<u4").astype(np.int64)
    assert byte_bpe.gathered(known.data, known.starts, ids) == text.encode()


def test_merges_of_random_vocabularies():
    """Any ranks, also such where a later merge makes a pair of a lower rank: always as word by word."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 300:
            joined = b"".join(tokens[k] for k in rng.integers(97, 100, 2)) if rng.random() < 0.3 else tokens[rng.integers(256, len(tokens))] + tokens[rng.integers(97, 100)] if len(tokens) > 256 else b"ab"
            if joined not in tokens and len(joined) < 9:
                tokens.append(joined)
        order = [*range(256), *(256 + rng.permutation(len(tokens) - 256))]
        with NamedTemporaryFile("wb", suffix=".tiktoken") as file:
            file.writelines(b64encode(t) + b" %d\n" % r for t, r in zip(tokens, order))
            file.flush()
            known = byte_bpe.Vocabulary(file.name)
        words = [bytes(rng.integers(97, 100, rng.integers(0, 24)).astype(np.uint8)) for _ in range(80)]
        ids, bounds = byte_bpe.merge_words(words, known)
        for k, word in enumerate(words):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == ([known.ranks[word]] if word in known.ranks else known.encode_word(word))


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(rows, every, least=5):
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if every and h % every == 0 else run
            counts[word] += len(word) >= 6
    counts = {w: n for w, n in counts.items() if n >= least}
    found, forms = {}, {}
    for word, n in counts.items():
        others = [o for o in counts if abs(len(o) - len(word)) < 2 and near(o, word)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[word] = best if best is not None and counts[best] >= 5 * n else None
        found[word] = len(others)
    out = []
    for word, n in counts.items():
        root = word
        while forms[root]:
            root = forms[root]
        out.append((word, forms[word], root, n, found[word], counts.get(forms[word])))
    return out


@pytest.mark.parametrize("every", [None, 3])
def test_variants_equal_brute_force(spark, every):
    rng = np.random.default_rng(8)
    syllables = ["an", "er", "th", "ça", "ñi", "on", "aa", "st"]
    stems = ["".join(rng.choice(syllables, rng.integers(3, 6))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "ababab", "abababa", "Àaaaaa"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(30):
            word = stems[min(int(rng.exponential(6)), len(stems) - 1)]
            if rng.random() < 0.12:
                p = int(rng.integers(len(word)))
                word = [word[:p] + word[p + 1 :], word[:p] + "eñ"[p % 2] + word[p:], word[:p] + "o" + word[p + 1 :]][k % 3]
            words.append(word.title() if rng.random() < 0.1 else word)
        rows.append((k if k % 50 else None, " ".join(words) + " - x1" + words[0] + "×÷", "a"))
    rows += awkward() + rows[:3]
    got = tuples(spelling.variants(table(spark, rows), every=every), "word", "form", "root", "n", "n_near", "form_n")
    want = plain_variants(rows, every)
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[1] is not None for r in want) > 20
    assert any(r[1] is not None and r[1] != r[2] for r in want) or every is None
    assert spelling.variants(table(spark, rows).where("false")).count() == 0


def test_pivots_are_the_cheapest_pair_apart():
    rng = np.random.default_rng(5)
    for _ in range(300):
        places = rng.choice(9, 3, replace=False)
        prefix = [(int(rng.integers(1, 9)), f"g{p}", int(p)) for p in places]
        chosen = spelling.pivots(prefix)
        apart = [(a, b) for a in prefix for b in prefix if a[2] + 2 <= b[2]]
        assert len(chosen) == 2 and abs(chosen[0][2] - chosen[1][2]) >= 2
        assert sum(g[0] for g in chosen) == min(a[0] + b[0] for a, b in apart)


def plain_negatives(rows):
    usable = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rank = lambda s: (-s[1], np.inf if s[0] is None else s[0])
    out = []
    for anchor, label, vector in usable:
        if anchor is None or anchor % 50:
            continue
        scored = [(i, sum(a * b for a, b in zip(vector, v)), y == label) for i, y, v in usable if i != anchor]
        for positive, high, _ in sorted([s for s in scored if s[2]], key=rank)[:5]:
            fitting = sorted([s for s in scored if not s[2] and 50 * high <= 100 * s[1] <= 95 * high], key=rank)[:3]
            out += [(anchor, positive, k, i, high, s) for k, (i, s, _) in enumerate(fitting, 1)]
    return out


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(spark, rows, **settings):
    kinds = "vec_id long, embedding array<float>, label int, row int, unit string, score double"
    vectors = spark.createDataFrame([(i, v, y, 1, "x", None) for i, y, v in rows], kinds)
    return tuples(hard_negatives.hard_negatives(vectors, lambda i: i % 50 == 0, **settings), *NAMES)


@pytest.mark.parametrize("width, spread", [(3, 0.02), (8, 0.3), (300, 40.0)])
def test_negatives_equal_brute_force(spark, width, spread):
    """Few different scores, so ties decide; usual vectors; and wide ones that take several primes and partial sums."""
    rng = np.random.default_rng(width)
    rows = [(i, int(rng.integers(3)), np.float32(rng.normal(0, spread, width) + spread / 2).tolist()) for i in range(0, 420)]
    rows += [(1000, 1, [spread] * (width - 1)), (1050, 9, [spread] * width), (1100, None, [0.1] * width), (1150, 1, None), (1200, 1, [float("nan")] + [0.1] * (width - 1)), (1250, 1, [None] * width), (1300, 2, []), (None, 1, [spread] * width), (1350, 0, [float("inf")] * width), *rows[40:45], *rows[40:42]]
    want = sorted(plain_negatives(rows), key=repr)
    assert sorted(mined(spark, rows, anchor_block=4, row_block=60), key=repr) == want and len(want) > 10
    assert sorted(mined(spark, rows), key=repr) == want


def test_negatives_of_no_rows_and_scores_beyond_a_long(spark):
    assert mined(spark, [(None, None, None)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1e20]), (1, 1, [1e20])])


def test_remainders_give_signed_scores_exactly():
    rng = np.random.default_rng(1)
    for top, width in ((100, 5), (2**20, 700), (2**28, 20)):
        left, right = rng.integers(-top, top, (7, width)), rng.integers(-top, top, (9, width))
        primes = hard_negatives.primes_for(float(top) ** 2 * width)
        residues = [[hard_negatives.centred(m, p) for p in primes] for m in (left, right)]
        assert (hard_negatives.scores(*residues, primes) == left @ right.T).all()
