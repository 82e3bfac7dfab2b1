"""Byte-level BPE (operator 11): merges are replayed over all distinct words of a slice of the corpus at once.

Every task reads its part of the corpus in slices, numbers the distinct words (matches of the splitting pattern) and
lays their bytes side by side. An inverted index leads from the rank of a token pair to the positions where it stands. The
ranks are worked off from the lowest: all positions of a rank are merged together, and only the pairs that touch a merged
token get a new rank and a new entry. Texts are then sequences of word numbers, their ids a gather.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.words import slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Bytes of text whose distinct words are merged together; words and tokens that are gathered at a time.
SLICE, STEP = 8 << 20, 1 << 20
LONG_TEXT = 1 << 22

NONE = np.iinfo(np.int32).max  # stands for "no such pair"
GONE = -1  # symbol of a position that was merged away, and of the place behind the last one


class Vocabulary:
    """Tokens by rank. ``data[starts[i]:starts[i + 1]]`` has the bytes of token i."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.size = max(self.ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(token) for token in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # A pair's rank is that of the joined bytes, so every way to cut a token in two counts.
        cuts = [(self.ranks[t[:k]] * self.size + self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        pairs = np.array(sorted(cuts), np.int64).reshape(-1, 2)
        self.pairs, self.joined = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], NONE)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, NONE where the two don't make a token."""
        key = left * self.size + right
        at = np.searchsorted(self.pairs, key)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.joined[at], NONE)

    def encode_word(self, word: bytes) -> list[int]:
        """The plain way for one word: the leftmost pair of the lowest rank, again and again."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NONE), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]


@lru_cache(maxsize=2)
def vocabulary_at(path: str) -> Vocabulary:
    return Vocabulary(path)


def by_value(values: np.ndarray, carried: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The carried numbers of each value."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    edges = [0, *cuts.tolist(), len(ordered)]
    carried = carried[order]
    for begin, end in zip(edges, edges[1:]):
        if begin < end:
            yield int(ordered[begin]), carried[begin:end]


def merge_words(words: list[bytes], known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after the other, and where each word begins and the last ends."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends, n = np.cumsum([len(w) for w in words], dtype=np.int64), len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    symbol = np.append(known.of_byte[data], GONE)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1] = n  # position n stands for none
    before[np.concatenate([[0], ends[:-1]])] = n
    of_bytes = known.rank_of(np.repeat(known.of_byte, 256), np.tile(known.of_byte, 256))
    rank = np.full(n + 1, NONE)
    inner = np.flatnonzero(after[:n] < n)
    rank[inner] = of_bytes[data[inner].astype(np.int64) * 256 + data[inner + 1]]
    index = {r: [at] for r, at in by_value(rank[inner], inner) if r != NONE}
    waiting = sorted(index)
    odd: set[int] = set()
    while waiting:
        r = heapq.heappop(waiting)
        at = np.concatenate(index.pop(r))
        at = np.unique(at[rank[at] == r])
        if not len(at):
            continue
        chained = np.append(False, after[at[:-1]] == at[1:])
        if chained.any():  # of pairs that overlap, the first, third and so on are merged
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
        right = after[at]
        following = after[right]
        beside = np.flatnonzero(following[:-1] == at[1:])  # two merges side by side: the pair between them is seen before the second
        early = at[beside][known.rank_of(np.full(len(beside), r), symbol[at[beside + 1]]) < r] if len(beside) else beside
        symbol[at], symbol[right], rank[right] = r, GONE, NONE
        after[at], before[following] = following, at
        touched = np.concatenate([at, before[at]])
        touched = touched[touched < n]
        now = known.rank_of(symbol[touched], symbol[after[touched]])
        rank[touched] = now
        early = np.concatenate([early, touched[now < r]])
        if len(early):  # a pair that should have come first: such words are done apart
            odd.update(np.searchsorted(ends, early, side="right").tolist())
        real = now != NONE
        for new, places in by_value(now[real], touched[real]):
            if new in index:
                index[new].append(places)
            else:
                index[new] = [places]
                heapq.heappush(waiting, new)
    left = symbol[:n] != GONE
    bounds = np.concatenate([[0], np.cumsum(left)])[np.concatenate([[0], ends])]
    ids = symbol[:n][left]
    # A word that is a token as a whole is that token, whatever merges would give.
    whole = {k: [known.ranks[words[k]]] for k in np.flatnonzero(np.diff(bounds) > 1).tolist() if words[k] in known.ranks}
    apart = {k: known.encode_word(words[k]) for k in odd if k not in whole} | whole
    if apart:
        parts = [apart.get(k, ids[bounds[k] : bounds[k + 1]]) for k in range(len(words))]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        ids = np.concatenate(parts).astype(np.int64)
    return ids, bounds


def gathered(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> bytes:
    """The runs values[bounds[i]:bounds[i + 1]] of all i one after the other."""
    out = []
    for begin in range(0, len(which), STEP):
        part = which[begin : begin + STEP]
        counts = bounds[part + 1] - bounds[part]
        skip = bounds[part] - (np.cumsum(counts) - counts)
        out.append(values[np.repeat(skip, counts) + np.arange(counts.sum())].tobytes())
    return b"".join(out)


class Numbers(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def encode_texts(texts: list[str], known: Vocabulary, pattern: regex.Pattern) -> list[bytes]:
    """The token ids of every text as little-endian unsigned 32-bit integers."""
    numbers, sequences = Numbers(), []
    for text in texts:
        words = pattern.findall(text) if len(text) < LONG_TEXT else (m.group() for m in pattern.finditer(text))
        sequences.append(np.fromiter(map(numbers.__getitem__, words), np.int32))
    ids, bounds = merge_words([w.encode("utf-8") for w in numbers], known)
    ids = ids.astype("<u4")
    return [gathered(ids, bounds, s) for s in sequences]


def _encoded(vocabulary: str, pattern: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = vocabulary_at(vocabulary), regex.compile(pattern)
        for batch in slices(batches, limit=SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encode_texts(texts, known, split), pa.binary())], ["doc_id", "ids"])

    return of


def _decoded(vocabulary: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary_at(vocabulary)
        for batch in batches:
            texts = [gathered(known.data, known.starts, np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in batch.column("ids").to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.binary()))

    return of


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per document: doc_id, and ids, the tokens of its whole text as little-endian unsigned 32-bit integers.

    ``vocabulary`` has a token (base64) and its rank in each line, among them all single bytes; the file must be at the same
    path on all machines. Each match of ``pattern`` is encoded apart, by the lowest rank and leftmost first; there are no
    special tokens. Null and empty texts have no ids. Repeated rows are encoded alike, an empty table gives an empty
    result, and other columns are ignored. Nothing is shuffled; a task holds one slice of texts and its distinct words.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(vocabulary, pattern), "doc_id long, ids binary")


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``decoded``, the bytes that the tokens in ``ids`` stand for. Null counts as no tokens."""
    schema = tokens.drop("decoded").schema.add("decoded", "binary")
    return tokens.drop("decoded").mapInArrow(_decoded(vocabulary), schema)
