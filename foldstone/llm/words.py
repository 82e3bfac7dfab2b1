"""Words of Arrow text columns as numpy arrays: spans, hashes and hashes of runs of words, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows are handled in slices of about so many bytes of text, which bounds the arrays a task holds; a longer text is a slice
# of its own.
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one-to-one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base % 2**64, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins and the last ends. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about ``limit`` bytes of text."""
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts: word i spans bytes starts[i]:ends[i]; text t has words first[t]:first[t+1]."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = buffers(column)
        if lower:
            self.data = LOWERED[self.data]
        n = len(self.data)
        inside = ~SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:n]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word: its bytes as a polynomial, from differences of prefix sums."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.data] * powers(BASE, n), out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * powers(pow(BASE, -1, 2**64), n + 1)[self.starts])

    def last_word(self) -> np.ndarray:
        """For every word the end of its text, as a word number."""
        return np.repeat(self.first[1:], self.counts)

    def bytes_of(self, text: int) -> bytes:
        return self.data[self.offsets[text] : self.offsets[text + 1]].tobytes()


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from every position that has n words behind it (over the ends of texts, too)."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * STEP + hashes[k : k + size]
    return mix(out)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from every position."""
    size, width, least = len(values) - n + 1, 1, values
    if size <= 0:
        return np.zeros(0, values.dtype)
    while 2 * width <= n:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[:size], least[n - width : n - width + size])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
