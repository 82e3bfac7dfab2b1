"""FM-index of word numbers: Burrows-Wheeler transform in a wavelet matrix, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits packed into words of 64, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones among the first i bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a sequence sorted by the ``depth`` (a power of two) numbers from each on, and the rank of every position;
    positions with equal numbers have equal ranks. Prefix doubling: each round sorts by pairs of ranks."""
    n, width, rank = len(symbols), 1, symbols.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while width < depth:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - width)] = rank[width:] + 1
        key = rank * (int(behind.max(initial=0)) + 1) + behind
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
        width *= 2
    return order, rank


class FmIndex:
    """Index of a sequence of numbers 1..n (0 separates its parts). Rows are sorted by their first 16 numbers, which is
    enough for patterns of at most 16: the rows before an interval are then exactly those that begin with less."""

    DEPTH = 16

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order, _ = suffix_order(symbols, self.DEPTH)
        self.rows = order
        last = symbols[order - 1]  # the number before each row; that of the first row is the separator at the end
        self.levels, self.zeros = [], []
        self.bits = max(1, int(symbols.max(initial=1)).bit_length())
        for level in range(self.bits - 1, -1, -1):
            ones = (last >> level) & 1
            self.levels.append(BitRank(ones))
            self.zeros.append(int(n - ones.sum()))
            last = np.concatenate([last[ones == 0], last[ones == 1]])
        counts = np.bincount(symbols, minlength=1 << self.bits)
        self.less = np.concatenate([[0], np.cumsum(counts)])[: 1 << self.bits]
        at = self._descend(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))
        self.base = self.less - at

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (rank, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = rank.ones(i)
            i = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + ones, i - ones)
        return i

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every row of ``patterns``, read from its end: rows low..high that begin with the longest part found, and its
        length (the matching statistic, at most the pattern's length). Numbers that the index lacks are -1."""
        total, length = patterns.shape
        low, high = np.zeros(total, np.int64), np.full(total, len(self.rows), np.int64)
        matched, alive = np.zeros(total, np.int32), np.arange(total)
        for k in range(length - 1, -1, -1):
            symbol = patterns[alive, k]
            alive, symbol = alive[symbol >= 0], symbol[symbol >= 0]
            both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low[alive], high[alive]])) + np.concatenate([self.base[symbol]] * 2)
            lows, highs = both[: len(symbol)], both[len(symbol) :]
            more = lows < highs
            alive = alive[more]
            low[alive], high[alive] = lows[more], highs[more]
            matched[alive] += 1
            if not len(alive):
                break
        return low, high, matched
