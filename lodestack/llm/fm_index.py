"""FM-index over integer symbols: suffix array, wavelet-matrix ranks, sampled positions (numpy)."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the end sorts below every symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(n - width, 0)] = rank[width:]
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
        rank = new
        if n == 0 or rank[order[-1]] == n:
            return order
        width *= 2


class BitRank:
    """Bits with a running count for each 64, so that a rank is one look-up and one popcount."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits among the first i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class Wavelet:
    """Wavelet tree laid out by level, top bit first."""

    def __init__(self, symbols: np.ndarray, n_bits: int):
        self.levels = []
        current = symbols
        for shift in range(n_bits - 1, -1, -1):
            bit = (current >> shift) & 1
            self.levels.append((shift, BitRank(bit.astype(np.uint8)), int(len(bit) - bit.sum())))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i."""
        first = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = bits.ones(first), bits.ones(i)
            first, i = np.where(one, zeros + a, first - a), np.where(one, zeros + b, i - b)
        return i - first


class FMIndex:
    """Index of one text of symbols 0 .. n_symbols - 1; symbol 0 separates and is never searched."""

    SAMPLE = 16

    def __init__(self, text: np.ndarray, n_symbols: int):
        # one end mark below all, so that stepping back is well defined across separators
        text, n_symbols = np.concatenate([text.astype(np.int64) + 1, [0]]), n_symbols + 1
        self.n = len(text)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.wavelet = Wavelet(self.bwt, max(1, int(n_symbols - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        sampled = order % self.SAMPLE == 0
        self.sampled = BitRank(sampled.astype(np.uint8))
        self.is_sampled = sampled
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each pattern (rows of `patterns`, left-aligned), by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step] + 1
            lo[live] = self.first[symbol] + self.wavelet.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.wavelet.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to the nearest sampled position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.is_sampled[rows])
        while len(walking):
            symbol = self.bwt[rows[walking]]
            rows[walking] = self.first[symbol] + self.wavelet.rank(symbol, rows[walking])
            steps[walking] += 1
            walking = walking[~self.is_sampled[rows[walking]]]
        return self.positions[self.sampled.ones(rows)] + steps
