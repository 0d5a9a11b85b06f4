"""A compressed full-text index in numpy: suffix order, wavelet-tree ranks, sampled suffix positions.

The text is an array of symbols in which 0 separates (and ends) documents; patterns never hold 0. Searches run over
many patterns at once, a numpy step per symbol.
"""

from __future__ import annotations

import numpy as np

#: Of so many text positions one is kept; a walk to it is shorter than that.
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Separators rank by position, so no comparison goes beyond a document."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    step = 1
    while True:
        # symbols may be more than positions: the base is above either
        key = rank * (max(n, int(rank.max())) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Wavelet:
    """Wavelet matrix: access and rank of any symbol in a bit per level, packed in 64-bit words with block counts."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.n = len(symbols)
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        now = symbols.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, dtype=np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).view(np.uint64)) - np.uint64(1)
        return self.blocks[level][w] + np.bitwise_count(self.words[level][w] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i, for arrays of both."""
        start, end = np.zeros_like(i), i.copy()
        for level in range(self.bits):
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self._ones(level, start), self._ones(level, end)
            start = np.where(one, self.zeros[level] + a, start - a)
            end = np.where(one, self.zeros[level] + b, end - b)
        return end - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level in range(self.bits):
            one = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(level, i)
            one = one.astype(bool)
            i = np.where(one, self.zeros[level] + ones, i - ones)
            out = (out << 1) | one
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int) -> None:
        """text: symbols below sigma with 0 after each document."""
        self.n = n = len(text)
        order = suffix_order(text)
        before = text[order - 1] if n else text
        self.tree = Wavelet(before, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        # every SAMPLE-th position and each start of a document, so that no walk crosses a separator
        keep = order % SAMPLE == 0
        if n:
            keep |= (order == 0) | (before == 0)
        self.sampled = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)
        self.positions = order[keep]

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search by one symbol for many ranges."""
        return self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows that start with each pattern (rows of a right-aligned matrix, its last symbol last)."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        width = patterns.shape[1] if patterns.ndim == 2 else 0
        for k in range(width):
            on = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(on):
                break
            lo[on], hi[on] = self.step(patterns[on, width - 1 - k], lo[on], hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one, fewer than SAMPLE steps away."""
        rows = rows.astype(np.int64).copy()
        out = np.empty(len(rows), dtype=np.int64)
        on = np.arange(len(rows))
        for steps in range(SAMPLE):
            r = rows[on]
            hit = self.sampled[r + 1] > self.sampled[r]
            out[on[hit]] = self.positions[self.sampled[r[hit]]] + steps
            on = on[~hit]
            if not len(on):
                return out
            c = self.tree.access(rows[on])
            rows[on] = self.first[c] + self.tree.rank(c, rows[on])
        raise ValueError("the index is not that of its text")
