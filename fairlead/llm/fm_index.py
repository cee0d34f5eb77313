"""An FM-index over a sequence of small integers: suffix array, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; ``text`` ends with its only 0."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class Bits:
    """Packed bits with the count of ones before every 64th, for ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.ones = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.width = max(1, int(symbols - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.width - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(len(values) - self.levels[-1].ones)
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        first = np.zeros_like(end)
        for k, bits in enumerate(self.levels):
            one = (symbol >> (self.width - 1 - k)) & 1 == 1
            a, b = bits.rank(first), bits.rank(end)
            first = np.where(one, self.zeros[k] + a, first - a)
            end = np.where(one, self.zeros[k] + b, end - b)
        return end - first

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        symbol, first = np.zeros_like(at), np.zeros_like(at)
        for k, bits in enumerate(self.levels):
            one = bits.get(at)
            a, b = bits.rank(first), bits.rank(at)
            first = np.where(one, self.zeros[k] + a, first - a)
            at = np.where(one, self.zeros[k] + b, at - b)
            symbol = symbol << 1 | one
        return symbol, at - first


class FMIndex:
    """Count and locate patterns in ``text``: symbols from 1 to ``symbols - 1``.

    It holds the wavelet matrix of the transform, the counts of symbols and every ``SAMPLE``-th position
    of the text, marked in a bit vector over the rows.
    """

    SAMPLE = 16

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)
        order = suffix_array(text)
        self.n = len(text)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.matrix = WaveletMatrix(text[order - 1], symbols)
        marked = order % self.SAMPLE == 0
        self.marked, self.positions = Bits(marked), order[marked].astype(np.int32)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [first, last) of each pattern, by backward search; shorter ones have zeros in front."""
        first = np.zeros(len(patterns), np.int64)
        last = np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, column]
            at = np.flatnonzero((symbol > 0) & (last > first))
            if not len(at):
                continue
            c = symbol[at]
            first[at] = self.below[c] + self.matrix.rank(c, first[at])
            last[at] = self.below[c] + self.matrix.rank(c, last[at])
        return first, last

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to a sampled position."""
        out = np.full(len(rows), -1, np.int64)
        at, row, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(at):
            known = self.marked.get(row)
            out[at[known]] = self.positions[self.marked.rank(row[known])] + steps
            at, row = at[~known], row[~known]
            symbol, before = self.matrix.symbol_and_rank(row)
            row = self.below[symbol] + before
            steps += 1
        return out
