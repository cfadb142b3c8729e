"""A compressed full-text index: Burrows-Wheeler transform, wavelet matrix, succinct bit vectors.

All queries work on arrays, many patterns at a time.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words with a count for each word; rank by population count."""

    def __init__(self, bits: np.ndarray) -> None:
        self.size = len(bits)
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))].astype(np.uint32)
        self.zeros = self.size - int(self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels = []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            self.levels.append(BitVector(bit))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before lo and before hi."""
        start = np.zeros_like(lo)
        for i, v in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            s, a, b = v.rank1(start), v.rank1(lo), v.rank1(hi)
            start, lo, hi = np.where(one, v.zeros + s, start - s), np.where(one, v.zeros + a, lo - a), np.where(one, v.zeros + b, hi - b)
        return lo - start, hi - start


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes by their first `depth` symbols or more (prefix doubling), and for each suffix the place of its first 2**k
    symbols among all such prefixes, with 2**k, the largest power of two below `depth` (1 at least).

    A suffix that ends sooner is smaller than one that goes on, and no other one has its place.
    """
    keep = 1 << max(0, (depth - 1).bit_length() - 1)
    _, rank = np.unique(symbols, return_inverse=True)
    have, kept = 1, rank
    while True:
        ahead = np.zeros_like(rank)
        if have < len(rank):
            ahead[:-have] = rank[have:] + 1
        key = rank * (len(rank) + 1) + ahead
        order = np.argsort(key, kind="stable")
        have *= 2
        sorted_ = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
        distinct = len(rank) and rank[order[-1]] == len(rank) - 1
        if have <= keep:
            kept = rank  # if all differ already, they differ by 2**k symbols too
        if have >= depth or distinct:
            return order, kept, keep


class FMIndex:
    """Index of a symbol sequence for patterns of up to `depth` symbols. Its last symbol is one that no pattern holds.

    Rows stand in the order of the first `depth` symbols that follow; a pattern of up to
    that many symbols has its rows together, as in a full suffix order.
    """

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.symbols, self.depth = symbols, depth
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.order, self.prefix, self.span = suffix_order(symbols, depth)
        last = symbols[self.order - 1]  # the row of the whole text wraps around to the last symbol
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=size))]
        self.wavelet = WaveletMatrix(last, max(1, (size - 1).bit_length()))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: rows [lo, hi) of patterns P to rows of symbol + P."""
        a, b = self.wavelet.rank(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b

    def shares(self, length: int) -> np.ndarray:
        """For each row whether it has `length` symbols in common with the row before it.

        Two overlapping prefixes of `span` symbols cover a longer one, so length is between span and twice that.
        """
        if length == 0:
            return np.ones(len(self.order), bool)
        above, row = np.r_[0, self.order[:-1]], self.order
        shift = length - self.span
        inside = np.maximum(above, row) + shift < len(self.symbols)
        last = len(self.symbols) - 1
        same = self.prefix[above] == self.prefix[row]
        same &= inside & (self.prefix[np.minimum(above + shift, last)] == self.prefix[np.minimum(row + shift, last)])
        same[:1] = False
        return same

    def intervals(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the first and end row of those that have its first `length` symbols: of a pattern that begins there, the rows [lo, hi) once it is cut to that length."""
        new = ~self.shares(length)
        new[:1] = True
        edges = np.r_[np.flatnonzero(new), len(new)]
        group = np.cumsum(new) - 1
        return edges[group], edges[group + 1]
