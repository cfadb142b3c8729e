"""Deterministic draws: every random number is a pure function of a seed and of the entities it is for."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


def draw(*parts: Column | str | int) -> Column:
    """A whole number in [0, 2**52): the leading bits of the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1)."""
    return draw(*parts) / F.lit(float(1 << 52))


def below(n: Column | int, *parts: Column | str | int) -> Column:
    """A whole number in [0, n)."""
    return F.pmod(draw(*parts), n if isinstance(n, Column) else F.lit(n))


#: Fixed values of MD5: its state, the order of message words and the rotations in each of four rounds, and what each step adds.
MD5_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_ORDER = (*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16)))
MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_ADDS = tuple(int(abs(math.sin(i + 1)) * 2**32) for i in range(64))


def md5_starts(words: Sequence[np.ndarray | int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two 32-bit words of the MD5 of messages of one block, given as 16 little-endian words, many messages at once."""
    a, b, c, d = (np.full(rows, x, np.uint32) for x in MD5_STATE)
    f, t = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word, by = words[MD5_ORDER[i]], MD5_TURNS[i // 16][i % 4]
        if isinstance(word, np.ndarray):
            f += np.uint32(MD5_ADDS[i])
            f += word
        else:
            f += np.uint32((MD5_ADDS[i] + word) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(by), out=t)
        f >>= np.uint32(32 - by)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + np.uint32(MD5_STATE[0]), b + np.uint32(MD5_STATE[1])


#: Numbers below 10000 as ASCII, the first digit in the lowest byte: with leading zeros, or after a colon without them, and bytes of that.
_FOUR = np.array([int.from_bytes(b"%04d" % i, "little") for i in range(10000)], np.uint64)
_OPEN = np.array([int.from_bytes(b":%d" % i, "little") for i in range(10000)], np.uint64)
_OPEN_SIZE = np.array([len(":%d" % i) for i in range(10000)], np.uint64)


class Draws:
    """`draw` of texts that differ in whole numbers only, head:number:number, many at once in numpy.

    Texts are kept as the words of one MD5 block. Where a number is null or negative, or a text doesn't fit in one
    block, all of them go through hashlib one by one.
    """

    def __init__(self, head: str, *numbers: pd.Series | np.ndarray):
        series = [pd.Series(x) for x in numbers]
        self.rows = len(series[0])
        self.texts = None
        room = 55 - 5 - len(head.encode()) - sum(1 + len(str(x.max())) for x in series if self.rows)
        if room < 0 or any(x.isna().any() or (x < 0).any() for x in series):
            self.texts = np.array([":".join([head, *(str(int(v)) for v in row if not pd.isna(v))]) for row in zip(*series, strict=True)], object)
            return
        known = head.encode().ljust(56, b"\0")
        self.words: list[np.ndarray | int] = [int.from_bytes(known[i : i + 4], "little") for i in range(0, 56, 4)]
        self.end = np.full(self.rows, len(head.encode()), np.uint64)
        for x in series:
            self._number(x.to_numpy(np.int64))

    def _put(self, words: list, piece: np.ndarray, at: np.ndarray) -> None:
        """Writes up to 5 bytes of each text, the first in the lowest byte, at its place."""
        word, moved = at >> np.uint64(2), piece << ((at & np.uint64(3)) << np.uint64(3))
        low, high = moved.astype(np.uint32), (moved >> np.uint64(32)).astype(np.uint32)
        first, last = (int(word.min()), int(word.max())) if self.rows else (0, -1)
        for w in range(first, last + 2):
            if first == last:
                add = low if w == first else high
            else:
                add = low * (word == np.uint64(w)) + high * (word + np.uint64(1) == np.uint64(w))
            words[w] = (words[w] if isinstance(words[w], np.ndarray) else np.uint32(words[w])) | add

    def _number(self, x: np.ndarray) -> None:
        """Appends a colon and a number to each text, four digits at a time."""
        limbs = []
        while x.max(initial=0) >= 10000:
            above = x // 10000
            limbs.append(x - above * 10000)
            x = above
        limbs.append(x)
        begun = None  # texts that have digits of this number
        for i, limb in enumerate(reversed(limbs)):
            piece, size = _OPEN[limb], _OPEN_SIZE[limb]
            if i < len(limbs) - 1:
                piece, size = piece * (limb > 0), size * (limb > 0)
            if begun is not None:
                piece, size = np.where(begun, _FOUR[limb], piece), np.where(begun, np.uint64(4), size)
            self._put(self.words, piece, self.end)
            self.end = self.end + size
            begun = limb > 0 if begun is None else begun | (limb > 0)

    def at(self, tail: int | None = None) -> np.ndarray:
        """The draw of each text, or of text:tail, as a double in [0, 1)."""
        if self.texts is not None:
            more = "" if tail is None else f":{tail}"
            bits = [int(hashlib.md5((t + more).encode(), usedforsecurity=False).hexdigest()[:DIGITS], 16) for t in self.texts]
            return np.array(bits, np.float64) / float(1 << 52)
        x, y = (w.byteswap().astype(np.uint64) for w in md5_starts(self.block(tail), self.rows))
        return ((x << np.uint64(20)) | (y >> np.uint64(12))).astype(np.float64) / float(1 << 52)

    def block(self, tail: int | None = None) -> list[np.ndarray | int]:
        """The MD5 block of each text, or of text:tail."""
        last = (b"" if tail is None else b":%d" % tail) + b"\x80"
        words = [*self.words, 0, 0]
        self._put(words, np.full(self.rows, int.from_bytes(last, "little"), np.uint64), self.end)
        words[14] = ((self.end + np.uint64(len(last) - 1)) << np.uint64(3)).astype(np.uint32)
        return words

    def below(self, n: int) -> np.ndarray:
        """As `below`: a whole number in [0, n) for each text."""
        return (self.at() * (1 << 52)).astype(np.int64) % n

    def keep(self, mask: np.ndarray) -> None:
        """Leaves only some of the texts."""
        self.rows = int(mask.sum())
        if self.texts is not None:
            self.texts = self.texts[mask]
            return
        self.words = [w[mask] if isinstance(w, np.ndarray) else w for w in self.words]
        self.end = self.end[mask]


class CrossedDraws:
    """Draws of head:a:b for pairs of two lists of whole numbers. Parts of texts are made once for each number, not for each pair."""

    def __init__(self, head: str, a: np.ndarray, b: np.ndarray):
        self.head, self.a, self.b = head, a, b
        before = Draws(head, a)
        self.plain = before.texts is not None or Draws(head, a[:1].repeat(len(b)), b).texts is not None or len(head) + len(str(a.max(initial=0))) + len(str(b.max(initial=0))) > 45
        if not self.plain:
            self.left, self.end = [*before.words, 0, 0], before.end
            self.right = {end: Draws("\0" * int(end), b).block() for end in np.unique(self.end)}  # by where the second number begins

    def rare(self, i: np.ndarray, j: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """(which, draw): the pairs of a[i] and b[j] whose draw is below `most`."""
        if self.plain or not len(i):
            u = Draws(self.head, self.a[i], self.b[j]).at()
            return np.nonzero(u < most)[0], u[u < most]
        which, draws, ends = [], [], self.end[i]
        for end in [ends[0]] if (ends == ends[0]).all() else np.unique(ends):
            part = np.nonzero(ends == end)[0]
            p, q = i[part], j[part]
            words: list[np.ndarray | int] = []
            for x, y in zip(self.left, self.right[end], strict=True):
                x, y = (v[r] if isinstance(v, np.ndarray) else v for v, r in ((x, p), (y, q)))
                words.append(x | y if isinstance(x, np.ndarray) and isinstance(y, np.ndarray) else x | np.uint32(y) if isinstance(x, np.ndarray) else y | np.uint32(x) if isinstance(y, np.ndarray) else x | y)
            x, y = md5_starts(words, len(part))
            x = x.byteswap()
            low = np.nonzero(x <= np.uint32(min(most * 2.0**32, 2.0**32 - 1)))[0]
            u = ((x[low].astype(np.uint64) << np.uint64(20)) | (y[low].byteswap().astype(np.uint64) >> np.uint64(12))).astype(np.float64) / float(1 << 52)
            which.append(part[low][u < most])
            draws.append(u[u < most])
        return np.concatenate(which), np.concatenate(draws)


_MASK = (1 << 64) - 1

#: Fixed values of BLAKE2b: the first words of its state, the order of message words in each round, and its rotations.
IV = (
    0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1,
    0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179,
)
SIGMA = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15),
    (14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3),
    (11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4),
    (7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8),
    (9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13),
    (2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9),
    (12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11),
    (13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10),
    (6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5),
    (10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0),
)
ROTATIONS = ((32, 24), (16, 63))
ROUNDS = 12


def half_steps() -> list[tuple[int, int, int, int, int, int, int]]:
    """(a, b, c, d, word, r, s) of all rounds in turn: a += b + word; d = (d ^ a) >>> r; c += d; b = (b ^ c) >>> s. Columns of the 4 by 4 state come first, then diagonals."""
    mixed = [tuple(4 * row + (column + row * shift) % 4 for row in range(4)) for shift in (0, 1) for column in range(4)]
    return [(*cells, SIGMA[n % 10][2 * k + half], *ROTATIONS[half]) for n in range(ROUNDS) for k, cells in enumerate(mixed) for half in (0, 1)]


def blake2b_64(words: Sequence[np.ndarray | int], size: int) -> np.ndarray:
    """The first 64 bits of the 8-byte BLAKE2b of messages of `size` bytes, one block at most, given as little-endian 64-bit words, many messages at once."""
    rows = max(np.size(w) for w in words)
    message = [np.broadcast_to(np.asarray(w, np.uint64), rows) for w in words]
    start = [IV[0] ^ 0x01010008, *IV[1:]]  # parameters: 8 bytes out, no key
    last = [*IV[:4], IV[4] ^ size, IV[5], IV[6] ^ _MASK, IV[7]]
    v = [np.full(rows, x, np.uint64) for x in (*start, *last)]
    turn = lambda x, by: (x >> np.uint64(by)) | (x << np.uint64(64 - by))
    for a, b, c, d, w, r, s in half_steps():
        v[a] = v[a] + v[b] + message[w] if w < len(message) else v[a] + v[b]
        v[d] = turn(v[d] ^ v[a], r)
        v[c] = v[c] + v[d]
        v[b] = turn(v[b] ^ v[c], s)
    return np.uint64(start[0]) ^ v[0] ^ v[8]


def _words(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def keyed_ints(seed: int, source: pd.Series, population: int, version: int, salt: pd.Series, domain: int) -> np.ndarray:
    """64-bit BLAKE2b of the little-endian fields <4Q2I> (seed, source, population, version, salt, domain)."""
    tail = (_words(salt) & np.uint64(0xFFFFFFFF)) | np.uint64(domain << 32)
    return blake2b_64([seed & _MASK, _words(source), population & _MASK, version & _MASK, tail], 40)


def keyed_target(source: Column, salt: Column, n: int, seed: int, population: int, version: int = 0) -> Column:
    """Target in [0, n) of a source's salt-th synapse, as an Arrow-batched function."""

    @F.pandas_udf(LongType())
    def fold(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series((keyed_ints(seed, s, population, version, k, 0) % np.uint64(n)).astype(np.int64))

    return fold(source.cast("long"), salt.cast("long"))


def keyed_uniform(source: Column, salt: Column, seed: int, population: int, version: int = 0) -> Column:
    """Double in [0, 1] of a source and salt, as an Arrow-batched function."""

    @F.pandas_udf(DoubleType())
    def scaled(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(keyed_ints(seed, s, population, version, k, 1).astype(np.float64) / 2.0**64)

    return scaled(source.cast("long"), salt.cast("long"))


def virtual_ids(module: Column, lineage: Column, generation: Column, index: Column, seed: int) -> Column:
    """64-bit BLAKE2b of the little-endian fields <5Q> (seed, module, lineage, generation, index), as a decimal of 20 digits."""

    @F.pandas_udf(LongType())
    def made(m: pd.Series, li: pd.Series, g: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(blake2b_64([seed & _MASK, *map(_words, (m, li, g, i))], 40).view(np.int64))

    bits = made(*(c.cast("long") for c in (module, lineage, generation, index)))
    return F.when(bits < 0, bits.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(bits.cast("decimal(20,0)")).cast("decimal(20,0)")
