"""Whole-batch text primitives: words, word hashes and rolling hashes as numpy arrays.

Everything works on the UTF-8 bytes of an Arrow string column, several documents at a
time, so that no Python code runs per word. A chunk holds whole documents only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SEQ_BASE = 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class _Powers:
    """Powers of an odd base mod 2**64 and of its inverse, made longer when needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * CHUNK_BYTES)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE & _MASK), _Powers(_SEQ_BASE & _MASK)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive runs of rows of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """The words of a chunk: byte ranges, owning row, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray, inside: np.ndarray) -> None:
        self.data, self.offsets = fold[data], offsets
        is_word = inside[self.data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = is_word[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = is_word[1:]
        before &= ~first[:-1]
        after &= ~first[1:]
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.bound = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bound)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word, of its bytes alone."""
        return mix(range_hash(byte_sums(self.data), self.start, self.end, _BYTES))


def byte_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _BYTES(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def byte_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, mixed with their lengths."""
    return mix(range_hash(sums, start, end, _BYTES) + (end - start).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def word_sums(hashes: np.ndarray) -> np.ndarray:
    up, _ = _WORDS(len(hashes) + 1)
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=out[1:], dtype=np.uint64)
    return out


def word_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, mixed with their lengths."""
    return mix(range_hash(sums, start, end, _WORDS) + (end - start).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    _, down = powers(len(sums))
    return (sums[end] - sums[start]) * down[start]
