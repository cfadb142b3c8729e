"""External induced suffix sorting: suffixes in order, each with the prefix it shares with its neighbour.

Suffixes are L (larger than the one a symbol later) or S; those at left-most S positions (LMS) are
the seeds. From ordered seeds one ascending sweep induces all L suffixes and one descending
sweep all S suffixes: whatever is taken from the priority queue puts the suffix that starts a
symbol earlier back, as a tuple (symbol, order, position, common). `order` is the step of the
sweep that put it, which is the rank of its rest; `common` is one more than the least common
prefix of all steps since the last tuple of that symbol, so common prefixes are carried along and
no two suffixes are compared, but for the two where L meets S under one symbol.

The seeds are ordered by recursion: sweeps from unordered seeds order the substrings between them,
equal ones get one name, and the text of names, at most half as long, is sorted in the same way.
Once prefix doubling of a text of names fits in four times the budget, it ends the recursion.

Queues hold `budget` bytes and move the rest to disk as sorted runs that are merged again; texts,
types and names beyond the budget are memory-mapped files. Files are nameless, in the folders that
Spark gives its executors to spill to, and belong to one task.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that are taken from a queue, or read from a run, at once.
BLOCK = 1 << 15
#: What an entry of the heap costs beside its tuples.
_ENTRY = 256
Suffixes = Iterator[tuple[np.ndarray, np.ndarray]]


def _file():
    return tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)


def array(n: int, dtype, budget: int, fill: int = 0) -> np.ndarray:
    """An array in memory if it fits in the budget, in a memory-mapped file if not."""
    if n * np.dtype(dtype).itemsize <= budget:
        return np.full(n, fill, dtype)
    with _file() as file:
        out = np.memmap(file, dtype, "w+", shape=n)
    for lo in range(0, n, 1 << 20):
        out[lo : lo + (1 << 20)] = fill
    return out


class SuffixQueue:
    """Priority queue of tuples (symbol, order, position, common), the least symbol and order first.

    Tuples come in chunks of one symbol in rising order, and chunks of one symbol don't overlap.
    Beyond the budget the chunks in memory are written out as one sorted run.
    """

    def __init__(self, budget: int) -> None:
        self.heap, self.budget, self.held, self.count, self.file, self.spilled = [], budget, 0, 0, None, 0

    def _push(self, tuples: np.ndarray, run: list[int] | None) -> None:
        self.count += 1
        heapq.heappush(self.heap, (int(tuples[0, 0]), int(tuples[0, 1]), self.count, tuples, run))

    def put(self, tuples: np.ndarray) -> None:
        self._push(tuples, None)
        self.held += tuples.nbytes + _ENTRY
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or _file()
        mine = sorted(e for e in self.heap if e[4] is None)
        self.heap = [e for e in self.heap if e[4] is not None]
        heapq.heapify(self.heap)
        start = self.file.seek(0, 2)
        for e in mine:
            self.file.write(np.ascontiguousarray(e[3]).tobytes())
        self.spilled, self.held = self.spilled + 1, 0
        self._read([start, self.file.tell()])

    def _read(self, run: list[int]) -> None:
        self.file.seek(run[0])
        block = np.frombuffer(self.file.read(min(BLOCK * 32, run[1] - run[0])), np.int64).reshape(-1, 4)
        run[0] += block.nbytes
        if len(block):
            self._push(block, run)

    def least(self) -> int | None:
        return self.heap[0][0] if self.heap else None

    def take(self, symbol: int) -> np.ndarray:
        """The next tuples of a symbol, a block or a chunk more; none if there are no more of it now."""
        out, n = [], 0
        while self.heap and self.heap[0][0] == symbol and n < BLOCK:
            _, _, _, tuples, run = heapq.heappop(self.heap)
            if run is None:
                self.held -= tuples.nbytes + _ENTRY
            else:
                end = int(np.searchsorted(tuples[:, 0], symbol, "right"))
                if self.heap and self.heap[0][0] == symbol:
                    end = int(np.searchsorted(tuples[:end, 1], self.heap[0][1]))
                tuples, rest = tuples[:end], tuples[end:]
                if len(rest):
                    self._push(rest, run)
                else:
                    self._read(run)
            out.append(tuples)
            n += len(tuples)
        return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


class Tape:
    """Tuples written in order and read back from the end, on disk beyond the budget."""

    def __init__(self, budget: int) -> None:
        self.parts, self.held, self.budget, self.file, self.top = [], 0, budget, None, np.zeros((0, 4), np.int64)

    def write(self, tuples: np.ndarray) -> None:
        self.parts.append(tuples)
        self.held += tuples.nbytes + _ENTRY
        if self.held > self.budget:
            self.file = self.file or _file()
            self.file.seek(0, 2)
            for part in self.parts:
                self.file.write(part.tobytes())
            self.parts, self.held = [], 0

    def last(self) -> int | None:
        """Symbol of the last tuple that is left."""
        if not len(self.top):
            if self.parts:
                self.top = self.parts.pop()
            elif self.file and (size := self.file.seek(0, 2)):
                start = max(0, size - BLOCK * 32)
                self.file.seek(start)
                self.top = np.frombuffer(self.file.read(), np.int64).reshape(-1, 4)
                self.file.truncate(start)
        return int(self.top[-1, 0]) if len(self.top) else None

    def back(self, symbol: int) -> np.ndarray:
        """The last tuples, if they are of this symbol, in falling order."""
        if self.last() != symbol:
            return np.zeros((0, 4), np.int64)
        start = int(np.searchsorted(self.top[:, 0], symbol))
        self.top, out = self.top[:start], self.top[start:]
        return out[::-1]


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo] to values[hi], both included, of one block of values."""
    level, out = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1, np.zeros(len(lo), np.int64)
    for k in range(int(level.max(initial=-1)) + 1):
        of = np.flatnonzero(level == k)
        out[of] = np.minimum(values[lo[of]], values[hi[of] - (1 << k) + 1])
        values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


class Minima:
    """Least values of ranges of a large array, which may be a file: what is in memory at once doesn't grow with it.

    Whole blocks of a range are looked up in a table of the least values of 1, 2, 4, ... blocks in a row, which is a file too if it is
    large, of about log2(n) / 32 numbers for each value; the ends of a range, a block at most each, are read from the values.
    """

    SIDE = 32

    def __init__(self, values: np.ndarray, budget: int) -> None:
        self.values, side = values, self.SIDE
        table = array(-(-len(values) // side), np.int64, budget)
        for lo in range(0, len(table), BLOCK):
            part = np.asarray(values[lo * side : (lo + BLOCK) * side])
            table[lo : lo + BLOCK] = np.minimum.reduceat(part, np.arange(0, len(part), side))
        self.tables, have = [table], 1
        while 2 * have <= len(self.tables[0]):
            last, table = table, array(len(table) - have, np.int64, budget)
            for lo in range(0, len(table), BLOCK):
                hi = min(lo + BLOCK, len(table))
                table[lo:hi] = np.minimum(last[lo:hi], last[lo + have : hi + have])
            self.tables.append(table)
            have *= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of values[lo] to values[hi], both included."""
        out, side = np.minimum(self.values[lo], self.values[hi]), self.SIDE
        ahead, back = np.minimum(hi, lo | (side - 1)), np.maximum(lo, hi & -side)
        for step in range(1, side):
            out = np.minimum(out, np.minimum(self.values[np.minimum(lo + step, ahead)], self.values[np.maximum(hi - step, back)]))
        a, b = lo // side + 1, hi // side
        level = np.frexp(np.maximum(b - a, 0).astype(np.float64))[1] - 1  # -1 where no block is whole
        for k in np.unique(level[level >= 0]):
            of = np.flatnonzero(level == k)
            out[of] = np.minimum(out[of], np.minimum(self.tables[k][a[of]], self.tables[k][b[of] - (1 << int(k))]))
        return out


class Sweep:
    """Takes suffixes in order and puts those of one type that start a symbol earlier in a queue."""

    def __init__(self, text: Text, s_type: bool, queue: SuffixQueue) -> None:
        self.text, self.s_type, self.queue, self.at = text, s_type, queue, 0
        self.before = np.full(text.depth + 2, -3)  # for each length, the last step with that common prefix or a shorter one
        self.seen = array(text.symbols, np.int64, text.budget, -2)  # the last step that put a tuple of the symbol

    def step(self, position: np.ndarray, common: np.ndarray) -> None:
        text, p = self.text, position - 1
        of = np.flatnonzero((p >= 0) & (text.is_s[p] == self.s_type))
        if len(of):
            symbol = text.data[p[of]].astype(np.int64)
            by = np.argsort(symbol, kind="stable")
            of, symbol = of[by], symbol[by]
            first = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
            end = np.r_[first[1:], len(of)]
            later = np.ones(len(of), bool)
            later[first] = False
            later = np.flatnonzero(later)
            least = np.zeros(len(of), np.int64)
            least[later] = range_min(common, of[later - 1] + 1, of[later])
            seen = self.seen[symbol[first]]
            least[first] = np.minimum(np.searchsorted(self.before, seen, "right"), np.minimum.accumulate(common)[of[first]])
            grown = np.where(least > text.depth, least, np.minimum(least + 1, text.depth))
            grown[first[seen == -2]] = 0
            self.seen[symbol[first]] = self.at + of[end - 1]
            tuples = np.column_stack((-symbol if self.s_type else symbol, self.at + of, p[of], grown))
            for a, b in zip(first, end, strict=True):
                self.queue.put(tuples[a:b])
        now = np.full(text.depth + 2, -3)
        now[common] = self.at + np.arange(len(common))
        self.before = np.maximum(self.before, np.maximum.accumulate(now))
        self.at += len(common)


class Text:
    """One level of the recursion: symbols, types, and the length from which common prefixes count as alike."""

    def __init__(self, data: np.ndarray, symbols: int, depth: int, budget: int) -> None:
        self.data, self.symbols, self.depth, self.budget, self.n = data, symbols, depth, budget, len(data)
        self.is_s = array(self.n, bool, budget)
        symbol, s_type = -1, False
        for hi in range(self.n, 0, -BLOCK):
            lo = max(0, hi - BLOCK)
            here = data[lo:hi].astype(np.int64)
            ahead = np.r_[here[1:], symbol]
            change = np.where(here != ahead, np.arange(hi - lo), hi - lo)
            change = np.minimum.accumulate(change[::-1])[::-1]
            self.is_s[lo:hi] = np.where(change < hi - lo, (here < ahead)[np.minimum(change, hi - lo - 1)], s_type)
            symbol, s_type = here[0], self.is_s[lo]

    def is_lms(self, position: np.ndarray) -> np.ndarray:
        return (position > 0) & self.is_s[position] & ~self.is_s[position - 1]

    def places(self) -> np.ndarray:
        found = lambda lo: (at := np.arange(lo, min(lo + BLOCK, self.n)))[self.is_lms(at)]
        out = array(sum(len(found(lo)) for lo in range(0, self.n, BLOCK)), np.int64, self.budget)
        at = 0
        for lo in range(0, self.n, BLOCK):
            part = found(lo)
            out[at : at + len(part)] = part
            at += len(part)
        return out

    def common_prefix(self, a: int, b: int) -> int:
        size = min(self.depth, self.n - max(a, b))
        unlike = self.data[a : a + size] != self.data[b : b + size]
        return int(np.argmax(unlike)) if unlike.any() else size

    def _grown(self, p: np.ndarray, q: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Common prefixes from lower bounds, which are short only where a substring ends inside a run of the other."""
        live, far = np.flatnonzero(p != q), np.maximum(p, q)
        while len(live := live[(common[live] < self.depth) & (far[live] + common[live] < self.n)]):
            live = live[self.data[p[live] + common[live]] == self.data[q[live] + common[live]]]
            common[live] += 1
        return common

    def seed(self, seeds: SuffixQueue, position: np.ndarray, order: np.ndarray, common: np.ndarray) -> None:
        symbol = self.data[position].astype(np.int64)
        by = np.lexsort((order, symbol))
        tuples = np.column_stack((symbol, order, position, common))[by]
        edge = np.flatnonzero(np.r_[True, tuples[1:, 0] != tuples[:-1, 0]])
        for a, b in zip(edge, np.r_[edge[1:], len(by)], strict=True):
            seeds.put(tuples[a:b])

    def induced(self, seeds: SuffixQueue) -> Suffixes:
        """Suffixes in falling order, each with its common prefix with the one before (larger)."""
        queue, large = SuffixQueue(self.budget), Tape(self.budget)
        sweep = Sweep(self, False, queue)
        end = int(self.data[self.n - 1])
        queue.put(np.array([[end, -1, self.n - 1, 0]]))
        sweep.seen[end] = -1
        while (some := [c for c in (queue.least(), seeds.least()) if c is not None]):
            symbol, previous = min(some), None
            while len(batch := queue.take(symbol)):
                large.write(batch)
                sweep.step(batch[:, 2], batch[:, 3])
                previous = int(batch[-1, 2])
            meets = True
            while len(batch := seeds.take(symbol)):
                common = batch[:, 3].copy()
                if meets:
                    if previous is None:
                        common[0] = 0
                    elif common[0] > self.depth:  # unordered seeds: what follows the symbol differs from one to the next
                        common[0] = 1
                    else:
                        common[0] = self.common_prefix(previous, int(batch[0, 2]))
                    meets = False
                sweep.step(batch[:, 2], common)
        queue = SuffixQueue(self.budget)
        sweep = Sweep(self, True, queue)
        while (some := [c for c in (None if queue.least() is None else -queue.least(), large.last()) if c is not None]):
            symbol, previous = max(some), None
            while len(batch := queue.take(-symbol)):
                yield batch[:, 2], batch[:, 3]
                sweep.step(batch[:, 2], batch[:, 3])
                previous = int(batch[-1, 2])
            carried = None
            while len(batch := large.back(symbol)):
                if carried is None:
                    carried = 0 if previous is None else self.common_prefix(previous, int(batch[0, 2]))
                common = np.r_[carried, batch[:-1, 3]]
                yield batch[:, 2], common
                sweep.step(batch[:, 2], common)
                carried = int(batch[-1, 3])

    def suffixes(self) -> Suffixes:
        """All suffixes, induced from their ordered LMS suffixes."""
        places, seeds = self.places(), SuffixQueue(self.budget)
        if len(places):
            previous, order = None, len(places) - 1
            for position, common in self._ordered(places):
                if previous is not None:
                    position, common = np.r_[previous, position], common
                else:
                    common = common[1:]
                # falling order, with the prefix shared with the next smaller one
                if len(common):
                    self.seed(seeds, position[:-1], order - np.arange(len(common)), common)
                    order -= len(common)
                previous = position[-1]
            self.seed(seeds, np.array([previous]), np.array([0]), np.array([0]))
        return self.induced(seeds)

    def _ordered(self, places: np.ndarray) -> Suffixes:
        """LMS suffixes in falling order with their common prefixes, by names and recursion."""
        seeds, alike = SuffixQueue(self.budget), self.depth + 1
        for lo in range(0, len(places), BLOCK):
            part = np.asarray(places[lo : lo + BLOCK])
            self.seed(seeds, part, part, np.full(len(part), alike))
        names, shared = array(len(places), np.int64, self.budget), array(len(places), np.int64, self.budget)
        count, least = 0, 0
        for position, common in self.induced(seeds):
            of = np.flatnonzero(self.is_lms(position))
            if not len(of):
                least = min(least, int(common.min()))
                continue
            between = np.minimum.reduceat(common[: of[-1] + 1], np.r_[0, of[:-1] + 1])
            between[0] = min(between[0], least)
            new = between <= self.depth
            name = count - 1 + np.cumsum(new)
            names[np.searchsorted(places, position[of])] = name
            shared[name[new]] = between[new]
            count = int(name[-1]) + 1
            least = int(common[of[-1] + 1 :].min(initial=alike))
        for lo in range(0, len(names), BLOCK):  # larger names for larger substrings
            names[lo : lo + BLOCK] = count - 1 - names[lo : lo + BLOCK]
        depth = self.depth // 2 + 1
        if len(names) * 8 * (int(depth).bit_length() + 6) <= 4 * self.budget:
            found = doubled(names, depth)
        else:
            found = Text(names, count, depth, self.budget).suffixes()
        shared, previous = Minima(shared[:count], self.budget), 0
        for at, same in found:
            before = np.r_[previous, at[:-1]]
            previous = at[-1]
            common = np.full(len(at), self.depth)
            of = np.flatnonzero(same < depth)
            a, b, same = before[of], at[of], same[of]
            a, b = (np.minimum(x + same, len(names) - 1) for x in (a, b))
            left, right = count - 1 - names[a], count - 1 - names[b]
            unlike = left < right  # all but the very first, which has none before
            more = np.zeros(len(of), np.int64)
            more[unlike] = shared.least(left[unlike] + 1, right[unlike])
            more = np.minimum(places[b] - places[at[of]] + more, self.depth)
            common[of] = self._grown(places[before[of]], places[at[of]], more)
            yield np.asarray(places[at]), common


def doubled(text: np.ndarray, depth: int) -> Suffixes:
    """The same for a text in memory, by prefix doubling."""
    n, rank, have = len(text), np.asarray(text), 1
    ranks = [rank]
    while have < depth and have < n:
        key = rank * (n + 1)
        key[:-have] += rank[have:] + 1
        order = np.argsort(key, kind="stable")
        new = np.r_[0, key[order][1:] != key[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks.append(rank)
        have *= 2
        if new.sum() == n - 1:
            break
    order = np.argsort(rank, kind="stable")[::-1]
    a, b, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in reversed(range(len(ranks))):
        inside = np.maximum(a, b) + common < n
        i, j = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += (inside & (ranks[k][i] == ranks[k][j])).astype(np.int64) << k
    yield order, np.r_[0, np.minimum(common, depth)]


def suffixes(data: np.ndarray, symbols: int, depth: int, budget: int = 64 << 20) -> Suffixes:
    """Blocks of (positions, common): the suffixes of data in falling order of their first `depth`
    symbols or more, and how many symbols each shares with the one before, `depth` at most."""
    return Text(data, symbols, depth, budget).suffixes() if len(data) else iter(())
