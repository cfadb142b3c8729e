"""Anchored segments: linear-size routing of all equal windows of a corpus to the same place.

A window is `width` consecutive symbols (words or bytes) of one document. Its anchor is its
least k-gram in a global order, rare k-grams first; equal windows have equal anchors.
Consecutive windows with the same anchor form a segment. Putting rare k-grams first matters:
where a passage is common to many documents, windows that reach out of it take a rarer
anchor, and the segments that are left inside are the same in all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshgrain.llm.common import Batches, bloom, levels, order_keys, sketch, stash
from meshgrain.llm.words import KEEP, NOT_SPACE, Words, byte_hash, byte_sums, chunks, mix, word_hash, word_sums

#: A longer run of windows is cut; a segment then holds at most this many windows.
MOST_WINDOWS = 1024
_POSITION = np.uint64(24)


@dataclass(frozen=True)
class Alphabet:
    """What a symbol is: `read` gives symbol bounds of rows, prefix sums for hashing, and the symbols as 64-bit values."""

    name: str
    gram: int
    width: int

    def read(self, data: np.ndarray, offsets: np.ndarray):
        if self.name == "word":
            words = Words(data, offsets, KEEP, NOT_SPACE)
            symbols = words.hashes()
            return words.bound, word_sums(symbols), word_hash, symbols
        return offsets, byte_sums(data), byte_hash, data


def grams(column: pa.Array, kind: Alphabet) -> Iterator[np.ndarray]:
    for _, _, data, offsets in chunks(column):
        bound, sums, hashed, _ = kind.read(data, offsets)
        at = _starts(bound, kind.gram)
        yield hashed(sums, at, at + kind.gram)


def _starts(bound: np.ndarray, length: int) -> np.ndarray:
    """First symbols of all runs of `length` symbols inside one row."""
    count = np.maximum(np.diff(bound) - length + 1, 0)
    return np.repeat(bound[:-1] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def _least(keys: np.ndarray, m: int) -> np.ndarray:
    """Least value of every m consecutive ones."""
    out, have = keys, 1
    while 2 * have <= m:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return out if have == m else np.minimum(out[: len(keys) - m + 1], out[m - have :][: len(keys) - m + 1])


@dataclass
class Segments:
    row: np.ndarray  # row in the chunk
    at: np.ndarray  # first window, as a symbol number in the chunk
    windows: np.ndarray
    anchor: np.ndarray
    content: np.ndarray  # hash of all symbols the windows cover


def segments(data: np.ndarray, offsets: np.ndarray, kind: Alphabet, level: np.ndarray):
    """(Segments of a chunk, symbol bounds of rows, symbols)."""
    bound, sums, hashed, symbols = kind.read(data, offsets)
    total = int(bound[-1])
    start = _starts(bound, kind.width)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.view(np.uint64), none.view(np.uint64)), bound, symbols
    at = np.arange(total - kind.gram + 1)
    keys = order_keys(hashed(sums, at, at + kind.gram), level)
    where = (keys >> _POSITION << _POSITION) | (at.astype(np.uint64) & np.uint64((1 << 24) - 1))
    least = _least(where, kind.width - kind.gram + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
    run = np.cumsum(new) - 1
    place = np.arange(len(start)) - np.flatnonzero(new)[run]
    new |= place % MOST_WINDOWS == 0
    first = np.flatnonzero(new)
    windows = np.diff(np.r_[first, len(start)])
    s = start[first]
    # the anchor itself: the position bits are only good to 24 bits, so find it from the window
    base = s + ((least[first] - s.astype(np.uint64)) & np.uint64((1 << 24) - 1)).astype(np.int64)
    row = np.searchsorted(bound, s, "right") - 1
    return Segments(row, s, windows, keys[base], hashed(sums, s, s + windows + kind.width - 1)), bound, symbols


def _representative(anchor: np.ndarray, content: np.ndarray, uid: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(mix(mix(anchor.view(np.uint64)) ^ content.view(np.uint64)) ^ uid.view(np.uint64)) ^ mix(at.view(np.uint64))


@dataclass
class Routed:
    """segments: uid, doc_id, anchor, content, at, windows. classes: segments with the same
    content, with the first of them and, if asked for, whether its document has them `again`. texts: symbols of first segments whose anchor has other contents too."""

    segments: DataFrame
    classes: DataFrame
    texts: DataFrame


def route(docs: DataFrame, kind: Alphabet, again: bool = False) -> Routed:
    """docs: uid, doc_id, text, none null but text."""
    spark = docs.sparkSession
    level = spark.sparkContext.broadcast(levels(sketch(docs.select("text"), lambda b: grams(b["text"], kind))))

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            uid, doc = batch["uid"].to_numpy(), batch["doc_id"].to_numpy()
            for lo, _, data, offsets in chunks(batch["text"]):
                s, bound, _ = segments(data, offsets, kind, level.value)
                yield pa.record_batch({"uid": pa.array(uid[lo + s.row]), "doc_id": pa.array(doc[lo + s.row]), "anchor": pa.array(s.anchor.view(np.int64)), "content": pa.array(s.content.view(np.int64)), "at": pa.array(s.at - bound[s.row]), "windows": pa.array(s.windows.astype(np.int32))})

    made = stash(docs.mapInArrow(cut, "uid long, doc_id long, anchor long, content long, at long, windows int"))
    first = F.min(F.struct("doc_id", "uid", "at"))
    found, columns = [first.alias("first"), F.count("*").alias("n")], ["anchor", "content", "n", "first.doc_id", "first.uid", "first.at"]
    if again:  # the last segment of the least document: doc_id turned round, as it may be any number
        last = F.max(F.struct(F.bitwise_not("doc_id").alias("turned"), "uid", "at"))
        found.append(last.alias("last"))
        columns.append(F.expr("last.uid <> first.uid or last.at <> first.at").alias("again"))
    classes = stash(made.groupBy("anchor", "content").agg(*found).select(*columns))
    several = stash(classes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"))
    # what a filter lets pass beyond these is a text alone in its anchor, which changes nothing
    wanted = bloom(classes.mapInArrow(_keyed(bloom(several, "anchor")), "key long"), "key")

    def fetch(batches: Batches) -> Batches:
        for batch in batches:
            uid, doc = batch["uid"].to_numpy(), batch["doc_id"].to_numpy()
            for lo, _, data, offsets in chunks(batch["text"]):
                s, bound, symbols = segments(data, offsets, kind, level.value)
                at, u = s.at - bound[s.row], uid[lo + s.row]
                keep = np.flatnonzero(wanted.value.has(_representative(s.anchor, s.content, u, at).view(np.int64)))
                raw = [symbols[a : a + w + kind.width - 1].tobytes() for a, w in zip(s.at[keep], s.windows[keep], strict=True)]
                yield pa.record_batch({"uid": pa.array(u[keep]), "doc_id": pa.array(doc[lo + s.row[keep]]), "anchor": pa.array(s.anchor[keep].view(np.int64)), "content": pa.array(s.content[keep].view(np.int64)), "at": pa.array(at[keep]), "symbols": pa.array(raw, pa.binary())})

    return Routed(made, classes, docs.mapInArrow(fetch, "uid long, doc_id long, anchor long, content long, at long, symbols binary"))


def _keyed(anchors):
    def keys(batches: Batches) -> Batches:
        for batch in batches:
            batch = batch.filter(pa.array(anchors.value.has(batch["anchor"].to_numpy())))
            cols = [batch[c].to_numpy() for c in ("anchor", "content", "uid", "at")]
            yield pa.record_batch({"key": pa.array(_representative(*cols).view(np.int64))})

    return keys


def sharded(texts: DataFrame, solve: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Runs `solve` on shards: all texts of an anchor stand in one, and a shard holds about most_bytes unless one anchor has more.

    Spark sorts by anchor, spilling as it must, so that a worker holds one shard, not a partition.
    """

    def run(batches: Batches) -> Batches:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch["anchor"].to_numpy()
            ends = np.r_[0, np.cumsum(pc.binary_length(batch["symbols"]).to_numpy(zero_copy_only=False).astype(np.int64))]
            edges = np.flatnonzero(np.r_[bool(held) and anchor[0] != last, anchor[1:] != anchor[:-1]])
            done = 0
            for edge in edges:
                if size + ends[edge] - ends[done] >= most_bytes:
                    yield from solve(pa.Table.from_batches([*held, batch.slice(done, edge - done)]))
                    held, size, done = [], 0, edge
            held.append(batch.slice(done))
            size, last = size + ends[-1] - ends[done], anchor[-1]
        if held:
            yield from solve(pa.Table.from_batches(held))

    return texts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, schema)


def covered(parts: DataFrame) -> DataFrame:
    """uid and the sorted, merged runs of symbols [start, end) of its rows (uid, start, end)."""
    before = Window.partitionBy("uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)
    runs = parts.withColumn("new", new).withColumn("run", F.sum("new").over(Window.partitionBy("uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("uid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def marked(table: pa.Table, hit: np.ndarray, bounds: np.ndarray, width: int, *columns: str) -> pa.RecordBatch:
    """(uid, start, end) of runs of hit windows, with more columns of their texts; bounds: first window of each text of the table in `hit`."""
    step = np.diff(np.r_[False, hit, False].astype(np.int8))
    # runs may not go on from one text to the next
    edge = np.zeros(len(hit) + 1, bool)
    edge[bounds] = True
    up = np.flatnonzero((step == 1) | (edge & np.r_[hit, False]))
    down = np.flatnonzero((step == -1) | (edge & np.r_[False, hit]))
    text = np.searchsorted(bounds, up, "right") - 1
    at = table["at"].to_numpy()[text] - bounds[text]
    return pa.record_batch({"uid": pa.array(table["uid"].to_numpy()[text]), "start": pa.array(at + up), "end": pa.array(at + down + width - 1)} | {c: pa.array(table[c].to_numpy()[text]) for c in columns})
