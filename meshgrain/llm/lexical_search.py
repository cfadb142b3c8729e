"""Ranked lexical search turned round: the few queries are indexed and the documents are streamed through.

1. The terms of the items are numbered. Each document's words are looked up among them, which leaves its length and
   the counts of item terms it holds; their totals over all documents give N, L and the document frequencies.
2. An inverted index over the items (term to items, with repeats) and the terms' weights are broadcast. Every document's term counts
   go through it, which adds up the document's score for each item it shares a term with; a task keeps a bounded
   heap for each item and gives out its heaps once.
3. The tasks' heaps are merged by a window over each item.

An index holds BLOCK_TERMS terms of items at most; more items are searched in blocks, each of them against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshgrain.llm.common import Batches, stash
from meshgrain.llm.words import ALNUM, CHUNK_BYTES, LOWER, Words, chunks

#: Terms of items, repeats included, in one broadcast index (about 40 MB), and cells of a score table at a time.
BLOCK_TERMS, CELLS = 1_000_000, 1 << 20


def terms_of(column: pa.Array) -> Iterator[tuple[int, int, Words, pa.Array]]:
    """(first row, end row, words, the words as an Arrow array) of runs of rows: maximal runs of letters, digits and signs beyond ASCII, A-Z lower-cased."""
    for at, end, data, offsets in chunks(column, CHUNK_BYTES):
        words = Words(data, offsets, LOWER, ALNUM)
        sizes = np.r_[0, np.cumsum(words.end - words.start)]
        inside = words.data[ALNUM[words.data]]
        yield at, end, words, pa.Array.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(inside)])


class Index:
    """Items as postings: for each term the items that hold it and how often. items: (number, text)."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.numbers = np.array([n for n, _ in items], np.int64)
        number: dict[bytes, int] = {}
        held: dict[tuple[int, int], int] = {}
        for at, end, words, terms in terms_of(pa.array([t for _, t in items], pa.string())):
            for row, term in zip((words.row + at).tolist(), terms.to_pylist(), strict=True):
                key = (number.setdefault(term, len(number)), row)
                held[key] = held.get(key, 0) + 1
        self.terms = pa.array(list(number), pa.large_binary())
        postings = np.array([(t, i, n) for (t, i), n in sorted(held.items())], np.int64).reshape(-1, 3)
        self.item, self.times = postings[:, 1], postings[:, 2]
        self.start = np.searchsorted(postings[:, 0], np.arange(len(number) + 1))

    def scores(self, rows: np.ndarray, terms: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
        """A table of n documents by items: for each (row, term) its part of the score, once for each time an item holds the term."""
        many = self.start[terms + 1] - self.start[terms]
        each = np.repeat(np.arange(len(terms)), many)
        at = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + self.start[terms][each]
        out = np.zeros(n * len(self.numbers), np.int64)
        np.add.at(out, rows[each] * len(self.numbers) + self.item[at], parts[each] * self.times[at])
        return out.reshape(n, len(self.numbers))


class Heaps:
    """The `most` best (score, doc_id) of each item so far: highest score first, then smallest doc_id, rows without one last."""

    def __init__(self, items: int, most: int) -> None:
        self.most = most
        self.least = np.zeros(items, np.int64)  # a score has to reach this
        self.item, self.score, self.doc, self.none = (np.zeros(0, k) for k in (np.int64, np.int64, np.int64, bool))

    def update(self, scores: np.ndarray, docs: np.ndarray, none: np.ndarray) -> None:
        if len(scores) > self.most:
            bar = np.maximum(self.least, np.partition(scores, len(scores) - self.most, axis=0)[len(scores) - self.most])
        else:
            bar = self.least
        row, item = np.nonzero((scores >= bar) & (scores > 0))
        if not len(row):
            return
        self.item, self.score = np.r_[self.item, item], np.r_[self.score, scores[row, item]]
        self.doc, self.none = np.r_[self.doc, docs[row]], np.r_[self.none, none[row]]
        order = np.lexsort((self.doc, self.none, -self.score, self.item))
        item = self.item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.most]
        self.item, self.score, self.doc, self.none = self.item[order], self.score[order], self.doc[order], self.none[order]
        last = place[place < self.most] == self.most - 1
        self.least[self.item[last]] = self.score[last]


def _counted(index) -> object:
    """Documents (doc_id, text) to (doc_id, n, terms, times): how many words each has, and the item terms among them. Wordless ones go."""

    def count(batches: Batches) -> Batches:
        known = index.value.terms
        for batch in batches:
            for at, end, words, terms in terms_of(batch["text"]):
                found = pc.index_in(terms, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = found >= 0
                key, times = np.unique(words.row[hit] * len(known) + found[hit], return_counts=True)
                row, some = key // max(len(known), 1), np.flatnonzero(words.count)
                bound = np.searchsorted(row, np.r_[some, len(words.count)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bound), pa.array(x.astype(np.int32))) for x in (key % max(len(known), 1), times)]
                yield pa.record_batch([batch["doc_id"].slice(at, end - at).take(pa.array(some)), pa.array(words.count[some].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "times"])

    return count


def _ranked(index, weights, docs: int, total: int, most: int) -> object:
    """(doc_id, n, terms, times) to the heaps of the task: (item, score, doc_id)."""

    def rank(batches: Batches) -> Batches:
        items, weight = index.value, weights.value
        heaps, step = Heaps(len(items.numbers), most), max(1, CELLS // max(len(items.numbers), 1))
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, len(whole), step)):
                n = batch["n"].to_numpy()
                counts = np.diff(batch["terms"].offsets.to_numpy())
                rows, terms, tf = np.repeat(np.arange(len(batch)), counts), batch["terms"].flatten().to_numpy().astype(np.int64), batch["times"].flatten().to_numpy().astype(np.int64)
                m = 100 - 75 + (75 * n * docs) // total
                parts = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[rows]))
                ids = batch["doc_id"]
                heaps.update(items.scores(rows, terms, parts, len(batch)), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
        doc = pa.array(heaps.doc, pa.int64(), mask=heaps.none)
        yield pa.record_batch([pa.array(items.numbers[heaps.item]), pa.array(heaps.score), doc], names=["item", "score", "doc_id"])

    return rank


def lexical_search(docs: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` rows of docs (doc_id, text) of the highest score above 0 for each item (item_id, text).

    Terms are maximal runs of letters, digits and signs beyond ASCII, only A-Z lower-cased; a null text has none. Equal scores stand by ascending
    doc_id, null last; rows of docs that are repeated are ranked each for itself. Items alike in id and text are one
    item; an id with two texts gets two rankings, and a null item_id is an id like others. Items that share no term with any document, and
    empty tables, give no rows. Scores are 64-bit integers, so no order of adding changes them. Whole texts count, however long. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    numbered = stash(asked.withColumn("item", F.monotonically_increasing_id()))
    found = None
    for block in _blocks(numbered):
        index = spark.sparkContext.broadcast(block)
        counted = stash(docs.mapInArrow(_counted(index), "doc_id long, n long, terms array<int>, times array<int>"))
        one = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        # one number for each of the block's terms
        weight = df.select("term", F.floor(1000 * F.log(F.lit(float(2 * one["docs"] + 2)) / (2 * F.col("df") + 1))).cast("long").alias("w")).toArrow()
        weights = np.zeros(len(block.terms), np.int64)
        weights[weight["term"].to_numpy()] = weight["w"].to_numpy()
        if one["docs"]:
            heaps = counted.mapInArrow(_ranked(index, spark.sparkContext.broadcast(weights), one["docs"], one["total"], most), "item long, score long, doc_id long")
            found = heaps if found is None else found.unionAll(heaps)
    if found is None:
        found = spark.createDataFrame([], "item long, score long, doc_id long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", place).where(F.col("rank") <= most)
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _blocks(numbered: DataFrame) -> Iterator[Index]:
    """Indexes of at most BLOCK_TERMS terms each, or of one item that has more."""
    part: list[tuple[int, str]] = []
    size = 0
    for r in numbered.select("item", "text").toLocalIterator():  # one block at a time
        terms = len(r["text"]) // 2 + 1  # as many at most
        if part and size + terms > BLOCK_TERMS:
            yield Index(part)
            part, size = [], 0
        part.append((r["item"], r["text"]))
        size += terms
    if part:
        yield Index(part)
