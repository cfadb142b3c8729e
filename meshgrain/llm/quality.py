"""Quality classifier: logistic regression over hashed word n-grams, trained by follow the regularised leader.

Tokens are runs of letters and digits (A-Z lower-cased) and runs of other signs; features are
single tokens and pairs, hashed to 2**18 places, a pair of equal tokens being one feature of
its own. Values are log counts, scaled to length 1. Training runs on a bounded sample, in
shards whose weights are averaged; scoring is a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshgrain.llm.common import Batches, labelled, one_text, stash
from meshgrain.llm.words import ALNUM, LOWER, NOT_SPACE, _BYTES, byte_sums, chunks, mix, range_hash

BITS = 18
_REPEAT = np.uint64(0x2545F4914F6CDD1D)


def features(column: pa.Array):
    """(first row, rows, row of each feature, its place, its value)."""
    kind_of = np.where(ALNUM, 1, np.where(NOT_SPACE, 2, 0)).astype(np.int8)
    for lo, hi, data, offsets in chunks(column):
        data = LOWER[data]
        kind = kind_of[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        cut[offsets] = True
        edge = np.flatnonzero(cut)
        token = kind[edge[:-1]] > 0 if len(data) else np.zeros(0, bool)
        start, end = edge[:-1][token], edge[1:][token]
        row = np.searchsorted(offsets, start, "right") - 1
        h = mix(range_hash(byte_sums(data), start, end, _BYTES))
        pair = np.flatnonzero(row[1:] == row[:-1])
        both = np.where(h[pair] == h[pair + 1], _REPEAT, mix(h[pair] * np.uint64(3) + h[pair + 1]))
        rows = np.r_[row, row[pair]]
        place = (np.r_[h, both] >> np.uint64(64 - BITS)).astype(np.int64)
        cell, count = np.unique((rows << BITS) | place, return_counts=True)
        row, place = cell >> BITS, cell & ((1 << BITS) - 1)
        value = 1 + np.log(count)
        value /= np.sqrt(np.bincount(row, value * value, minlength=hi - lo))[row]
        yield lo, hi - lo, row, place, value


class Leader:
    """Per-coordinate follow-the-regularised-leader state (proximal form) with an intercept."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, place: np.ndarray) -> np.ndarray:
        z, n = self.z[place], self.n[place]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, label: np.ndarray) -> None:
        row, place, value = np.r_[row, np.arange(len(label))], np.r_[place, np.full(len(label), 1 << BITS)], np.r_[value, np.ones(len(label))]
        w = self.weights(place)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w * value, minlength=len(label)), -35, 35)))
        touched, at = np.unique(place, return_inverse=True)
        g = np.bincount(at, (p - label)[row] * value)
        sigma = (np.sqrt(self.n[touched] + g * g) - np.sqrt(self.n[touched])) / self.alpha
        self.z[touched] += g - sigma * self.weights(touched)
        self.n[touched] += g * g


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 16_384, shards: int = 4, epochs: int = 10, batch_rows: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1) -> np.ndarray:
    """Weights of all places, the intercept last. labels: doc_id, label (0 or 1; other rows are left out).

    The most_rows labelled rows with the least hash of doc_id are taken; each shard of them
    trains in the order of that hash, and the weights of the shards that have rows are averaged. A doc_id
    labelled more than once has its largest label; of several texts under one doc_id the least
    counts. No labels: all weights are 0.
    """
    sample = stash(labelled(labels).withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(most_rows))
    texts = one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), sample)

    def count(batches: Batches) -> Batches:
        for batch in batches:
            for lo, rows, row, place, value in features(batch["text"]):
                edge = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
                yield pa.record_batch({"at": batch["at"].slice(lo, rows), "label": batch["label"].slice(lo, rows), "places": pa.ListArray.from_arrays(edge, pa.array(place.astype(np.int32))), "vals": pa.ListArray.from_arrays(edge, pa.array(value.astype(np.float32)))})

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        model = Leader(alpha, beta, l1, l2)
        label = table["label"].to_numpy().astype(float)
        for _ in range(epochs):
            for i in range(0, len(table), batch_rows):
                part = table.slice(i, batch_rows).combine_chunks()
                places, vals = part["places"].combine_chunks(), part["vals"].combine_chunks()
                row = np.repeat(np.arange(len(part)), np.diff(places.offsets.to_numpy()))
                model.learn(row, places.flatten().to_numpy().astype(np.int64), vals.flatten().to_numpy().astype(float), label[i : i + batch_rows])
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        return pa.table({"place": pa.array(np.r_[-1, at].astype(np.int32)), "weight": pa.array(np.r_[1.0, w[at]])})  # place -1 counts shards

    counted = texts.mapInArrow(count, "at long, label int, places array<int>, vals array<float>").withColumn("shard", F.pmod("at", F.lit(shards)))
    trained = counted.groupBy("shard").applyInArrow(train, "place int, weight double").groupBy("place").agg(F.sum("weight").alias("weight"))
    out, held = np.zeros((1 << BITS) + 1), 1.0
    for r in trained.toLocalIterator():  # 2**18 numbers at most
        if r["place"] < 0:
            held = r["weight"]
        else:
            out[r["place"]] = r["weight"]
    return out / held


def quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts have no features and score the intercept. Only the text is an input: repeated
    rows score alike, very long texts count whole. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Batches) -> Batches:
        w = shared.value
        for batch in batches:
            dots = np.zeros(len(batch))
            for lo, rows, row, place, value in features(batch["text"]):
                dots[lo : lo + rows] = np.bincount(row, w[place] * value, minlength=rows)
            p = 1 / (1 + np.exp(-np.clip(dots + w[-1], -35, 35)))
            yield pa.record_batch([batch["doc_id"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, schema)
