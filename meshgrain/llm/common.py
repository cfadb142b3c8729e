"""Shared Spark helpers: tables in the cluster's shared folder, frequency sketches, Bloom filters, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshgrain.llm.words import mix
from meshgrain.sources.stored import delete, discard, drop_stashes, own_folder, shared_folder, stash

__all__ = ["delete", "discard", "drop_stashes", "own_folder", "shared_folder", "stash"]

Batches = Iterator[pa.RecordBatch]


def text_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Keeps Arrow batches of whole texts small, in rows and in bytes, so that a Python worker's memory is a few batches.

    Both are settings of the session: the registered queries call this, the operators leave settings alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id long, label int): rows of label 0 or 1, one for each doc_id, which has its largest label."""
    known = labels.where("doc_id is not null and label in (0, 1)")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))


def one_text(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """sample (doc_id and more, of a bounded number of rows) with one text for each doc_id: the least, null if there is no other."""
    found = docs.join(F.broadcast(sample.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return found.join(F.broadcast(sample), "doc_id")


def summed(parts: DataFrame) -> DataFrame:
    """Adds up arrays of uint32 counters: rows (slot, part, counts) to one row for each slot, in two steps."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in table["counts"].to_pylist())
        return pa.table({"slot": table["slot"].slice(0, 1), "part": pa.array([0], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    for keys in (("slot", "part"), ("slot",)):
        parts = parts.groupBy(*keys).applyInArrow(add, "slot int, part int, counts binary")
    return parts


def sketch(df: DataFrame, features: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = 20) -> np.ndarray:
    """Counts of 64-bit features by their leading bits, over all rows: 2**bits counters whatever the size of the input.

    A counter is never below the count of any feature it holds, so it orders features from
    rare to frequent and bounds how many rows can share one.
    """

    def count(batches: Batches) -> Batches:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for hashes in features(batch):
                total += np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        width = 1 << max(0, bits - 5)
        for slot in range(0, len(total) // width):
            yield pa.record_batch({"slot": pa.array([slot], pa.int32()), "counts": pa.array([total[slot * width : (slot + 1) * width].tobytes()], pa.binary())})

    parts = df.mapInArrow(count, "slot int, counts binary").withColumn("part", F.expr("spark_partition_id() % 64"))
    rows = sorted((r["slot"], r["counts"]) for r in summed(parts.select("slot", "part", "counts")).collect())
    return np.concatenate([np.frombuffer(x, np.uint32) for _, x in rows]) if rows else np.zeros(1 << bits, np.uint32)


#: A frequency level is `floor(1.5 * log2(count))`, in 6 bits.
LEVEL_BITS = 6


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(63, np.floor(1.5 * np.log2(np.maximum(counts, 1)))).astype(np.uint64)


def order_keys(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Places of features in one global order: by frequency level, rare first, then by hash."""
    bits = int(np.log2(len(level)))
    return (level[(hashes >> np.uint64(64 - bits)).astype(np.int64)] << np.uint64(64 - LEVEL_BITS)) | (mix(hashes) >> np.uint64(LEVEL_BITS))


def most_of_level(level: np.ndarray) -> np.ndarray:
    """The largest count that a level stands for."""
    return np.power(2.0, (level.astype(np.float64) + 1) / 1.5)


class Bloom:
    """A Bloom filter with a fixed number of bits; once full it lets everything pass, which costs time but no results."""

    def __init__(self, bits: np.ndarray, power: int) -> None:
        self.bits, self.power = bits, power

    @staticmethod
    def places(keys: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.view(np.uint64))
        return (h >> np.uint64(64 - power)).astype(np.int64), (h & np.uint64((1 << power) - 1)).astype(np.int64)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.int64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.places(keys, self.power)
        return ((self.bits[a >> 3] >> (a & 7).astype(np.uint8)) & (self.bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def bloom(df: DataFrame, column: str, most_power: int = 27) -> Broadcast:
    """Broadcasts a Bloom filter of a long column: about 16 bits a row, 16 MB at most whatever the input."""
    rows = df.count()
    power = int(np.clip(np.ceil(np.log2(16 * rows + 1)), 13, most_power))
    step = min(power, 20)

    def fill(batches: Batches) -> Batches:
        mark = np.zeros(1 << power, bool)
        for batch in batches:
            for places in Bloom.places(batch.column(0).to_numpy(zero_copy_only=False), power):
                mark[places] = True
        packed = np.packbits(mark, bitorder="little")
        width = 1 << (step - 3)
        for slot in range(len(packed) // width):
            part = packed[slot * width : (slot + 1) * width]
            if part.any():
                yield pa.record_batch({"slot": pa.array([slot], pa.int32()), "bits": pa.array([part.tobytes()], pa.binary())})

    def either(table: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()])
        return pa.table({"slot": table["slot"].slice(0, 1), "part": pa.array([0], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    parts = df.select(column).mapInArrow(fill, "slot int, bits binary").withColumn("part", F.expr("spark_partition_id() % 64")).select("slot", "part", "bits")
    for keys in (("slot", "part"), ("slot",)):
        parts = parts.groupBy(*keys).applyInArrow(either, "slot int, part int, bits binary")
    bits = np.zeros(1 << (power - 3), np.uint8)
    for r in parts.toLocalIterator():
        bits[r["slot"] << (step - 3) : (r["slot"] + 1) << (step - 3)] = np.frombuffer(r["bits"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(Bloom(bits, power))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that it is connected to.

    Each round maps every node to its smallest neighbour and contracts the graph, so stars
    take one round and paths a logarithmic number. Rounds are cut by tables in the shared folder.
    """
    edges = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")))
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            hop = step.select(F.col("node").alias("component"), "to")
            labels = stash(labels.join(hop, "component", "left").select("node", F.coalesce("to", "component").alias("component")))  # stars need one round, so few come here
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("l")), step.select(F.col("node").alias("b"), F.col("to").alias("r"))
        old, edges = edges, stash(edges.join(left, "a").join(right, "b").where("l <> r").select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct())
        discard(old)
        if edges.isEmpty():
            return labels
