"""Suffix-array dedup: bytes in strings of a given length that start anywhere else too are removed.

Byte windows are routed to shards by anchor (anchors.py), so equal ones stand in one shard.
A shard's suffixes are sorted by external induced sorting (induced_sort.py), which carries the
prefix that neighbours share: if that is at least a window, both hold it more than once.
Texts that are the same from end to end meet by their hash and enter a shard once, with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshgrain.llm.anchors import Alphabet, covered, marked, route, sharded
from meshgrain.llm.common import Batches
from meshgrain.llm.induced_sort import array, suffixes


def repeated(table: pa.Table, width: int, budget: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of bytes in windows that occur more than once in the shard."""
    sizes = pc.binary_length(table["symbols"]).to_numpy().astype(np.int64)
    begin = np.r_[0, np.cumsum(sizes + 1)]  # each text is followed by a separator, 0
    text, hit = array(int(begin[-1]), np.int16, budget), array(int(begin[-1]), bool, budget)
    at = 0
    for batch in table.select(["symbols"]).to_batches():
        for value in batch.column(0):
            raw = np.frombuffer(value.as_buffer(), np.uint8)
            text[at : at + len(raw)] = raw.astype(np.int16) + 1
            at += len(raw) + 1
    previous = 0
    # a window shares `width` bytes with none that reaches into a separator, so equal windows are neighbours
    for position, common in suffixes(text, 257, width, budget):
        alike = np.flatnonzero(common >= width)
        hit[position[alike]] = True
        hit[np.r_[previous, position[:-1]][alike]] = True
        previous = position[-1]
    windows = sizes - width + 1
    bounds = np.r_[0, np.cumsum(windows)]
    own = np.repeat(begin[:-1] - bounds[:-1], windows) + np.arange(bounds[-1])
    yield marked(table, hit[own], bounds[:-1], width)


def suffix_dedup(docs: DataFrame, width: int = 200, gram: int = 32) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, kept (binary), runs.

    Texts are UTF-8 bytes, null is empty. Every byte covered by a string of `width` bytes that
    also starts anywhere else in the table is removed, in the same document or another;
    overlaps count, strings are judged on the input and never cross documents. runs are the
    maximal removed byte runs [start, end). Rows that repeat a doc_id are documents of their
    own; a null doc_id is as good as any. Other columns are ignored, an empty table gives an empty
    result, and a text of any length is cut into segments that are sorted apart.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    routed = route(docs.select("uid", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text"), Alphabet("byte", gram, width))
    same = routed.segments.join(routed.classes.where("n > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    whole = same.select("uid", F.col("at").alias("start"), (F.col("at") + F.col("windows") + (width - 1)).alias("end"))
    some = sharded(routed.texts, lambda t: repeated(t, width), "uid long, start long, end long")
    runs = covered(whole.unionAll(some).distinct())
    return docs.join(runs, "uid", "left").select("doc_id", "text", "runs").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, kept binary, runs array<struct<start:long,end:long>>")


def _kept(batches: Batches) -> Batches:
    for batch in batches:
        n_bytes, kept, runs = [], [], batch["runs"]
        for text, run in zip(batch["text"].cast(pa.binary()), runs, strict=True):
            raw = text.as_py() or b""
            n_bytes.append(len(raw))
            at, left = 0, []
            for r in run.as_py() or []:
                left.append(raw[at : r["start"]])
                at = r["end"]
            kept.append(b"".join([*left, raw[at:]]))
        removed = [a - len(b) for a, b in zip(n_bytes, kept, strict=True)]
        yield pa.record_batch([batch["doc_id"], pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), runs], names=["doc_id", "n_bytes", "n_removed", "kept", "runs"])


def digest(found: DataFrame) -> DataFrame:
    spans = F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs"))
    return found.select("doc_id", "n_bytes", "n_removed", spans.cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
