"""Substring dedup: word windows that a document with a smaller id has too are removed.

Windows are routed to shards by anchor (anchors.py). A shard's texts become one compressed
FM-index, and every text is streamed against it backwards: each step extends the match by one
word to the left, and once it is as long as a window it is reported with the smallest document
among its rows and widened to its parent, the rows that share all but its last word (matching
statistics, capped at the window). Which rows belong together follows from the common prefixes
of neighbours in the suffix order; no window is hashed. Texts that are the same from end to end need no index: they meet by their hash,
and what is found in the first of them counts for every other one of the same document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshgrain.llm.anchors import Alphabet, covered, marked, route, sharded
from meshgrain.llm.common import Batches, stash
from meshgrain.llm.fm_index import FMIndex


def repeated(table: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    """Runs of words in windows that a text of a smaller document in the shard has too."""
    texts = [np.frombuffer(x, np.uint64) for x in table["symbols"].to_pylist()]
    sizes = np.array([len(x) for x in texts])
    words, ids = np.unique(np.concatenate(texts), return_inverse=True)
    begin = np.r_[0, np.cumsum(sizes + 1)]  # each text is followed by a separator
    symbols = np.zeros(begin[-1], np.int64)
    inside = np.ones(begin[-1], bool)
    inside[begin[1:] - 1] = False
    symbols[inside] = ids + 1
    index = FMIndex(symbols, width)
    doc = np.repeat(table["doc_id"].to_numpy(), sizes + 1)
    parent_lo, parent_hi = index.intervals(width - 1)
    # least document of the rows of each window: rows [lo, hi) of a whole window are those with as much in common
    whole_lo, _ = index.intervals(width)
    edges = np.unique(whole_lo)
    least = np.zeros(len(symbols), np.int64)
    least[edges] = np.minimum.reduceat(doc[index.order], edges)
    hit = np.zeros(len(symbols), bool)
    # long texts first, so that those still running are a prefix
    rank = np.argsort(-sizes, kind="stable")
    ends, lengths = begin[1:][rank] - 2, sizes[rank]
    lo, hi = np.zeros(len(rank), np.int64), np.full(len(rank), len(symbols))
    for step in range(int(lengths[0])):
        n = int(np.searchsorted(-lengths, -step, "left"))
        here = ends[:n] - step
        lo, hi = index.extend(symbols[here], lo[:n], hi[:n])
        if step + 1 >= width:
            hit[here] = least[lo] < doc[here]
            lo, hi = parent_lo[lo], parent_hi[lo]
    windows = sizes - width + 1
    bounds = np.r_[0, np.cumsum(windows)]
    own = np.repeat(begin[:-1] - bounds[:-1], windows) + np.arange(bounds[-1])
    yield marked(table, hit[own], bounds[:-1], width, "doc_id", "anchor", "content", "at")


def substring_dedup(docs: DataFrame, width: int = 50, gram: int = 10) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_removed, kept_text, runs.

    A window is `width` consecutive words of one document. Words in a window whose words also
    start in a document with a smaller doc_id are removed; windows are judged on the input.
    runs are the removed word runs [start, end). kept_text joins the kept words by one space.
    Null texts have no words; shorter documents have no window; rows of the same doc_id never
    remove from each other, and repeated rows are treated alike; a null doc_id removes nothing and loses
    nothing. Very long texts are taken whole. An empty table gives no rows. Other columns of docs, whatever their names, are left aside.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    kind = Alphabet("word", gram, width)
    routed = route(docs.where("doc_id is not null").select("uid", "doc_id", "text"), kind, again=True)
    same = routed.segments.join(routed.classes.where("n > 1").select("anchor", "content", F.col("doc_id").alias("least")), ["anchor", "content"])
    whole = same.where("doc_id > least").select("uid", F.col("at").alias("start"), (F.col("at") + F.col("windows") + (width - 1)).alias("end"))
    some = sharded(routed.texts, lambda t: repeated(t, width), "uid long, start long, end long, doc_id long, anchor long, content long, at long", most_bytes=2 << 20)
    # where the least document has a segment again, what was found in one of them is found in all
    key = ["anchor", "content", "doc_id"]
    others = stash(routed.segments.join(routed.classes.where("again").select(*key), key, "left_semi").select(*key, F.col("uid").alias("to"), F.col("at").alias("to_at")))
    shift = F.coalesce(F.col("to_at") - F.col("at"), F.lit(0))
    some = some.join(others, key, "left").select(F.coalesce("to", "uid").alias("uid"), (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))
    runs = covered(whole.unionAll(some).distinct())
    return docs.join(runs, "uid", "left").select("doc_id", "text", "runs").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string, runs array<struct<start:long,end:long>>")


def _kept(batches: Batches) -> Batches:
    space = frozenset("\t\n\x0b\x0c\r ")
    table = str.maketrans(dict.fromkeys(space, " "))
    for batch in batches:
        n_words, n_removed, kept, runs = [], [], [], batch["runs"]
        for text, run in zip(batch["text"], runs, strict=True):
            words = [w for w in (text.as_py() or "").translate(table).split(" ") if w]
            n_words.append(len(words))
            at, left = 0, []
            for r in run.as_py() or []:
                left += words[at : r["start"]]
                at = r["end"]
            left += words[at:]
            n_removed.append(len(words) - len(left))
            kept.append(" ".join(left))
        yield pa.record_batch([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), runs], names=["doc_id", "n_words", "n_removed", "kept_text", "runs"])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
