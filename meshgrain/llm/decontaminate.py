"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

The patterns are windows of item words, as sequences of word numbers, so a trie has a node for a word and not for a
letter; a document's words are numbered the same way and scanned once. Matches map to word numbers and from there to
places in the original text. An automaton holds PART_WINDOWS windows at most, about 150 MB; a larger benchmark is scanned in
several passes over the documents.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshgrain.llm.common import Batches, stash
from meshgrain.llm.secret_scan import unused
from meshgrain.llm.words import ALNUM, LOWER

#: Windows in one automaton, and windows of an item that stay together.
PART_WINDOWS, PIECE = 200_000, 1000
_FOLD = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 32 for b in range(256))
_LOWER_TEXT = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """The automaton of some pieces (item, words joined by spaces), with words and items as numbers."""

    built: tuple[str, Windows] | None = None

    def __init__(self, pieces: list[tuple[str | None, bytes]], size: int) -> None:
        self.number: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for item, joined in pieces:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in joined.split()]
            for i in range(max(len(words) - size + 1, 1)):
                held.setdefault(tuple(words[i : i + size]), set()).update(() if item is None else (item,))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.items = list(held.values())
        self.words = np.array([len(k) for k in held], np.int64)
        for i, key in enumerate(held):
            self.automaton.add_word(key, i)
        if held:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, shared) -> Windows:
        """Built once in each worker process, which keeps the last one."""
        name, pieces, size = shared.value
        if cls.built is None or cls.built[0] != name:
            cls.built = (name, cls(pieces, size))
        return cls.built[1]

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Numbers of hit words, in order, and items with an occurring window."""
        if not self.items or not words:
            return np.zeros(0, np.int64), set()
        number = self.number
        found = list(self.automaton.iter(tuple([number.get(w, 0) for w in words])))
        if not found:
            return np.zeros(0, np.int64), set()
        last, which = np.array(found, np.int64).T
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, last + 1 - self.words[which], 1)
        np.add.at(marks, last + 1, -1)
        return np.flatnonzero(np.cumsum(marks[:-1]) > 0), set().union(*(self.items[i] for i in set(which.tolist())))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_hit, items, spans.

    A window is `size` consecutive words of an item, or all words of a shorter one. n_hit
    counts document words inside any occurrence; items (array of item_id as string, sorted)
    are those with an occurring window; spans are the hit runs in the original text (start,
    end in code points). Null and wordless texts have no words; items without words match
    nothing; a null item_id hits but is not listed. An empty benchmark leaves every document clean.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _hits(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, size, "_items", "_hit_words")
    return rows.mapInArrow(_located, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without rows in which a window occurs; all columns stay as they are.

    Null and wordless texts stay, repeated rows stay or go together, very long texts are scanned whole.
    """
    hit = unused(docs.columns, "_hit_words")
    return _hits(docs, benchmark, size, unused(docs.columns, "_items"), hit).where(f"size({hit}) = 0").select(*[f"`{c}`" for c in docs.columns])


def _pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, piece, windows): runs of item words that hold all windows of the items, PIECE windows or fewer in each."""

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            out: dict[str, list] = {"item": [], "piece": [], "windows": []}
            for item, text in zip(batch["item"].to_pylist(), batch["text"], strict=True):
                words = normalised(text.as_py())
                n = max(len(words) - size + 1, min(len(words), 1))
                for i in range(0, n, PIECE):
                    out["item"].append(item)
                    out["piece"].append(b" ".join(words[i : i + PIECE + size - 1]))
                    out["windows"].append(min(PIECE, n - i))
            yield pa.record_batch([pa.array(out["item"], pa.string()), pa.array(out["piece"], pa.binary()), pa.array(out["windows"], pa.int64())], names=list(out))

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(cut, "item string, piece binary, windows long").distinct()


def _hits(docs: DataFrame, benchmark: DataFrame, size: int, items: str, hits: str) -> DataFrame:
    """docs with columns of item names and hit word numbers, from one pass for each part of the benchmark."""
    spark = docs.sparkSession
    pieces = stash(_pieces(benchmark, size))
    parts = -(-(pieces.agg(F.sum("windows")).first()[0] or 0) // PART_WINDOWS) or 1
    rows = docs.withColumns({items: F.array().cast("array<string>"), hits: F.array().cast("array<long>")})
    for part in range(parts):
        chosen = pieces.where(F.pmod(F.xxhash64("piece"), F.lit(parts)) == part).select("item", "piece").collect()  # about PART_WINDOWS windows
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["item"], bytes(r["piece"])) for r in chosen], size))
        rows = rows.mapInArrow(_scanner(shared, items, hits), rows.schema)
        if part + 1 < parts:
            rows = stash(rows)
    return rows


def _scanner(shared, items: str, hits: str):
    def scan(batches: Batches) -> Batches:
        windows = Windows.of(shared)
        for batch in batches:
            named, hit = batch[items].to_pylist(), batch[hits].to_pylist()
            for i, text in enumerate(batch["text"]):
                found, names = windows.find(normalised(text.as_py()))
                if len(found):
                    hit[i] = np.union1d(hit[i], found).astype(np.int64).tolist()
                    named[i] = sorted({*named[i], *names})
            made = {items: pa.array(named, pa.list_(pa.string())), hits: pa.array(hit, pa.list_(pa.int64()))}
            yield pa.record_batch([made.get(c, batch[c]) for c in batch.schema.names], names=batch.schema.names)

    return scan


def _located(batches: Batches) -> Batches:
    for batch in batches:
        counts, spans = [], []
        for text, hit in zip(batch["text"], batch["_hit_words"].to_pylist(), strict=True):
            counts.append(len(normalised(text.as_py())))
            runs = []
            if hit:
                places = [m.span() for m in _WORD.finditer(text.as_py().translate(_LOWER_TEXT))]
                cut = np.flatnonzero(np.diff(hit) > 1)
                runs = [{"start": places[hit[a]][0], "end": places[hit[b]][1]} for a, b in zip(np.r_[0, cut + 1], np.r_[cut, len(hit) - 1], strict=True)]
            spans.append(runs)
        n_hit = [len(h) for h in batch["_hit_words"].to_pylist()]
        yield pa.record_batch([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), batch["_items"], pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
