"""Toxicity by nearest labelled examples under exact TF-IDF cosine, from a block-max inverted index.

Terms are all words of a text (A-Z lower-cased), and once more the stem of each, its first STEM characters, as a kind of its own: whole words keep
apart what begins alike, stems bring inflected forms together. Document frequencies are counted over all documents. A text's cosines to all
examples are divided by one length, its own, so neither the order of its neighbours nor their vote depends on it; there, a
term that no example holds counts as held by that text alone. Examples are a bounded, deterministic
sample of labelled rows, half of each class, and keep all their terms. The index files them by term in blocks of BLOCK
examples with the largest weight of each block. A document meets blocks in the order of their upper
bounds and stops when no block can hold a nearer example than its k-th, so the k nearest are exact.

The k nearest vote by a power of their cosine and by how many labelled rows they stand for. The examples
themselves, each judged without itself, choose k and the power (least log loss) and fit the logistic curve that
makes the vote a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshgrain.llm.common import Batches, labelled, one_text, stash, summed
from meshgrain.llm.words import _BYTES, ALNUM, LOWER, Words, byte_sums, chunks, mix, range_hash

BLOCK, STEM = 64, 4
#: Numbers of neighbours and powers of the cosine to choose from.
CHOICES = tuple((k, power) for k in (16, 64, 256) for power in (1, 2, 4))
#: What sets the hashes of stems apart from those of words.
STEMS = np.uint64(0x94D049BB133111EB)
#: Terms whose postings are kept as dense columns of their blocks, and documents judged together.
MOST_DENSE, TOGETHER = 1024, 128


def term_counts(column: pa.Array):
    """(first row, rows, row of each distinct term, term hash, occurrences)."""
    for lo, hi, data, offsets in chunks(column):
        words = Words(data, offsets, LOWER, ALNUM)
        # where the STEM-th character of a word ends: characters begin at bytes that continue none
        begins = np.flatnonzero((words.data & 0xC0) != 0x80)
        cut = np.r_[begins, [len(words.data)] * STEM][np.searchsorted(begins, words.start) + STEM]
        stems = mix(range_hash(byte_sums(words.data), words.start, np.minimum(words.end, cut), _BYTES) ^ STEMS)
        row, h = np.r_[words.row, words.row], np.r_[words.hashes(), stems]
        at = np.lexsort((h, row))
        row, h = row[at], h[at]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool))
        yield lo, hi - lo, row[new], h[new], np.diff(np.r_[new, len(h)])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one range after another."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Examples:
    """The index: terms and their weights, postings of examples in blocks, labels, votes and the curve.

    terms are sorted hashes, df counts documents with a term out of `total`; row, term, tf are the
    examples' postings. A term that no example holds counts as one that one document holds.
    """

    def __init__(self, terms: np.ndarray, df: np.ndarray, total: int, doc: np.ndarray, label: np.ndarray, vote: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, prior: float) -> None:
        self.terms, self.df, self.total, self.prior, self.curve = terms, df, total, prior, (0.0, 1.0)
        self.k, self.power = CHOICES[0]
        # alike examples share blocks: by which of the commonest terms they hold, then by label
        many = np.argsort(-np.bincount(term, minlength=len(terms)), kind="stable")[:24]
        code = np.zeros(len(doc), np.int64)
        for bit, t in enumerate(many):
            code[row[term == t]] |= 1 << (23 - bit)
        order = np.lexsort((doc, label, code))
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc))
        self.doc, self.label, self.vote = doc[order], label[order], vote[order]
        at = np.lexsort((place[row], term))
        self.row, self.term, self.tf = place[row][at].astype(np.int32), term[at].astype(np.int32), tf[at].astype(np.int32)
        self._ready()

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("terms", "df", "total", "prior", "k", "power", "curve", "doc", "label", "vote", "row", "term", "tf")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        n, blocks = len(self.doc), -(-len(self.doc) // BLOCK)
        self.idf = np.maximum(np.log((1 + self.total) / (1 + self.df)), 1e-9)
        self.new = max(np.log((1 + self.total) / 2), 1e-9)
        weight = self.weights(self.row, self.idf[self.term], self.tf, n)
        count = np.bincount(self.term, minlength=len(self.terms))
        head = np.argsort(-count, kind="stable")[:MOST_DENSE]
        head = head[count[head] * BLOCK > n]
        self.column = np.full(len(self.terms), -1)
        self.column[head] = np.arange(len(head))
        dense = self.column[self.term] >= 0
        self.block = np.zeros((blocks * BLOCK, len(head)), np.float32)
        self.block[self.row[dense], self.column[self.term[dense]]] = weight[dense]
        self.block = self.block.reshape(blocks, BLOCK, len(head))
        self.most = self.block.max(1)
        self.rare_row, self.rare_weight = self.row[~dense], weight[~dense]
        self.edge = np.searchsorted(self.term[~dense], np.arange(len(self.terms) + 1))

    @staticmethod
    def weights(row: np.ndarray, idf: np.ndarray, tf: np.ndarray, rows: int) -> np.ndarray:
        w = (1 + np.log(tf)) * idf
        return w / np.sqrt(np.bincount(row, w * w, minlength=rows))[row]

    def nearest(self, row: np.ndarray, h: np.ndarray, tf: np.ndarray, rows: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, k) example numbers and cosines, nearest first (ties: the earlier example), and how many blocks were looked into.

        row, h, tf: terms of the texts; skip: an example that each row leaves out.
        """
        n, blocks = len(self.doc), len(self.block)
        k = min(self.k, n)
        if not n or not rows:
            return np.zeros((rows, 0), np.int64), np.zeros((rows, 0)), 0
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[at] == h
        w = self.weights(row, np.where(known, self.idf[at], self.new), tf, rows)
        row, at, w = row[known], at[known], w[known]
        dense = self.column[at] >= 0
        text = np.zeros((rows, self.block.shape[2]), np.float32)
        text[row[dense], self.column[at[dense]]] = w[dense]
        lo, hi = self.edge[at[~dense]], self.edge[at[~dense] + 1]
        post = _ranges(lo, hi)
        cell = np.repeat(row[~dense], hi - lo) * (blocks * BLOCK) + self.rare_row[post]
        rare = np.bincount(cell, np.repeat(w[~dense], hi - lo) * self.rare_weight[post], minlength=rows * blocks * BLOCK).reshape(rows, blocks, BLOCK)
        bound = text @ self.most.T + rare.max(2) + 1e-5
        order = np.argsort(-bound, axis=1, kind="stable")
        sims = np.full((rows, blocks, BLOCK), -1.0)
        least, looked, step, done = np.full(rows, -1.0), 0, -(-4 * k // BLOCK), 0
        while done < blocks:
            todo = order[:, done : done + step]
            need = np.take_along_axis(bound, todo, 1) > least[:, None]
            if not need.any():
                break
            who, slot = np.nonzero(need)
            which = todo[who, slot]
            by = np.argsort(which, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(which[by]) > 0, True])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                q, one = who[by[a:b]], which[by[a]]
                sims[q, one] = text[q] @ self.block[one].T + rare[q, one]
            looked += len(who)
            if skip is not None:
                sims.reshape(rows, -1)[np.arange(rows), skip] = -1.0
            flat = sims.reshape(rows, -1)[:, :n]
            least = np.partition(flat, n - k, axis=1)[:, n - k]
            done += step
            step *= 2
        flat = np.round(sims.reshape(rows, -1)[:, :n], 6)
        # exact up to rounding: the k-th and what ties with it, the earlier first
        top = np.argpartition(-flat, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (rows, 1))
        kth = np.take_along_axis(flat, top, 1).min(1)
        for i in np.flatnonzero((flat == kth[:, None]).sum(1) > (np.take_along_axis(flat, top, 1) == kth[:, None]).sum(1)):
            sure = np.flatnonzero(flat[i] > kth[i])
            top[i] = np.r_[sure, np.flatnonzero(flat[i] == kth[i])[: k - len(sure)]]
        top = np.take_along_axis(top, np.lexsort((top, -np.take_along_axis(flat, top, 1)), axis=1), 1)
        return top, np.clip(np.take_along_axis(flat, top, 1), 0, 1), looked

    def votes(self, found: np.ndarray, cosine: np.ndarray, power: float | None = None) -> np.ndarray:
        """Log odds of label 1 by distance-weighted votes, shrunk to the prior by half a vote; no neighbour: the prior."""
        vote = self.vote[found] * cosine ** (power or self.power)
        total = vote.sum(1)
        share = np.where(total > 0, (vote * self.label[found]).sum(1) / np.where(total > 0, total, 1), self.prior)
        size = (cosine > 0).sum(1)
        p = np.clip((share * size + 0.5 * self.prior) / (size + 0.5), 1e-9, 1 - 1e-9)
        return np.log(p / (1 - p))

    def scores(self, found: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; the prior where there is no neighbour."""
        a, b = self.curve
        p = 1 / (1 + np.exp(-np.clip(a + b * self.votes(found, cosine), -35, 35)))
        return np.where((cosine > 0).any(1), p, self.prior)

    def calibrate(self, odds: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Chooses k and power and fits the curve by the log odds of examples judged without themselves, a column
        for each of CHOICES; all stays as it is with one class only."""
        if len(np.unique(label)) < 2:
            return
        weight, best = weight / weight.mean(), np.inf
        for (k, power), column in zip(CHOICES, odds.T, strict=True):
            curve = _logistic(column, label, weight)
            p = np.clip(1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * column, -35, 35))), 1e-9, 1 - 1e-9)
            loss = -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).mean()
            if curve[1] > 0 and loss < best - 1e-9:
                best, self.k, self.power, self.curve = loss, k, power, curve


def _logistic(odds: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a weighted logistic fit by Newton steps, each halved until it lowers the loss.

    The votes of texts that share few words lie close together, so the fit is in units of their spread about their mean:
    there a small penalty keeps the slope finite where the classes don't overlap, and leaves steep curves alone.
    """
    mean = np.average(odds, weights=weight)
    spread = np.sqrt(np.average((odds - mean) ** 2, weights=weight)) or 1.0
    x, beta, penalty = np.c_[np.ones(len(odds)), (odds - mean) / spread], np.zeros(2), np.array([0.0, 0.1])

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((weight * (np.logaddexp(0, z) - label * z)).sum() + (penalty * beta * beta).sum() / 2)

    now = loss(beta)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (label - p)) - penalty * beta)
        while (then := loss(beta + step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        if np.abs(step).max() < 1e-10 or then > now:
            break
        beta, now = beta + step, then
    slope = beta[1] / spread
    return float(beta[0] - slope * mean), float(slope)


def _neighbours(column: pa.Array, model: Examples, skip: np.ndarray | None = None):
    """(first row, rows, nearest examples, cosines) of runs of rows."""
    for lo, rows, row, h, tf in term_counts(column):
        edge = np.searchsorted(row, np.arange(rows + 1))
        for a in range(0, rows, TOGETHER):
            b = min(a + TOGETHER, rows)
            s = slice(edge[a], edge[b])
            found, cosine, _ = model.nearest(row[s] - a, h[s], tf[s], b - a, None if skip is None else skip[lo + a : lo + b])
            yield lo + a, b - a, found, cosine


def fit(docs: DataFrame, labels: DataFrame, most_examples: int = 4096, most_postings: int = 4_000_000) -> Examples:
    """The index of labelled examples. labels: doc_id, label (0 or 1; other rows are left out).

    Of each class the most_examples / 2 rows with the least hash of doc_id are taken, or fewer where their
    texts together have more than most_postings / 2 distinct terms; that bounds all that is gathered. Class totals count
    every labelled row, document frequencies every row of docs. A doc_id labelled more than once has its
    largest label; of several texts under one doc_id the least counts. No labels: an index of no examples.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labelled(labels)
    totals = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = [labels.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples // 2) for c in (0, 1)]
    sample = stash(some[0].unionAll(some[1]).withColumn("at", F.xxhash64("doc_id")))  # most_examples rows at most
    texts = stash(one_text(docs, sample))

    def count(batches: Batches) -> Batches:
        for batch in batches:
            for lo, rows, row, h, n in term_counts(batch["text"]):
                edge = np.searchsorted(row, np.arange(rows + 1))
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())  # noqa: B023, E731
                yield pa.record_batch({**{c: batch[c].slice(lo, rows) for c in ("doc_id", "label", "at")}, "n": pa.array(np.diff(edge)), "terms": cut(h), "tf": cut(n.astype(np.int32))})

    counted = stash(texts.mapInArrow(count, "doc_id long, label int, at long, n long, terms binary, tf binary"))
    chosen = []
    for c in (0, 1):
        sizes = sorted((r["at"], r["doc_id"], r["n"]) for r in counted.where(F.col("label") == c).select("at", "doc_id", "n").collect())
        chosen += [d for (_, d, _), upto in zip(sizes, np.cumsum([n for *_, n in sizes]), strict=True) if upto <= most_postings // 2]
    keep = set(chosen)
    got = sorted((r for r in counted.toLocalIterator() if r["doc_id"] in keep), key=lambda r: r["doc_id"])  # most_postings numbers at most
    lists = [(np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["tf"], np.int32)) for r in got]
    row = np.repeat(np.arange(len(got)), [len(t) for t, _ in lists])
    terms, term = np.unique(np.concatenate([t for t, _ in lists] or [np.zeros(0, np.uint64)]), return_inverse=True)
    tf = np.concatenate([n for _, n in lists] or [np.zeros(0, np.int32)])
    df, total = _frequencies(docs, terms)
    label = np.array([r["label"] for r in got], float)
    stands = {c: totals.get(c, 0) / max((label == c).sum(), 1) for c in (0, 1)}
    prior = totals.get(1, 0) / max(sum(totals.values()), 1)
    model = Examples(terms, df, total, np.array([r["doc_id"] for r in got], np.int64), label, np.array([stands[int(y)] for y in label], float), row, term, tf, float(prior))
    if len(keep) > 1:
        place = {int(d): i for i, d in enumerate(model.doc)}
        shared = spark.sparkContext.broadcast((model, place))

        def judge(batches: Batches) -> Batches:
            known, at = shared.value
            known.k = max(k for k, _ in CHOICES)
            for batch in batches:
                batch = batch.filter(pa.array([d in at for d in batch["doc_id"].to_pylist()], pa.bool_()))
                skip = np.array([at[d] for d in batch["doc_id"].to_pylist()], np.int64)
                for lo, rows, found, cosine in _neighbours(batch["text"], known, skip):
                    odds = np.stack([known.votes(found[:, :k], cosine[:, :k], power) for k, power in CHOICES], 1)
                    yield pa.record_batch({"label": batch["label"].slice(lo, rows), "odds": pa.array(list(odds), pa.list_(pa.float64()))})

        judged = sorted((r["odds"], r["label"]) for r in texts.mapInArrow(judge, "label int, odds array<double>").collect())  # a row for each example
        y = np.array([y for _, y in judged], float)
        model.calibrate(np.array([x for x, _ in judged]).reshape(len(y), len(CHOICES)), y, np.array([stands[int(c)] for c in y]))
    return model


def _frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """How many rows of docs hold each of the terms, and how many rows there are."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    width = 1 << 18

    def count(batches: Batches) -> Batches:
        known = shared.value
        seen = np.zeros(len(known) + 1, np.uint32)
        for batch in batches:
            seen[-1] += len(batch)
            for _, _, _, h, _ in term_counts(batch["text"]):
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                ok = known[at] == h if len(known) else np.zeros(len(h), bool)
                seen[: len(known)] += np.bincount(at[ok], minlength=len(known)).astype(np.uint32)
        for slot in range(-(-len(seen) // width)):
            yield pa.record_batch({"slot": pa.array([slot], pa.int32()), "counts": pa.array([seen[slot * width : (slot + 1) * width].tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "slot int, counts binary").withColumn("part", F.expr("spark_partition_id() % 64"))
    rows = sorted((r["slot"], r["counts"]) for r in summed(parts.select("slot", "part", "counts")).collect())  # as many numbers as terms
    out = np.concatenate([np.frombuffer(x, np.uint32) for _, x in rows]) if rows else np.zeros(len(terms) + 1, np.uint32)
    return out[:-1].astype(float), int(out[-1])


def toxicity(docs: DataFrame, examples: Examples) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, score, predicted, evidence.

    score is the probability of label 1, predicted 1 from 0.5 on; evidence lists the nearest labelled
    examples (doc_id, cosine, label), at most three. Texts without words, empty and null ones included, have no
    neighbours: they score by the prior and have no evidence. Only the text is an input; repeated rows are
    judged alike, very long texts whole. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(examples)

    def score(batches: Batches) -> Batches:
        model = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            for lo, rows, found, cosine in _neighbours(batch["text"], model):
                p = model.scores(found, cosine)
                first = [[{"doc_id": int(model.doc[f]), "cosine": float(c), "label": int(model.label[f])} for f, c in zip(fs[:3], cs[:3], strict=True) if c > 0] for fs, cs in zip(found, cosine, strict=True)]
                yield pa.record_batch([batch["doc_id"].slice(lo, rows), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(first, kind)], names=["doc_id", "score", "predicted", "evidence"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,label:int>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, schema)


def without_toxic(docs: DataFrame, examples: Examples, threshold: float = 0.5) -> DataFrame:
    """docs without rows whose text scores the threshold or more; all columns stay as they are, other rows are kept as often as they come."""
    shared = docs.sparkSession.sparkContext.broadcast(examples)

    def keep(batches: Batches) -> Batches:
        model = shared.value
        for batch in batches:
            scores = np.concatenate([model.scores(found, cosine) for _, _, found, cosine in _neighbours(batch["text"], model)] or [np.zeros(0)])
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(keep, docs.schema)
