"""Near-duplicate join on word n-gram sets by vertical partitioning of one global n-gram order.

All n-grams stand in one global order, rare ones first (a frequency sketch of fixed size
gives the rank, the hash breaks ties). Pivots at equal shares of all occurrences cut that
order into fragments, and every document's sorted set with them.

1. Documents with the same set become one (their fingerprints meet in an aggregation).
2. Two sets with Jaccard >= t share one of the first `n - ceil(t * n) + 1` n-grams of each.
   These prefixes are dealt out by n-gram; a frequent n-gram is split by a salt into groups
   whose expected size is bounded. In each group every document is paired with one of fitting
   size, so a group of copies costs rows in proportion to its members. A pair is tried only if
   what follows the shared n-gram in both sets can be overlap enough (positional filter).
3. Overlaps are counted one fragment at a time for the pairs found, and summed for each pair.
   After the first fragment a pair goes on only if what already differs there leaves it a chance.
4. Where documents of one prefix n-gram are still in different components, those pairs are
   counted too, but for those that the triangle inequality or the parities of their sets rule
   out; a frequent n-gram is dealt to several tasks by a salt. Components again.

Only tables the size of prefixes and of candidate documents are shuffled, never texts. A set
is held as 64-bit keys: 58 bits of hash under 6 bits of rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshgrain.llm.common import LEVEL_BITS, Batches, bloom, components, levels, most_of_level, order_keys, sketch, stash
from meshgrain.llm.words import LOWER, NOT_SPACE, Words, chunks, mix, word_hash, word_sums

#: Documents of one n-gram that are dealt to one group, as expected from the sketch.
GROUP = 4096
#: In groups up to this size, documents that no other can link with through this n-gram leave at once.
SMALL = 64
#: Bits of a set's parity signature: how many of its n-grams fall in each of them, odd or even.
PARITIES = 1024


def shingles(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, row of each shingle, its hash); repeats included."""
    for lo, hi, data, offsets in chunks(column):
        words = Words(data, offsets, LOWER, NOT_SPACE)
        sums = word_sums(words.hashes())
        at = np.flatnonzero(words.bound[words.row + 1] - np.arange(len(words.row)) >= size)
        row, hashes = words.row[at], word_hash(sums, at, at + size)
        short = np.flatnonzero((words.count > 0) & (words.count < size))
        if len(short):
            row = np.r_[row, short]
            hashes = np.r_[hashes, word_hash(sums, words.bound[short], words.bound[short + 1])]
        yield lo, hi - lo, row, hashes


def sets(batch: pa.RecordBatch, size: int, level: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, bounds of each row, sorted distinct keys)."""
    for lo, rows, row, hashes in shingles(batch["text"], size):
        keys = order_keys(hashes, level)
        at = np.lexsort((keys, row))
        row, keys = row[at], keys[at]
        new = np.ones(len(keys), bool)
        new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
        row, keys = row[new], keys[new]
        yield lo, rows, np.searchsorted(row, np.arange(rows + 1)), keys


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return (n * percent + 99) // 100


def parities(keys: np.ndarray, bound: np.ndarray) -> pa.Array:
    """PARITIES bits for each row's set, as longs: two sets differ in at least as many n-grams as in bits."""
    rows = len(bound) - 1
    cell = np.repeat(np.arange(rows), np.diff(bound)) * PARITIES + (mix(keys) % np.uint64(PARITIES)).astype(np.int64)
    odd = (np.bincount(cell, minlength=rows * PARITIES) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (PARITIES // 64)), pa.array(np.packbits(odd).view(np.int64)))


def _packed(keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """A binary array of slices that follow each other in the given order."""
    sizes = (end - start).astype(np.int64)
    at = np.repeat(start - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    offsets = np.r_[0, np.cumsum(sizes * 8)].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys[at]))]).cast(pa.binary())


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80, fragments: int = 8) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, copy_of.

    Documents link when 100 * intersection >= percent * union of their sets of distinct word
    n-grams (A-Z lower-cased); component_id is the smallest doc_id reachable by links, copy_of
    the smallest doc_id with the same set. With fewer than `size` words the whole sequence is
    one n-gram. Null or wordless texts have an empty set and link with nothing; a null doc_id
    keeps its row, with null ids, and links with nothing; a row may be repeated, but a doc_id
    stands for one text. Other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    occurrences = sketch(docs.select("text"), lambda b: (h for *_, h in shingles(b["text"], size)))
    level = levels(occurrences)
    ranks = spark.sparkContext.broadcast(level)
    pivots = _pivots(occurrences, level, fragments)

    def prefixes(batches: Batches) -> Batches:
        for batch in batches:
            for lo, rows, bound, keys in sets(batch, size, ranks.value):
                n = np.diff(bound)
                total = np.r_[np.uint64(0), np.cumsum(mix(keys), dtype=np.uint64)]
                other = np.r_[np.uint64(0), np.cumsum(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]
                keep = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
                fp = [(x[bound[1:]] - x[bound[:-1]]).view(np.int64) for x in (total, other)]
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(lo, rows), "n": pa.array(n.astype(np.int64)), "fp1": pa.array(fp[0]), "fp2": pa.array(fp[1]), "prefix": _packed(keys, bound[:-1], bound[:-1] + keep), "sign": parities(keys, bound)})

    made = stash(docs.mapInArrow(prefixes, "doc_id long, n long, fp1 long, fp2 long, prefix binary, sign array<long>"))
    rep = made.where("n > 0 and doc_id is not null").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("doc"), F.first("prefix").alias("prefix"))
    groups = _groups(rep, percent)
    tried = groups.select(F.col("rep").alias("a"), F.col("doc").alias("b")).unionAll(groups.select(F.col("before").alias("a"), F.col("doc").alias("b"))).where("a is not null and a <> b")
    tried = stash(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    cut = _cut(docs, size, ranks, pivots)
    counts = stash(_overlaps(tried, _parts(cut, tried), percent, fragments))
    linked = lambda counted: counted.where(f"100 * both >= {percent} * (n_a + n_b - both)").select("a", "b")
    links = stash(linked(counts))
    signs = made.where("n > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.first("sign").alias("sign"))
    more = _untested(groups, counts, components(links), tried, signs, percent)
    label = components(links.unionAll(linked(_overlaps(more, _parts(cut, more), percent, fragments))))
    copy = made.where("n > 0 and doc_id is not null").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("copy_of"))
    out = made.select("doc_id", "n", "fp1", "fp2").join(copy, ["n", "fp1", "fp2"], "left").join(label.withColumnRenamed("node", "copy_of"), "copy_of", "left")
    known = lambda *c: F.when(F.col("doc_id").isNotNull(), F.coalesce(*c, "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), known("component", "copy_of").alias("component_id"), known("copy_of").alias("copy_of"))


def _pivots(counts: np.ndarray, level: np.ndarray, fragments: int) -> np.ndarray:
    """Keys that cut the global order into fragments with equal shares of all occurrences."""
    mass = np.bincount(level.astype(np.int64), weights=counts, minlength=64)
    ends = np.r_[0, np.cumsum(mass)]
    want = ends[-1] * np.arange(1, fragments) / fragments
    at = np.clip(np.searchsorted(ends, want, "right") - 1, 0, 63)
    share = (want - ends[at]) / np.maximum(mass[at], 1)
    width = 1 << (64 - LEVEL_BITS)
    return np.array([(int(l) << (64 - LEVEL_BITS)) + min(int(s * width), width - 1) for l, s in zip(at, share, strict=True)], np.uint64)


def _groups(rep: DataFrame, percent: int) -> DataFrame:
    """Prefix n-grams of two documents or more: key, doc, n, rep (a document to try), before (one more)."""

    def spread(batches: Batches) -> Batches:
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch["prefix"].to_pylist()], np.int64)
            if not len(sizes):
                continue
            keys = np.frombuffer(b"".join(batch["prefix"].to_pylist()), np.uint64)
            doc, n = (np.repeat(batch[c].to_numpy(), sizes) for c in ("doc", "n"))
            most = most_of_level(keys >> np.uint64(64 - LEVEL_BITS))
            salts = np.ceil(most / GROUP).astype(np.uint64)
            salt = (mix(doc.view(np.uint64)) % salts).astype(np.int32)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.record_batch({"key": pa.array(keys.view(np.int64)), "salt": pa.array(salt), "doc": pa.array(doc), "n": pa.array(n.astype(np.int32)), "place": pa.array(place.astype(np.int32))})

    def pair(batches: Batches) -> Batches:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        key, salt, doc, n, place = (table[c].to_numpy() for c in ("key", "salt", "doc", "n", "place"))
        at = np.lexsort((doc, n, salt, key))
        key, salt, doc, n, place = key[at], salt[at], doc[at], n[at].astype(np.int64), place[at].astype(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        size = np.diff(np.r_[np.flatnonzero(new), len(key)])
        alone = (np.repeat(size, size) == 1) & (salt == 0) & (most_of_level(key.view(np.uint64) >> np.uint64(64 - LEVEL_BITS)) <= GROUP)
        key, doc, n, place, new = key[~alone], doc[~alone], n[~alone], place[~alone], new[~alone]
        group = np.cumsum(new) - 1
        rep = np.full(len(key), -1)
        while (open_ := np.flatnonzero(rep < 0)).size:
            first = open_[np.r_[True, group[open_][1:] != group[open_][:-1]]]
            lead = np.repeat(first, np.diff(np.r_[np.searchsorted(open_, first), len(open_)]))
            fits = n[open_] * percent <= n[lead] * 100
            # of those of fitting size, the one with the fewest rarer n-grams stands for all: it is most like the others
            some, lead = open_[fits], lead[fits]
            begin = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
            least = np.minimum.reduceat(place[some] * len(key) + some, begin) % len(key)
            rep[some] = np.repeat(least, np.diff(np.r_[begin, len(some)]))
        # where a new size begins, the document just before it may still fit
        begins = np.r_[False, rep[1:] != rep[:-1]] & ~new
        before = np.where(begins, np.arange(len(key)) - 1, -1)

        def may_link(i: np.ndarray) -> np.ndarray:
            """Whether what is left of both sets from this n-gram on can be overlap enough."""
            return (i >= 0) & ((100 + percent) * np.minimum(n - place, n[i] - place[i]) >= percent * (n + n[i]))

        # rows without any partner in a small group are done with; whole n-grams stand in one group up to GROUP
        inner, size = _inside(group)
        keep = (size > SMALL) | (most_of_level(key.view(np.uint64) >> np.uint64(64 - LEVEL_BITS)) > GROUP)
        for step in range(1, SMALL):
            i = np.flatnonzero((inner + step < size) & (size <= SMALL))
            if not len(i):
                break
            j = i + step  # not smaller than i
            ok = (n[j] * percent <= n[i] * 100) & ((100 + percent) * np.minimum(n[i] - place[i], n[j] - place[j]) >= percent * (n[i] + n[j]))
            keep[i[ok]] = keep[j[ok]] = True
        partner = lambda i: pa.array(doc[i][keep], mask=~may_link(i)[keep])
        yield pa.record_batch({"key": pa.array(key[keep]), "doc": pa.array(doc[keep]), "n": pa.array(n[keep]), "place": pa.array(place[keep]), "rep": partner(rep), "before": partner(before)})

    spread_out = rep.select("doc", "n", "prefix").mapInArrow(spread, "key long, salt int, doc long, n int, place int").repartition("key", "salt")
    return stash(spread_out.mapInArrow(pair, "key long, doc long, n long, place long, rep long, before long"))


def _inside(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row in its group and the group's size, for group numbers in order."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(group)])
    return np.arange(len(group)) - np.repeat(first, size), np.repeat(size, size)


def _untested(groups: DataFrame, counts: DataFrame, label: DataFrame, tried: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs of one prefix n-gram, of fitting sizes, in different components and not tried before.

    What follows the n-gram in both sets must be enough for a link: if an earlier one is shared
    too, the pair is found there. What both differ in from the document they were paired with tells that they differ at
    least by the difference of the two numbers; pairs for which that is too much are left out, and
    so are those whose parities differ too often. An n-gram of many documents is joined in
    parts of GROUP documents, each with all of them.
    """
    off = counts.select(F.col("a").alias("rep"), F.col("b").alias("doc"), (F.col("n_a") + F.col("n_b") - 2 * F.col("both")).alias("off"))
    off = off.unionAll(off.select(F.col("doc").alias("rep"), F.col("rep").alias("doc"), "off"))
    named = groups.select("key", "doc", "n", "place", "rep").join(label.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", "place", "rep", F.coalesce("component", "doc").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held")).where("lo < hi").select("key", F.ceil(F.col("held") / GROUP).cast("int").alias("salts"))
    left = named.join(mixed, "key").join(off, ["rep", "doc"], "left").join(signs, "doc")
    left = stash(left.withColumn("off", F.when(F.col("rep") == F.col("doc"), 0).otherwise(F.col("off"))))
    columns = ("doc", "n", "place", "rep", "component", "off", "sign")
    salt = {"a": F.expr("cast(pmod(xxhash64(doc), salts) as int)"), "b": F.explode(F.expr("sequence(0, salts - 1)"))}
    a, b = (left.select("key", salt[side].alias("salt"), *(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "ab")
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    rest = f"{100 + percent} * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)"
    near = f"(coalesce(rep_a <> rep_b, true) or off_a is null or off_b is null or {100 + percent} * abs(off_a - off_b) <= {100 - percent} * (n_a + n_b))"
    unlike = " + ".join(f"bit_count(sign_a[{i}] ^ sign_b[{i}])" for i in range(PARITIES // 64))
    even = f"{100 + percent} * ({unlike}) <= {100 - percent} * (n_a + n_b)"
    pairs = a.join(b, ["key", "salt"]).where(f"doc_a < doc_b and component_a <> component_b and {fits} and {rest} and {near} and {even}")
    return stash(pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))


def _cut(docs: DataFrame, size: int, ranks, pivots: np.ndarray):
    """A function from wanted documents (a Bloom filter) to their fragments: (doc, fragment, n, part)."""
    f_all = len(pivots) + 1

    def of(wanted) -> DataFrame:
        def cut(batches: Batches) -> Batches:
            for batch in batches:
                batch = batch.filter(pa.array(wanted.value.has(batch["doc_id"].to_numpy())))
                for lo, rows, bound, keys in sets(batch, size, ranks.value):
                    row = np.repeat(np.arange(rows), np.diff(bound))
                    cell = row * f_all + np.searchsorted(pivots, keys, "right")
                    edge = np.searchsorted(cell, np.arange(rows * f_all + 1))
                    doc = np.repeat(batch["doc_id"].to_numpy()[lo : lo + rows], f_all)
                    yield pa.record_batch({"doc": pa.array(doc), "fragment": pa.array(np.tile(np.arange(f_all, dtype=np.int32), rows)), "n": pa.array(np.repeat(np.diff(bound), f_all)), "part": pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(keys.view(np.int64)))})

        return docs.where("doc_id is not null").mapInArrow(cut, "doc long, fragment int, n long, part array<long>")

    return of


def _parts(cut, pairs: DataFrame) -> DataFrame:
    return stash(cut(bloom(pairs.select(F.col("a").alias("doc")).unionAll(pairs.select(F.col("b").alias("doc"))).distinct(), "doc")))


def _counted(pairs: DataFrame, parts: DataFrame, fragments: range) -> DataFrame:
    """Partial overlaps of pairs (a, b) in each chosen fragment, summed for each pair: both, either, n_a, n_b.

    Both joins are on (document, fragment), so the parts are dealt out once for the two, and
    those of a repeated row become one there.
    """
    part = parts.where(F.col("fragment").between(fragments[0], fragments[-1])).dropDuplicates(["doc", "fragment"])
    a, b = (part.select(F.col("doc").alias(side), "fragment", F.col("n").alias(f"n_{side}"), F.col("part").alias(f"part_{side}")) for side in "ab")
    each = pairs.withColumn("fragment", F.explode(F.array(*(F.lit(f) for f in fragments))))
    each = each.join(a, ["a", "fragment"]).join(b, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("both"), (F.size("part_a") + F.size("part_b")).alias("either"))
    return each.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("both").alias("both"), F.sum("either").alias("either"))


def _overlaps(pairs: DataFrame, parts: DataFrame, percent: int, fragments: int) -> DataFrame:
    """(a, b, n_a, n_b, both) of the pairs that may link. A link differs in at most
    (100 - percent) / (100 + percent) of n_a + n_b, so a pair that differs more in the first
    fragment alone goes no further."""
    first = stash(_counted(pairs, parts, range(1)).where(f"{100 + percent} * (either - 2 * both) <= {100 - percent} * (n_a + n_b)"))
    rest = _counted(first.select("a", "b"), parts, range(1, fragments)).select("a", "b", F.col("both").alias("more"))
    return first.join(rest, ["a", "b"], "left").select("a", "b", "n_a", "n_b", (F.col("both") + F.coalesce("more", F.lit(0))).alias("both"))
