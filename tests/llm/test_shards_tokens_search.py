import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from meshgrain.llm import lexical_search as search
from meshgrain.llm import sharding
from meshgrain.llm import token_alignment as tokens
from tests.llm.data import documents, texts, words

ODD = [
    "", None, " ", "   ", "a", " a  b ", "\n \n x\t y", "x\x1c y", "<|endoftext|> and <s> </s> <0x41>", "naïve café   Ω≈ç√", "漢字 かな 漢字漢字", "🙂🙂 👩‍👩‍👧", "é ﬁ ﬀ",
    "▁tricky ▁", "don't we'll  'tis 12345 67", "x" * 3000, "tab\t\ttab  \n\n end ", "\x00\x01 \x7f", "ÅÅ ǅ ⅷ", "a" + " " * 500 + "b", "﻿bom",
]


# ---- sharding


def near_equal(rows, shards, order):
    """Shards by a plain walk along the rows in order."""
    total, at, out, slots = sum(r[1] for r in rows), 0, [], Counter()
    for r in sorted(rows, key=order):
        k = min(shards - 1, (2 * at + r[1]) * shards // (2 * total))
        out.append((*r, k, slots[k]))
        slots[k] += 1
        at += r[1]
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, tmp_path, shards):
    rows = list(enumerate(texts())) + [(None, "no id"), (None, None), (3, "other"), (3, "other"), (3, None), (10**12, "é" * 700)]
    docs = documents(spark, rows).drop("shard")
    docs.write.parquet(str(tmp_path / "docs"))
    got = sharding.digest(spark.read.parquet(str(tmp_path / "docs")), shards).collect()
    raw = [(t or "").encode() for _, t in rows]
    want = near_equal([(d, len(b) + 1, zlib.crc32(b)) for (d, _), b in zip(rows, raw, strict=True)], shards, lambda r: (r[0] is not None, r[0] or 0, r[1]))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got), key=lambda r: (r[3], r[4])) == sorted(want, key=lambda r: (r[3], r[4]))
    assert sorted(map(key, want)) == sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) and {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_a_row_repeated_very_often(spark, tmp_path):
    """Half of the rows are alike; they are spread over ranges and shards, and all slots are there."""
    spark.range(4000).selectExpr("if(id % 2 = 0, 7, id) as doc_id", "'same' as text", "id as shard", "id as slot", "id as _w0").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = sharding.digest(docs).collect()
    assert [n for _, n in sorted(Counter(r["shard"] for r in got).items())] == [500] * 8
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(500)) for k in range(8))
    ranges = sharding.running_sums(docs.select("doc_id"), ["doc_id"], {"n": sharding.F.lit(1)}, numbered=True)
    assert sorted(r["n"] for r in ranges.collect()) == list(range(4000))


def test_shards_of_nothing_and_as_files(spark, tmp_path):
    assert sharding.digest(documents(spark, [])).count() == 0
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    sharding.write_shards(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "out"), 4, rows_per_file=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"] or "") for r in back.collect()) == sorted((i, t or "") for i, t in enumerate(texts()))
    for k in range(4):
        part = spark.read.parquet(str(tmp_path / f"out/shard={k}")).selectExpr("doc_id", "slot", "_metadata.file_name as f").collect()
        assert [r["doc_id"] for r in sorted(part, key=lambda r: r["slot"])] == sorted(r["doc_id"] for r in part)
        assert all(len({r["slot"] // 3 for r in part if r["f"] == f}) == 1 for f in {r["f"] for r in part})


# ---- tokens


@pytest.fixture(scope="module")
def plain_tokenizers():
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, tokens.Tokenizers.of(tokens.FOLDER).b


def plain_alignment(text, tools):
    """(a, b, groups, links) by whole-text tokenizers and sets of byte places."""
    if not text:
        return [], [], [], []
    a, b = tools[0].encode(" " + text, add_special_tokens=False).ids, tools[1].encode(text)
    signs = tokens.byte_signs()
    vocabulary = {i: w for w, i in tools[0].get_vocab().items()}
    bytes_a = [bytes(signs[c] for c in vocabulary[i]) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(tools[1].id_to_piece, b)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, x, y = [], 0, 0
    place_a, place_b = ({e: i for i, e in enumerate(ends)} for ends in (end_a, end_b))
    for e in sorted(set(end_a) & set(end_b)):
        p, q = place_a[e] + 1, place_b[e] + 1
        groups.append((a[x:p], b[y:q]))
        x, y = p, q
    links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(end_a[i] - len(bytes_a[i]), end_b[j] - len(bytes_b[j])) < min(end_a[i], end_b[j])] if len(a) < 400 else None
    return a, b, groups, links


def test_alignment_of_whole_texts(spark, plain_tokenizers, monkeypatch):
    rows = list(enumerate([*ODD, *texts()[:14], " ".join(words(5, 60)) + "  \n" + "漢字" * 9]))
    for piece, lane in ((1 << 20, 48), (37, 2)):
        monkeypatch.setattr(tokens, "PIECE", piece)
        monkeypatch.setattr(tokens, "LANE", lane)
        batch = pa.record_batch({"doc_id": pa.array([d for d, _ in rows]), "text": pa.array([t for _, t in rows])})
        class Same:  # the function that runs on workers, in this process, where the sizes are set
            schema = {"doc_id": type("F", (), {"dataType": type("T", (), {"simpleString": staticmethod(lambda: "long")})})}
            select = lambda self, *c: self
            mapInArrow = lambda self, f, schema: next(f(iter([batch])))  # noqa: E731, N815
        got = tokens.alignment(Same()).to_pylist()
        for r, (d, t) in zip(got, rows, strict=True):
            a, b, groups, links = plain_alignment(t, plain_tokenizers)
            assert r["doc_id"] == d and r["a"] == a and r["b"] == b, t
            assert r["group_a"] == [len(g[0]) for g in groups] and r["group_b"] == [len(g[1]) for g in groups]
            assert links is None or list(zip(r["link_a"], r["link_b"], strict=True)) == links


def brute_counts(rows, tools):
    done = [plain_alignment(t, tools) for _, t in rows]
    pairs = []
    for a, b, groups, _ in done:
        held, x, y = Counter(), 0, 0
        for ga, gb in groups:  # inside a group the byte ranges overlap as two pointers pass them
            pairs_here, p, q = 0, 0, 0
            size = lambda ids, of: [len(of[i]) for i in ids]
            t = tokens.Tokenizers.of(tokens.FOLDER)
            ea, eb = np.cumsum(size(ga, t.bytes_a)), np.cumsum(size(gb, t.bytes_b))
            for e in sorted({*ea.tolist(), *eb.tolist()}):
                held[ga[int(np.searchsorted(ea, e))], gb[int(np.searchsorted(eb, e))]] += 1
        pairs.append(held)
    count = Counter(p for held in pairs for p in held)
    best: dict = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    for (d, _), (a, b, groups, _), held in zip(rows, done, pairs, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (d, len(a), len(b), len(groups), sum(held.values()), sum(n for p, n in held.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in held.items()), sha256(text.encode()).hexdigest() if text else "")


FIGURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_alignment_counts(spark, plain_tokenizers, monkeypatch, broadcast):
    monkeypatch.setattr(tokens, "BROADCAST_PAIRS", broadcast)
    rows = list(enumerate([*ODD, *texts()])) + [(None, "no id here"), (3, "one two"), (3, "one two")]
    got = tokens.alignment_counts(documents(spark, rows))
    assert got.columns == FIGURES
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_counts(rows, plain_tokenizers), key=str)
    assert tokens.alignment_counts(documents(spark, [])).count() == 0
    assert [r["n_links"] for r in tokens.alignment_counts(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_the_query_against_brute_force(spark, plain_tokenizers):
    from meshgrain.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001").select(*FIGURES)
    assert sorted(map(tuple, got.collect())) == sorted(brute_counts(docs, plain_tokenizers))


@pytest.mark.parametrize("seed", range(6))
def test_diagonals(seed):
    """Random end arrays: long one-to-one stretches, irregular groups, many or few lanes."""
    r = random.Random(seed)
    common = sorted(r.sample(range(1, 6000), 900))
    ends = [np.array(sorted({*common, 6000, *(r.sample(range(1, 6000), k))}), np.int64) for k in (r.choice([3, 300, 2000]), r.choice([2, 400]))]
    both = np.intersect1d(*ends)
    starts = np.r_[0, np.sort(r.sample(both[:-1].tolist(), seed * 20))].astype(np.int64) if seed else np.array([0])
    lanes = [np.r_[0, np.searchsorted(e, starts[1:]) + 1] for e in ends]
    got = tokens.align(*ends, *lanes)
    assert all((e[m] == both).all() for e, m in zip(ends, (got.ends_a, got.ends_b), strict=True))
    every = np.union1d(*ends)
    want = sorted(zip(*(np.searchsorted(e, every) for e in ends), strict=True))
    assert sorted(zip(got.a, got.b, strict=True)) == want


# ---- search


def brute_search(rows, items, most):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    split = lambda t: term.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    docs = [(d, Counter(split(t))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in {i for i in items if i[1] is not None}:
        scored = []
        for d, c in docs:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            scored.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:most]) if s < 0]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [10**6, 12])
@pytest.mark.parametrize("most", [1, 10])
def test_search(spark, monkeypatch, block, most):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    monkeypatch.setattr(search, "CELLS", 40)
    rows = list(enumerate(texts())) + [(None, "one two w1"), (None, "one two w1"), (5, "w7 W7 é"), (5, "w7 W7 é"), (90, "İ ǅ straße _x_ a-b")] + [(100 + i, "tie tie two") for i in range(30)]
    items = [("a", "W1 w2 w3 w3 two"), ("b", None), ("c", ""), (None, "tie w7"), ("d", "nowhere_found"), ("a", "W1 w2 w3 w3 two"), ("e", "straße x a B é"), ("f", " ".join(words(1, 300)))]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, rank int")
    got = search.lexical_search(documents(spark, rows), bench, most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, items, most)


def test_search_of_nothing(spark):
    bench = spark.createDataFrame([("a", "one")], "item_id string, text string")
    assert search.lexical_search(documents(spark, []), bench).count() == 0
    assert search.lexical_search(documents(spark, [(1, None), (2, "!!")]), bench).count() == 0
    assert search.lexical_search(documents(spark), bench.limit(0)).count() == 0
