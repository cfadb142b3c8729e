import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from meshgrain.llm import anchors, induced_sort
from meshgrain.llm.fm_index import FMIndex
from meshgrain.llm.induced_sort import SuffixQueue, suffixes
from meshgrain.llm.substring_dedup import digest as words_digest, repeated, substring_dedup
from meshgrain.llm.suffix_dedup import digest as bytes_digest, suffix_dedup
from tests.llm.data import documents, texts, words

AWKWARD = list(enumerate(texts())) + [(2, texts()[11]), (40, "ab" * 300 + "\0" + "ab" * 300), (41, "é" * 250), (41, "é" * 250)]


def brute_words(rows, width):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in docs:
        hit = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                hit[i : i + width] = [True] * width
        kept = [x for x, h in zip(w, hit, strict=True) if not h]
        out.append((d, len(w), sum(hit), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def brute_bytes(rows, width):
    docs = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, b in docs:
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] = seen.get(b[i : i + width], 0) + 1
    out = []
    for d, b in docs:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                mark[i] += 1
                mark[i + width] -= 1
        hit = np.cumsum(mark[:-1]) > 0
        spans = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        out.append((d, len(b), int(hit.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [1024, 7])
def test_word_windows_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(anchors, "MOST_WINDOWS", most)
    got = words_digest(substring_dedup(documents(spark, AWKWARD)))
    assert sorted(tuple(r) for r in got.collect()) == brute_words(AWKWARD, 50)


@pytest.mark.parametrize("most", [1024, 7])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_windows_repeated_inside_a_document(spark, monkeypatch, most, seed):
    """Document 2 has a passage again and again, also in rows of another text, document 1 has it once; so for a passage of 12 words."""
    monkeypatch.setattr(anchors, "MOST_WINDOWS", most)
    passage, short = words(200 + seed, 60), words(300 + seed, 12)
    rows = [(1, " ".join(words(5, 30) + passage + words(6, 30))), (2, " ".join(passage * 40)), (2, " ".join(words(7, 20) + passage * 3 + words(8, 20)))]
    rows += [(3, " ".join(words(9, 30) + short * 6)), (4, " ".join(short * 50)), (-(2**63), " ".join(passage[:55] + words(10, 5)))]
    got = words_digest(substring_dedup(documents(spark, rows)))
    assert sorted(tuple(r) for r in got.collect()) == brute_words(rows, 50)


@pytest.mark.parametrize("most", [1024, 7])
def test_byte_windows_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(anchors, "MOST_WINDOWS", most)
    got = bytes_digest(suffix_dedup(documents(spark, AWKWARD)))
    assert sorted(tuple(r) for r in got.collect()) == brute_bytes(AWKWARD, 200)


def test_short_windows_and_null_numbers(spark):
    rows = [(None, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "z a b c d e f g"), (3, "")]
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring_dedup(documents(spark, rows), width=5, gram=2).collect()}
    assert got == {None: (0, "a b c d e f g h"), 1: (0, "a b c d e f g h"), 2: (7, "z"), 3: (0, "")}
    both = {r["doc_id"]: r["n_removed"] for r in suffix_dedup(documents(spark, rows), width=5, gram=2).collect()}
    assert both == {None: 15, 1: 15, 2: 13, 3: 0}


def test_empty_tables(spark):
    assert substring_dedup(documents(spark, [])).count() == 0
    assert suffix_dedup(documents(spark, [])).count() == 0


def sorted_suffixes(t, depth):
    """Positions in falling order of the suffixes, and the prefix each shares with the one before."""
    order = sorted(range(len(t)), key=lambda i: t[i:].tolist(), reverse=True)
    shared = lambda a, b: next((k for k in range(depth) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), depth)
    return order, [0] + [shared(a, b) for a, b in zip(order, order[1:], strict=False)]


@pytest.mark.parametrize("block", [3, 1 << 15])
@pytest.mark.parametrize("budget", [0, 2000, 10**9])
def test_induced_sort(monkeypatch, block, budget):
    monkeypatch.setattr(induced_sort, "BLOCK", block)
    rng = np.random.default_rng(3)
    for i in range(60):
        t = np.tile(rng.integers(0, rng.integers(1, 5), int(rng.integers(1, 70))), 1 + i % 3)
        found = list(suffixes(t, 5, 1000, budget))
        assert tuple(np.concatenate(x).tolist() for x in zip(*found, strict=True)) == sorted_suffixes(t, 1000)
    assert list(suffixes(np.zeros(0, np.int64), 5, 9)) == []


@pytest.mark.parametrize("n", [1, 31, 32, 33, 64, 65, 5000])
@pytest.mark.parametrize("budget", [0, 1 << 20])
def test_least_values_of_ranges(monkeypatch, n, budget):
    monkeypatch.setattr(induced_sort, "BLOCK", 7)
    rng = np.random.default_rng(n)
    values = induced_sort.array(n, np.int64, budget)
    values[:] = rng.integers(0, 1000, n)
    minima = induced_sort.Minima(values, budget)
    lo, hi = np.sort(rng.integers(0, n, (2, 400)), axis=0)
    assert minima.least(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]
    assert all(isinstance(t, np.memmap) == (budget == 0) for t in minima.tables)


def test_texts_beyond_the_budget_go_to_disk(monkeypatch):
    """Queues of 8 KB for a text whose tuples take 640 KB: runs are written and the text of names recurses."""
    monkeypatch.setattr(induced_sort, "BLOCK", 64)
    spills, levels = [], []
    spill, texts_of = SuffixQueue._spill, induced_sort.Text.__init__
    monkeypatch.setattr(SuffixQueue, "_spill", lambda self: (spills.append(self.held), spill(self)))
    monkeypatch.setattr(induced_sort.Text, "__init__", lambda self, *a: (levels.append(len(a[0])), texts_of(self, *a))[1])
    t = np.random.default_rng(4).integers(0, 40, 20_000)
    t[11_000:11_900] = t[500:1_400]
    found = list(suffixes(t, 40, 200, 8 << 10))
    position, common = (np.concatenate(x) for x in zip(*found, strict=True))
    assert len(spills) > 20 and max(spills) < 13 << 10 and len(levels) > 2 and levels == sorted(levels, reverse=True)
    assert (position.tolist(), common.tolist()) == sorted_suffixes(t, 200)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 8, 9])
def test_intervals_are_those_of_common_prefixes(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 5, 300):
        text = np.r_[rng.integers(0, 3, n), 0]
        index = FMIndex(text, width)
        for length in (width - 1, width):
            # a suffix that ends sooner stands alone
            key = [tuple(text[i : i + length]) if i + length <= len(text) else (i,) * (length + 1) for i in index.order]
            lo, hi = index.intervals(length)
            assert [(key.index(k), len(key) - key[::-1].index(k)) for k in key] == list(zip(lo, hi, strict=True))


def test_index_alone_decides(monkeypatch):
    """Windows of a shard are told apart with all hash functions of words and runs of words made constant."""
    for name in ("word_hash", "mix"):
        monkeypatch.setattr(f"meshgrain.llm.words.{name}", lambda x, *a: np.zeros(np.shape(a[0] if a else x), np.uint64))
    rng = np.random.default_rng(8)
    rows = [(int(d), rng.integers(1, 4, int(rng.integers(5, 40))).astype(np.uint64)) for d in rng.integers(0, 9, 30)]
    doc, symbols = zip(*rows, strict=True)
    zeros = np.zeros(len(rows), np.int64)
    table = pa.table({"uid": np.arange(len(rows)), "doc_id": np.array(doc), "anchor": zeros, "content": zeros, "at": zeros, "symbols": [x.tobytes() for x in symbols]})
    got = {(r["uid"], i) for b in repeated(table, 5) for r in b.to_pylist() for i in range(r["start"], r["end"] - 4)}
    first = {}
    windows = [(uid, d, i, tuple(x[i : i + 5])) for uid, (d, x) in enumerate(rows) for i in range(len(x) - 4)]
    for _, d, _, w in windows:
        first[w] = min(first.get(w, d), d)
    assert got == {(uid, i) for uid, d, i, w in windows if first[w] < d} != set()


def test_backward_search():
    rng = np.random.default_rng(5)
    text = np.r_[rng.integers(1, 4, 400), 0]
    index = FMIndex(text, 8)
    for _ in range(50):
        p = rng.integers(1, 4, int(rng.integers(1, 8)))
        lo, hi = np.array([0]), np.array([len(text)])
        for c in p[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        assert hi[0] - lo[0] == sum((text[i : i + len(p)] == p).all() for i in range(len(text) - len(p) + 1))
