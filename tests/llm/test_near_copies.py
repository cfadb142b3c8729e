import random
import re

import pytest
from pyspark.sql import functions as F

from meshgrain.llm import common, ngram_join as nj
from tests.llm.data import classes, documents, texts


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1)))}


def brute(rows, size, percent):
    sets = {d: shingle_set(t, size) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in classes(sets, links).items()}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize(("size", "percent", "group"), [(4, 85, 4096), (5, 80, 4096), (4, 85, 2)])
def test_equals_brute_force(spark, monkeypatch, size, percent, group):
    """Also with groups split by salts, where documents of one n-gram stand apart."""
    monkeypatch.setattr(nj, "GROUP", group)
    rows = list(enumerate(texts()))
    assert found(nj.ngram_join(documents(spark), size, percent)) == brute(rows, size, percent)


def test_common_passages_are_not_paired(spark, monkeypatch):
    """Texts of 8 sentences out of 30, the last ones near copies: pairs that cannot link are not counted."""
    rng = random.Random(7)
    pool = [" ".join(f"s{i}w{j}" for j in range(14)) for i in range(30)]
    rows = [(d, " ".join(rng.sample(pool, 8))) for d in range(160)]
    rows += [(200 + d, rows[d][1] + f" end{d}") for d in range(0, 160, 5)]
    seen, tested = [], nj._untested
    monkeypatch.setattr(nj, "GROUP", 16)
    monkeypatch.setattr(nj, "_untested", lambda *a: seen.append(tested(*a)) or seen[-1])
    got = found(nj.ngram_join(documents(spark, rows), 4, 85))
    assert got == brute(rows, 4, 85)
    assert seen[0].count() < 400  # of 18,000


@pytest.mark.parametrize("times", [2, 7])
def test_repeated_rows_with_near_partners(spark, times):
    """Every row, or every third one, several times."""
    rows = list(enumerate(texts()))
    half = [(50 + d, " ".join(f"v{d}x{i}" for i in range(60)) + " " + " ".join(f"u{d // 2}x{i}" for i in range(60))) for d in range(8)]
    common = [(100 + i, " ".join([f"s{i}x{j}" for j in range(6)] + [f"c{j}" for j in range(97)])) for i in range(3)]
    for rows in (rows + half + common, common):
        for repeated in (rows, rows[::3]):
            got = nj.ngram_join(documents(spark, rows + repeated * (times - 1)), 4, 85)
            assert found(got) == brute(rows, 4, 85)


def test_empty_repeated_and_null(spark):
    assert nj.ngram_join(documents(spark, [])).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, None)]
    got = [(r["doc_id"], r["component_id"]) for r in nj.ngram_join(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(3, 3), (3, 3), (7, 3), (None, None), (9, 9)], key=str)


def test_components_of_path_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(df).collect()}
    assert got == {n: c for n, c in classes({x for e in edges for x in e}, edges).items() if n != 300}


def test_bloom_and_sketch(spark):
    keys = spark.range(0, 5000, 7)
    b = common.bloom(keys, "id").value
    assert all(k in b for k in range(0, 5000, 7)) and sum(k in b for k in range(10_000, 11_000)) < 100
    full = common.Bloom(b.bits | 255, b.power)
    assert 123456 in full
    counts = common.sketch(documents(spark).select("text"), lambda x: (h for *_, h in nj.shingles(x["text"], 4)), bits=8)
    assert counts.sum() == sum(max(len((t or "").split()) - 3, min(len((t or "").split()), 1)) for t in texts())


def test_keeps_one_of_each_group(spark):
    import corpus_pipeline

    docs = documents(spark)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    want = {c for _, c in brute(list(enumerate(texts())), 5, 80).values()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    assert kept.where(F.col("text").isNull()).count() == 1
