import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshgrain.llm import embedding_dedup as ed, quality, toxicity
from tests.llm.data import classes, documents

SMALL = "/root/testdata/sf0.01"


def corpus(n, seed, bad):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.3)
        w = [f"w{r.randrange(3000)}" for _ in range(r.randrange(5, 80))]
        if y:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    return rows, labels


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([[(p > q) + 0.5 * (p == q) for q in neg] for p in pos])


EDGE = [(-1, None), (-2, ""), (-3, "  \n"), (-4, "w1 " * 20000), (None, "w1 w2")]


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus(900, 1, ["vileword", "badword", "nasty"])
    docs = documents(spark, rows + EDGE + rows[:3])
    known = spark.createDataFrame(labels[:600] + [(5, None), (6, 7), (None, 1), (10**9, 1)], "doc_id long, label int")
    model = toxicity.fit(docs, known)
    got = toxicity.toxicity(docs, model)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows) + len(EDGE) + 3
    assert auc([(by[i]["score"], y) for i, y in labels[600:]]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in by.values())
    assert by[-1]["score"] == by[-2]["score"] == model.prior and by[-1]["evidence"] == []
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = -1").count() == 1
    assert toxicity.toxicity(documents(spark, []), model).count() == 0
    nothing = toxicity.fit(documents(spark, []), known.limit(0))
    assert {r["score"] for r in toxicity.toxicity(docs, nothing).collect()} == {0.0}


def brute_toxicity(rows, labels, texts, k, prior):
    """The k nearest of each text and their votes, with dictionaries: {(doc_id, cosine)}, log odds."""
    import math
    import re
    from collections import Counter

    def words(text):
        found = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return Counter([("word", w) for w in found] + [("stem", w[:4]) for w in found])

    df = Counter(t for _, x in rows for t in words(x))
    shared = {t for d, x in rows if d in labels for t in words(x)}

    def vector(text):
        w = {t: (1 + math.log(n)) * math.log((1 + len(rows)) / (1 + (df[t] if t in shared else 1))) for t, n in words(text).items()}
        size = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / size for t, x in w.items()}

    examples = {d: vector(x) for d, x in rows if d in labels}
    n = Counter(labels.values())
    out = []
    for text in texts:
        v = vector(text)
        cosine = sorted(((sum(x * e.get(t, 0) for t, x in v.items()), d) for d, e in examples.items()), reverse=True)[:k]
        vote = sum(c**4 for c, _ in cosine)
        share = sum(c**4 * labels[d] for c, d in cosine) / vote if vote else prior
        size = sum(c > 0 for c, _ in cosine)
        p = min(max((share * size + 0.5 * prior) / (size + 0.5), 1e-9), 1 - 1e-9)
        out.append((cosine, math.log(p / (1 - p))))
    return out


@pytest.mark.parametrize("dense", [1024, 3])
def test_scores_equal_brute_force(spark, monkeypatch, dense):
    """Cosines of the nearest and the final score, recomputed with dictionaries; most terms in postings, or most in dense blocks."""
    monkeypatch.setattr(toxicity, "MOST_DENSE", dense)
    rows, labels = corpus(420, 2, ["a1xx", "b2yy", "c3zz"])
    docs = documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels[:330], "doc_id long, label int"))
    model.k, model.power = 9, 4
    known = dict(labels[:330])
    prior = sum(known.values()) / len(known)
    texts = [x for _, x in rows[300:]] + [None, "", "unseen words alone", rows[0][1] * 50]
    want = brute_toxicity(rows, known, texts, 9, prior)
    got = toxicity.toxicity(documents(spark, list(enumerate(texts))), model).orderBy("doc_id").collect()
    for r, (cosine, odds) in zip(got, want, strict=True):
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-model.curve[0] - model.curve[1] * odds)) if cosine[0][0] > 1e-9 else prior, abs=2e-4)
        assert [e["cosine"] for e in r["evidence"]] == pytest.approx([c for c, _ in cosine[:3] if c > 1e-6], abs=2e-6)
    assert model.curve != (0.0, 1.0)


def test_whole_words_count(spark):
    """Words that begin alike are different words, in any script."""
    import pyarrow as pa

    pairs = [("assassin classic", "assault classroom"), ("токсичный", "токсин"), ("漢字文化", "漢字圏")]
    for a, b in pairs:
        x, y = ({int(t) for _, _, _, h, _ in toxicity.term_counts(pa.array([text])) for t in h} for text in (a, b))
        assert len(x) == len(y) == 2 * len(a.split())
        assert len(x & y) == sum(v[:4] == w[:4] for v, w in zip(a.split(), b.split(), strict=True))
    rows = [(i, f"plain words here {'assassin' if i % 2 else 'assault'} number{i}") for i in range(80)]
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, label int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents(spark, [(0, "an assault"), (1, "an assassin")]), model).collect()}
    assert got[0] < 0.1 and got[1] > 0.9


def test_a_longer_text_keeps_its_neighbours(spark):
    """Words that no example holds change cosines, but neither the order of neighbours nor the score."""
    rows, labels = corpus(300, 9, ["a1xx", "b2yy"])
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels[:250], "doc_id long, label int"))
    texts = [x for _, x in rows[250:270]]
    got = toxicity.toxicity(documents(spark, list(enumerate(texts + [x + " never seen before" + " qqq" * 40 for x in texts]))), model).orderBy("doc_id").collect()
    for a, b in zip(got[:20], got[20:], strict=True):
        assert a["score"] == pytest.approx(b["score"], abs=1e-3) and [e["doc_id"] for e in a["evidence"]] == [e["doc_id"] for e in b["evidence"]]
        assert a["evidence"][0]["cosine"] > b["evidence"][0]["cosine"]


def test_the_curve_fits_votes_that_lie_close_together():
    """Votes within a narrow range, far from 0: the curve they were drawn by is found again, in any units; classes apart give a finite one."""
    r = np.random.default_rng(5)
    odds = r.normal(-1.9, 0.12, 20000)
    label = (r.random(len(odds)) < 1 / (1 + np.exp(-(43 + 24 * odds)))).astype(float)
    weight = np.where(label == 1, 0.5, 1.5)
    a, b = toxicity._logistic(odds, label, np.ones(len(odds)))
    assert abs(-a / b + 43 / 24) < 0.01 and abs(b / 24 - 1) < 0.1
    a, b = toxicity._logistic(odds, label, weight)
    p = 1 / (1 + np.exp(-(a + b * odds)))
    assert (weight * p).sum() == pytest.approx((weight * label).sum())
    c, d = toxicity._logistic(odds * 50 + 7, label, weight)
    assert np.abs(1 / (1 + np.exp(-(c + d * (odds * 50 + 7)))) - p).max() < 1e-6
    a, b = toxicity._logistic(np.r_[np.full(9, -2.0), np.full(9, -1.9)], np.repeat([0.0, 1.0], 9), np.ones(18))
    assert np.isfinite([a, b]).all() and b > 0 and a - 2.0 * b < -2 and a - 1.9 * b > 2
    a, b = toxicity._logistic(np.full(5, -1.0), np.array([0.0, 0, 0, 1, 0]), np.ones(5))
    assert b == 0 and 1 / (1 + np.exp(-a)) == pytest.approx(0.2)


def test_repeated_numbers_do_not_widen_the_sample(spark):
    rows, labels = corpus(60, 4, ["vileword"])
    known = spark.createDataFrame(labels, "doc_id long, label int")
    once, often = toxicity.fit(documents(spark, rows), known), toxicity.fit(documents(spark, rows + rows[:9] * 40), known)
    assert len(often.doc) == len(once.doc) == 60
    same = [quality.fit(documents(spark, r), known) for r in (rows, rows + rows[:9] * 40)]
    assert np.abs(same[0] - same[1]).max() < 1e-9


def test_training_equals_a_plain_loop(spark):
    """Follow the regularised leader written out feature by feature, one row at a time in one shard; empty shards change nothing."""
    import math
    from collections import defaultdict

    rows, labels = corpus(40, 6, ["$$$"])
    known = spark.createDataFrame(labels, "doc_id long, label int")
    docs = documents(spark, rows)
    weights = quality.fit(docs, known, shards=1, epochs=3, batch_rows=1)
    order = [r["doc_id"] for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    import pyarrow as pa

    z, n, a, b, l1, l2 = defaultdict(float), defaultdict(float), 1.0, 1.0, 0.01, 0.1
    w = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)
    texts, y = dict(rows), dict(labels)
    for _ in range(3):
        for d in order:
            ((_, _, _, place, value),) = quality.features(pa.array([texts[d]]))
            x = {int(p): float(np.float32(v)) for p, v in zip(place, value, strict=True)} | {1 << quality.BITS: 1.0}
            p = 1 / (1 + math.exp(-sum(w(i) * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y[d]) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a
                z[i] += g - sigma * w(i)
                n[i] += g * g
    assert np.allclose(weights, [w(i) for i in range((1 << quality.BITS) + 1)], atol=1e-6)
    one = spark.createDataFrame([(order[0], 1)], "doc_id long, label int")
    assert np.allclose(quality.fit(docs, one, shards=1), quality.fit(docs, one, shards=4))


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus(900, 3, ["$$$", "!!", "%%%"])
    docs = documents(spark, rows + EDGE + rows[:3])
    weights = quality.fit(docs, spark.createDataFrame(labels[:600] + [(5, None), (None, 1)], "doc_id long, label int"))
    got = quality.quality(docs, weights)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows) + len(EDGE) + 3
    assert auc([(by[i]["score"], y) for i, y in labels[600:]]) > 0.97
    assert by[-1]["score"] == by[-2]["score"] == by[-3]["score"]
    assert (quality.fit(docs, spark.createDataFrame(labels[:600], "doc_id long, label int")) == weights).mean() > 0.99
    nothing = quality.fit(documents(spark, []), spark.createDataFrame([], "doc_id long, label int"))
    assert {r["score"] for r in quality.quality(docs, nothing).collect()} == {0.5}


def test_quality_of_texts_of_separators(spark):
    """Separators and signs of another script are scored like other texts, each alike however often it comes."""
    rows, labels = corpus(60, 8, ["$$$"])
    weights = quality.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, label int"))
    odd = [(0, "、。「」"), (1, "、。「」"), (2, "\u3000\u3000"), (3, "؟ ؛"), (4, ""), (5, None)]
    got = {r["doc_id"]: r["score"] for r in quality.quality(documents(spark, odd), weights).collect()}
    assert got[0] == got[1] and got[4] == got[5] and all(0 <= x <= 1 for x in got.values())


@pytest.mark.parametrize("shard_rows", [64, 10**6])
def test_embeddings_equal_brute_force(spark, shard_rows):
    r = np.random.default_rng(4)
    centre = r.normal(size=(12, 16))
    x = [c + 0.02 * r.normal(size=16) * (1 + k % 5) for k in range(25) for c in centre] + list(r.normal(size=(100, 16)))
    rows = [(i, [float(a) for a in v], int(i % 2)) for i, v in enumerate(x)]
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 0), (1004, rows[0][1], None), (1005, [None] * 16, 0), (1006, [], 0), (1007, rows[0][1][:8], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*v, "clash") for v in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ed.embedding_links(df, shard_rows=shard_rows).collect()}
    good = [(i, np.array(v), y) for i, v, y in rows if i is not None and (i <= 1000)]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    label = np.array([y for *_, y in good])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    ids = [i for i, *_ in good]
    links = {ids[a]: int(near[a].sum()) for a in range(len(ids))}
    true = classes(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    assert sum(got[i][0] for i in ids) >= 0.98 * sum(links.values())
    assert all(got[i][0] <= links[i] for i in ids)
    assert np.mean([got[i][1] == true[i] for i in ids]) > 0.97
    assert all(got[i] == (0, i, True) for i in range(1001, 1008)) and got[None] == (0, None, False)
    assert ed.audit(df, ed.embedding_links(df, shard_rows=shard_rows)).first()["recall"] >= 0.95


@pytest.mark.parametrize("noise", [0.012, 0.002, 1e-10])
def test_one_dense_cluster(spark, noise):
    """Many unequal vectors round one centre, far more than a shard holds: nearly all pairs link, in the tighter ones all."""
    r = np.random.default_rng(1)
    centre = r.normal(size=64)
    x = centre / np.linalg.norm(centre) + noise * r.normal(size=(2000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, [float(a) for a in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = ed.embedding_links(df, shard_rows=600).collect()
    assert len(got) == 2000 and {g["component_id"] for g in got} == {0}
    assert all(g["n_links"] <= true[g["vec_id"]] for g in got)
    assert sum(g["n_links"] for g in got) >= 0.99 * true.sum()


def test_one_number_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (3, [0.01, 1.0], 0)]
    got = ed.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((g["vec_id"], g["n_links"], g["component_id"]) for g in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]


def test_no_embeddings(spark):
    assert ed.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert out.columns == docs.columns
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.75 * len(ids)
        ids, docs = kept, out
    one = docs.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert all(r["n"] == int(r["t"]) for r in one)
