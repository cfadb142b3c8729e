"""Every stage of the corpus pipeline, and the whole of it, against plain Python."""

import random
import re

import numpy as np

from meshgrain.llm import toxicity
from meshgrain.llm.secret_scan import ASSIGN, TOKEN
from tests.llm.data import documents, texts, words
from tests.llm.test_near_copies import brute
from tests.llm.test_scans import brute_spans, fill
from tests.llm.test_scores import corpus

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows, labels = corpus(260, 3, ["vileword", "badword", "nasty"])
    item = words(50, 15)
    rows += [(1000 + i, t) for i, t in enumerate(texts())] + [(2000, " ".join(words(6, 30) + item[:12])), (2001, " ".join(item[:8])), (2002, "token=abcdefgh12 and " + "0123456789abcdef" * 2), (2003, "passwd: 'ghp_" + "aB3" * 8 + "'")]
    spark.createDataFrame([(d, 1, y) for d, y in labels[:200]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i", " ".join(item)), ("j", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    known = spark.read.parquet(str(tmp_path / "labels.parquet")).selectExpr("doc_id", "toxic as label")
    model = toxicity.fit(docs, known)
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, model).collect() if r["score"] >= 0.5}
    held = dict(labels[200:])
    assert sum(held[d] for d in held if d in toxic) > 0 and np.mean([(d in toxic) == bool(y) for d, y in held.items()]) > 0.8
    want = {d: t for d, t in rows if d not in toxic}
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        nonlocal docs
        stages[name](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        assert name == "mixing" or docs.columns == columns
        return {r["doc_id"]: r for r in docs.collect()}

    assert {d: r["text"] for d, r in run("toxicity").items()} == want
    want = {d: want[d] for d in {c for _, c in brute(list(want.items()), 5, 80).values()}}
    assert {d: r["text"] for d, r in run("ngram_join").items()} == want
    windows = {tuple(item[i : i + 10]) for i in range(6)}
    windows = {tuple(lower(w) for w in x) for x in windows}
    held_words = {d: WORD.findall(lower(t)) for d, t in want.items()}
    hit = {d for d, w in held_words.items() if any(tuple(w[i : i + 10]) in windows for i in range(len(w)))}
    assert 2000 in hit and 2001 not in hit
    want = {d: t for d, t in want.items() if d not in hit}
    assert {d: r["text"] for d, r in run("decontamination").items()} == want
    assert re.search(TOKEN, want[2003]) and re.search(ASSIGN, want[2003])
    for d, t in want.items():
        out, at = [], 0
        for start, _, end in brute_spans(t or ""):
            out += [t[at:start], "[secret]"] if start >= at else []
            at = max(at, end)
        want[d] = "".join(out) + t[at:] if out else t
    found = run("secret_scan")
    assert {d: r["text"] for d, r in found.items()} == want and all(r["n_chars"] == len(want[d] or "") for d, r in found.items())
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in want.items()}
    names = sorted({source[d] for d in want}, key=lambda s: (s is None, s or ""))
    total = [sum(n for d, n in sizes.items() if source[d] == s) for s in names]
    target = dict(zip(names, fill(total, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    mixed = run("mixing")
    assert set(mixed) == set(want)
    for s in names:
        rows_ = [r for d, r in mixed.items() if source[d] == s]
        assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] and abs(r["target"] - target[s]) < 1e-6 for r in rows_)
        assert sum(r["taken"] for r in rows_) == int(rows_[0]["target"])
    whole = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {d: (r["size"], r["taken"]) for d, r in whole.items()} == {d: (r["size"], r["taken"]) for d, r in mixed.items()}


def test_toxic_texts_of_mostly_plain_words_go(spark, tmp_path):
    """Two toxic words among hundreds of plain ones: of rows without a label too, nine toxic texts in ten go and nearly all others stay."""
    import corpus_pipeline

    r, rows, labels = random.Random(1), [], []
    for i in range(1500):
        w = [f"w{int(10000 * r.random() ** 2)}" for _ in range(r.randrange(200, 300))]
        labels.append((i, int(r.random() < 0.1)))
        for _ in range(2 * labels[i][1]):
            w[r.randrange(len(w))] = r.choice(["vileword", "badword", "nasty"])
        rows.append((i, " ".join(w)))
    spark.createDataFrame([(d, 1, y) for d, y in labels[:1000]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, documents(spark, rows), str(tmp_path)).collect()}
    assert np.mean([d not in left for d, y in labels[1000:] if y]) > 0.9
    assert np.mean([d in left for d, y in labels[1000:] if not y]) > 0.98


def test_stages_on_empty_repeated_and_clashing_rows(spark, tmp_path):
    """Every stage takes an empty table, rows that come several times, and columns with the names that operators use inside."""
    import corpus_pipeline

    from pyspark.sql import functions as F

    rows, labels = corpus(80, 5, ["vileword", "badword"])
    spark.createDataFrame([(d, 1, y) for d, y in labels[:60]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i", " ".join(words(50, 15)))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clash = ("_w0", "_range", "_place", "_hit_words", "_items", "term", "fragment", "doc", "label", "at", "keys", "row", "size")
    docs = documents(spark, rows + rows[:20] + [(None, None), (None, "no id"), (9999, "")]).withColumns({c: F.lit(c) for c in clash})
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if n + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.where(" or ".join(f"{c} is null" for c in clash)).count() == 0
        left = {r["doc_id"] for r in out.select("doc_id").collect()}
        times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
        assert all(times[d] == 2 for d in range(20) if d in left) and {None, 9999} <= left
        docs = out
