import random
import re

import pytest
from pyspark.sql import functions as F

from meshgrain.llm import decontaminate, mixing, secret_scan
from meshgrain.llm.url_filters import PatternRule, url_filter
from tests.llm.data import documents, words


def test_secrets(spark):
    live = "ghp_" + "a1B2" * 6
    rows = [
        (0, f"é PassWord: 'hunter2hunter2' and token=short then {live}"),
        (1, "AKIA" + "X" * 12 + " AKIAX " + "0123456789abcdef" * 2),
        (2, None),
        (3, ""),
        (4, "secret:token: abcdefghij token=token=abcdefgh"),
        (5, "api_key = " + "Q" * 30),
        (5, "api_key = " + "Q" * 30),
        (None, "x " * 5000 + "passwd:abcdefgh"),
        (7, "ghp_" + "Zz9" * 8),
        (8, "ghp_" + "Zz9" * 8),
        (9, "ghp_" + "Zz9" * 8),
    ]
    got = secret_scan.digest(secret_scan.secret_spans(documents(spark, rows))).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["spans"] == f"assign:2:27,token:50:{50 + len(live)}" and by[0][0]["n_assign"] == 1
    assert by[1][0]["spans"] == "access:0:16,hex:23:55"
    assert by[2][0]["spans"] == by[3][0]["spans"] == ""
    assert by[4][0]["spans"] == "assign:25:45"
    assert len(by[5]) == 2 and by[5][0]["n_assign"] == 1
    assert by[None][0]["spans"] == "assign:10000:10015"
    assert [by[i][0]["spans"] for i in (7, 8, 9)] == [""] * 3  # three owners hold it: an example
    assert len(got) == len(rows)
    assert secret_scan.secret_spans(documents(spark, [])).count() == 0


def test_redaction(spark):
    rows = [(0, "a token=abcdefgh1 b " + "0123456789abcdef" * 2), (1, "plain"), (2, None), (3, "token=" + "0123456789abcdef" * 2)]
    out = {r["doc_id"]: r for r in secret_scan.redacted(documents(spark, rows)).collect()}
    assert [out[i]["text"] for i in range(4)] == ["a [secret] b [secret]", "plain", None, "[secret]"]
    assert out[0]["n_chars"] == len("a [secret] b [secret]") and out[1]["n_chars"] == 5
    assert secret_scan.redacted(documents(spark, rows)).columns == documents(spark, rows).columns


def brute_spans(text):
    """Base spans of one text by Python's own regular expressions: (start, kind, end)."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_a_text_of_many_matches(spark):
    """Three thousand matches of all kinds in one text, some of them overlapping; the time is in proportion."""
    r = random.Random(8)
    parts = ["token=abcdefgh%d", "é token=x%d", "AKIA%016d", "%032x", "secret: %040x", "Passwd='AKIA%014d'", "word%d \n"]
    text = " ".join(r.choice(parts) % r.randrange(10**9) for _ in range(3000))
    rows = [(0, text), (1, "plain"), (2, text[: len(text) // 2])]
    got = {x["doc_id"]: x for x in secret_scan.secret_spans(documents(spark, rows)).collect()}
    for d, t in rows:
        assert [(s["start"], s["kind_no"], s["end"]) for s in got[d]["spans"]] == brute_spans(t)
    out = {x["doc_id"]: x["text"] for x in secret_scan.redacted(documents(spark, rows)).collect()}
    want, at = [], 0
    for start, _, end in brute_spans(text):
        want += [text[at:start], "[secret]"] if start >= at else []
        at = max(at, end)
    assert out[0] == "".join(want) + text[at:] and out[1] == "plain"


def test_columns_with_inner_names(spark):
    docs = documents(spark, [(0, "a token=abcdefgh1"), (1, None)]).withColumns({c: F.lit(c) for c in ("_secrets", "_kept", "_found", "_spans", "_items", "_hit_words", "at", "sha", "salt")})
    out = secret_scan.redacted(docs).orderBy("doc_id").collect()
    assert out[0]["text"] == "a [secret]" and all(r[c] == c for r in out for c in ("_secrets", "_kept", "_spans", "_items"))
    bench = spark.createDataFrame([("b", "only this")], "item_id string, text string")
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and all(r["_items"] == "_items" and r["_hit_words"] == "_hit_words" for r in kept.collect())


def test_contamination(spark, monkeypatch):
    item = words(50, 15)
    bench = spark.createDataFrame([("b", " ".join(item)), ("a", "Two, words"), ("c", None), (None, "lonely item here"), ("d", "!!!"), ("b", " ".join(item))], "item_id string, text string")
    rows = [(0, "pre " + "".join(c.upper() if c.isascii() else c for c in ", ".join(item[2:13])) + " post"), (1, "x two WORDS y two words"), (2, None), (3, ""), (4, " ".join(item[:9])), (5, "a lonely item here"), (5, "a lonely item here")]
    for part, piece in ((10**9, 1000), (4, 1000), (4, 2)):
        monkeypatch.setattr(decontaminate, "PART_WINDOWS", part)
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in decontaminate.contamination(documents(spark, rows), bench).orderBy("doc_id").collect()]
        text = rows[0][1]
        assert got[0] == (0, 13, 11, ["b"], [(4, len(text) - 5)])
        assert got[1] == (1, 6, 4, ["a"], [(2, 11), (14, 23)])
        assert [g[2] for g in got[2:]] == [0, 0, 0, 3, 3] and got[5][3] == []
    docs = documents(spark, rows)
    kept = decontaminate.without_contaminated(docs, bench)
    assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [2, 3, 4] and kept.columns == docs.columns
    assert decontaminate.without_contaminated(docs, bench.limit(0)).count() == len(rows)


def fill(sizes, weights, cap=3):
    """Resharing by rounds, as described."""
    total, target = float(sum(sizes)), [0.0] * len(sizes)
    free, rest = list(range(len(sizes))), total
    while rest > 1e-9 and free:
        w = sum(weights[i] for i in free)
        for i in free:
            target[i] += rest * weights[i] / w
        rest = sum(max(0.0, target[i] - cap * sizes[i]) for i in free)
        for i in free:
            target[i] = min(target[i], float(cap * sizes[i]))
        free = [i for i in free if target[i] < cap * sizes[i]]
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_budgets(spark, seed):
    r = random.Random(seed)
    names = [f"s{i}" for i in range(7)]
    rows = [(i, "w " * r.randrange(0, 40) if r.random() < 0.9 else None) for i in range(300)]
    share = [r.random() ** 3 + 0.01 for _ in names]
    docs = documents(spark, rows + rows[:5], source=lambda i: random.Random(i * 31 + seed).choices(names, share)[0])
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 305
    by = {}
    for x in got:
        by.setdefault(x["source"], []).append(x)
    order = sorted(by, key=lambda s: (s is None, s))
    sizes = [sum(x["size"] for x in by[s]) for s in order]
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, size, target in zip(order, sizes, want, strict=True):
        assert all(x["source_size"] == size and x["target"] == pytest.approx(target) for x in by[s])
        assert sum(x["taken"] for x in by[s]) == int(by[s][0]["target"])
        assert all(0 <= x["taken"] <= 3 * x["size"] for x in by[s])
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    got = mixing.mix_sources(documents(spark, [(1, None), (2, "")])).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0)] * 2


def test_very_long_texts(spark):
    """A text of a million words among short ones: mixed by its size, and scanned to its end."""
    item = words(50, 15)
    long = "filler Words " * 500_000 + " ".join(item[:11])
    rows = [(0, long), (1, "a b c"), (2, "d e")]
    got = {r["doc_id"]: r for r in mixing.mix_sources(documents(spark, rows, source=lambda i: "s")).collect()}
    assert got[0]["size"] == 1_000_011 and got[0]["target"] == 1_000_016.0 and sum(r["taken"] for r in got.values()) == 1_000_016
    bench = spark.createDataFrame([("b", " ".join(item))], "item_id string, text string")
    hit = {r["doc_id"]: r for r in decontaminate.contamination(documents(spark, rows), bench).collect()}
    assert (hit[0]["n_words"], hit[0]["n_hit"], hit[1]["n_hit"]) == (1_000_011, 11, 0) and tuple(hit[0]["spans"][0])[1] == len(long)


def test_urls(spark):
    rows = [
        (1, "HTTP://A.Example.ORG/en/193?x=1"),
        (2, "https://example.org/en/2"),
        (3, "https://myexample.org"),
        (4, "https://shop.com/de/x"),
        (5, "https://shop.com?/de/"),
        (6, None),
        (7, "no scheme"),
        (8, "https://www.cheap-pills.net/a"),
        (8, "https://www.cheap-pills.net/a"),
        (None, "https://casino-win.com/fr/"),
        (9, "x://com/fr/"),
        (10, ""),
    ]
    pages = spark.createDataFrame([(*r, 1, "v") for r in rows], "page_id long, url string, rule int, verdict string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(pages).collect()]
    want = [
        (1, "a.example.org", "/en/193", "example.org/en/1", "block"),
        (2, "example.org", "/en/2", "org/", "allow"),
        (3, "myexample.org", "", None, "allow"),
        (4, "shop.com", "/de/x", "com/de/", "block"),
        (5, "shop.com", "", None, "allow"),
        (6, "", "", None, "allow"),
        (7, "", "", None, "allow"),
        (8, "www.cheap-pills.net", "/a", None, "block"),
        (8, "www.cheap-pills.net", "/a", None, "block"),
        (None, "casino-win.com", "/fr/", "com/fr/", "allow"),
        (9, "com", "/fr/", "com/fr/", "allow"),
        (10, "", "", None, "allow"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_filter(pages, pattern_rules=[PatternRule("any", ".*x")])
