"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

CLASH = "n long, key long, score double, spans string, _row long, uid long, rep long, component string"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"W{r.randrange(vocabulary)}" for _ in range(n)]


def texts():
    base = words(1, 300)
    near = base[:150] + ["changed"] + base[151:]
    far = base[:80] + words(2, 200)
    passage = words(3, 70)
    out = [" ".join(base), " ".join(near), " ".join(base).upper(), " ".join(far), None, "", "  \n ", "one two", "ONE\ttwo", "solo"]
    out += [" ".join(words(10 + i, 60) + passage + words(30 + i, 40)) for i in range(6)]
    out += ["x " * 500, "abc" * 400, " ".join(words(4, 9000)), " ".join(words(4, 9000)[2000:7000])]
    for i in range(12):  # a family of near copies, each changed in some places
        r, c = random.Random(100 + i), list(base[:200])
        for _ in range(i):
            c[r.randrange(200)] = f"z{r.randrange(10**6)}"
        out.append(" ".join(c))
    return out


def documents(spark, rows=None, source=lambda i: f"src{i % 3}"):
    rows = rows if rows is not None else list(enumerate(texts()))
    data = [(d, t, "en", None if d is not None and d % 11 == 10 else source(d or 0), len(t or ""), 1, 2, 0.5, "s", 3, 4, 5, "c") for d, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def classes(ids, links):
    """Smallest reachable number of each."""
    label = {i: i for i in ids}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new
