import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from meshgrain.sources import paged

ROWS = {i: [{"post": i * 100 + k, "w": k / 4} for k in range(i % 7)] for i in range(60)}
FLAT = [{"n": k} for k in range(103)]


@pytest.fixture
def server():
    """Answers each id with 429 at first, id 13 always with 500, id 14 with no JSON; counts what was answered."""
    asked, lock, busy, most = Counter(), threading.Lock(), [0], [0]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            key = tuple(sorted(q.items()))
            with lock:
                asked[key] += 1
                busy[0] += 1
                most[0] = max(most[0], busy[0])
                first = asked[key] == 1
            if first:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
            elif q.get("id") == 13:
                self.send_error(500)
            else:
                self.send_response(200)
                self.end_headers()
                rows = FLAT[q["first"] : q["first"] + q["limit"]] if "first" in q else ROWS[q["id"]][q["offset"] : q["offset"] + q["limit"]]
                self.wfile.write(b"no json" if q.get("id") == 14 else json.dumps(rows).encode())
            with lock:
                busy[0] -= 1

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/rows", asked, most
    http.shutdown()


def ids_of(asked):
    return {dict(k)["id"] for k in asked if "id" in dict(k)}


def test_every_row_once_after_a_break_too(spark, server, tmp_path):
    url, asked, most = server
    url, folder = url + "?id={id}&limit={limit}&offset={offset}", str(tmp_path / "table")
    ids = spark.range(60).union(spark.range(5)).union(spark.sql("select cast(null as long)"))
    go = {"workers": 2, "round_ids": 10, "page": 3, "tries": 3, "wait": 0.001}
    assert paged.pull(ids, url, folder, **go, most_rounds=2) == 6  # broken off after two rounds
    before = {r["id"] for r in paged.done(spark, folder).collect()}
    assert 0 < len(before) < 50
    (tmp_path / "table/_half").mkdir()  # and in the middle of the third, whose rows are there but not whole
    paged.fetched(spark, folder).limit(5).write.parquet(folder + "/_half/round-x")
    asked.clear()
    paged.pull(ids, url, folder, **go)
    assert not ids_of(asked) & before
    got = paged.table(spark, folder, "post long, w double").collect()
    assert sorted((r["id"], r["place"], r["post"], r["w"]) for r in got) == sorted((i, k, x["post"], x["w"]) for i, rows in ROWS.items() if i not in (13, 14) for k, x in enumerate(rows))
    assert most[0] <= 2
    failed = {r["id"]: r["problem"] for r in paged.failures(spark, folder).collect()}
    assert set(failed) == {13, 14} and "500" in failed[13]
    asked.clear()
    assert paged.pull(ids, url, folder, **go) == 1 and ids_of(asked) == {13, 14}
    assert paged.table(spark, folder, "post long, w double").count() == len(got)


def test_pages_by_offset(spark, server, tmp_path):
    url, asked, _ = server
    folder = str(tmp_path / "pages")
    n = paged.pull_pages(spark, url + "?first={first}&limit={limit}", folder, 10, workers=2, round_pages=4, tries=3, wait=0.001)
    assert n == 11 and [r["n"] for r in paged.table(spark, folder, "n long").orderBy("id", "place").collect()] == list(range(103))
    assert paged.done(spark, str(tmp_path / "none")).count() == 0
