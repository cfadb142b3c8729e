import json
import threading
from hashlib import sha256
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from meshgrain.sources import byte_ranges, edge_files, sinks
from meshgrain.sources.byte_ranges import ByteRanges, fetch, files

LINES = ["pre_id,post_id,synapses,neurotransmitter", *(f"{i},{i + 1},{i % 7 + 1},{'GABA' if i % 2 else 'ach'}" for i in range(300))]


@pytest.fixture(scope="module", params=[True, False])
def server(request):
    body = ("\n".join(LINES)).encode()

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()

        def do_GET(self):
            a, b = map(int, self.headers["Range"][6:].split("-"))
            if a >= len(body):
                self.send_error(416)
                return
            self.send_response(206 if request.param else 200)
            self.end_headers()
            self.wfile.write(body[a : b + 1] if request.param else body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/edges.csv"
    http.shutdown()


@pytest.mark.parametrize("chunk", [29, 1000, 10**6])
def test_lines_come_once_whatever_the_range(spark, server, chunk):
    spark.dataSource.register(ByteRanges)
    got = spark.read.format("byte_ranges").option("url", server).option("chunk_bytes", chunk).load()
    assert [r["line"] for r in got.orderBy("offset").collect()] == LINES


def test_edges_from_lines(spark, server):
    spark.dataSource.register(ByteRanges)
    lines = spark.read.format("byte_ranges").option("url", server).option("chunk_bytes", 4000).load().where("offset > 0")
    part = F.split("line", ",")
    rows = lines.select(*(part[i].alias(c) for i, c in enumerate(edge_files.CSV_SCHEMA.names)))
    assert edge_files.normalised(rows).where("problem is null").count() == 300


def test_files_and_folders(spark, tmp_path):
    spark.dataSource.register(ByteRanges)
    for name, lines in (("a.csv", LINES[:50]), ("b.csv", LINES[50:]), ("_hidden", ["x"]), ("empty", [])):
        (tmp_path / name).write_text("\n".join(lines))
    read = lambda url, **o: spark.read.format("byte_ranges").options(url=url, chunk_bytes=97, **o).load()
    assert [r["line"] for r in read(f"file://{tmp_path}").orderBy("file", "offset").collect()] == LINES
    assert [r["line"] for r in read(str(tmp_path / "a.csv")).orderBy("offset").collect()] == LINES[:50]
    start = sum(len(x) + 1 for x in LINES[:20])
    assert [r["line"] for r in read(str(tmp_path / "a.csv"), start=start).orderBy("offset").collect()] == LINES[20:50]
    with pytest.raises(FileNotFoundError):
        files(str(tmp_path / "none"))
    assert fetch(str(tmp_path / "a.csv"), 10**9, 10**9 + 5) == b"" and fetch(str(tmp_path / "a.csv"), 3, 8) == LINES[0].encode()[3:8]


def test_a_file_that_grows(spark, tmp_path):
    """Half a line waits for its rest; with `complete` the last line counts as it is."""
    spark.dataSource.register(ByteRanges)
    place = tmp_path / "log"
    place.mkdir()

    def seen(complete):
        stream = spark.readStream.format("byte_ranges").options(url=str(place), chunk_bytes=5, complete=complete).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination(120)
        return [r["line"] for r in spark.read.schema("file string, offset long, line string").parquet(str(tmp_path / "rows")).orderBy("file", "offset").collect()]

    (place / "x").write_text("aaa\nbb")
    assert seen(False) == ["aaa"]
    (place / "x").write_text("aaa\nbbbb\nc")
    (place / "y").write_text("second file, no end")
    assert seen(False) == ["aaa", "bbbb"]
    (place / "x").write_text("aaa\nbbbb\ncc\n" + "long " * 40)
    assert seen(False) == ["aaa", "bbbb", "cc"]
    assert seen(True) == ["aaa", "bbbb", "cc", "long " * 40, "second file, no end"]


def test_where_the_last_line_ends(tmp_path, monkeypatch):
    monkeypatch.setattr(byte_ranges, "LOOK", 4)
    for text in ("", "a", "a\n", "aa\nbbbbbbbbbbbbbbb", "aa\nbb\n", "\n"):
        (tmp_path / "f").write_text(text)
        assert byte_ranges.last_line_end(str(tmp_path / "f"), len(text)) == text.rfind("\n") + 1


def test_cursor(spark, tmp_path):
    place = str(tmp_path / "cursor")
    assert byte_ranges.load_cursor(spark, place) == 0
    byte_ranges.save_cursor(spark, place, 37)
    assert byte_ranges.load_cursor(spark, place) == 37
    for garbage in ("{", '{"offset": "x"}', "[]", '{"offset": -4}', "{}"):
        spark.createDataFrame([(garbage,)], "value string").coalesce(1).write.mode("overwrite").text(place)
        assert byte_ranges.load_cursor(spark, place) == 0


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("odd", F.col("id") % 2 == 1).coalesce(1)
    sinks.write_chunks(df, str(tmp_path / "t"), 4)
    files = sinks.file_digests(spark, str(tmp_path / "t"))
    assert files.count() == 3 and files.where("length(sha256) = 64").count() == 3
    for r in sinks.file_digests(spark, str(tmp_path / "t"), block=7).collect():
        body = (tmp_path / "t" / r["file"]).read_bytes()
        assert (r["bytes"], r["sha256"]) == (len(body), sha256(body).hexdigest())
    record = json.loads(sinks.manifest(spark.read.parquet(str(tmp_path / "t")), "t", {"floor": 0.1}, {"odd": "odd"}))
    assert (record["rows"], record["counts"], record["filters"]) == (10, {"odd": 5}, {"floor": 0.1})
    assert json.loads(sinks.report(df.agg(F.count("*").alias("n")))) == {"n": 10}


def test_byte_ranges_as_a_stream(spark, server, tmp_path):
    spark.dataSource.register(ByteRanges)
    for start, lines in ((0, LINES), (sum(len(x) + 1 for x in LINES[:100]), LINES[100:])):
        place = str(tmp_path / f"at{start}")
        stream = spark.readStream.format("byte_ranges").option("url", server).option("chunk_bytes", 700).option("start", start).option("complete", True).load()
        for _ in range(2):  # the second run goes on at the checkpoint and finds nothing new
            stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(once=True).start().awaitTermination(120)
        assert [r["line"] for r in spark.read.parquet(f"{place}/rows").orderBy("offset").collect()] == lines
