"""Text files, over HTTP or on a file system, read in parallel by byte ranges, as a Python data source.

`spark.dataSource.register(ByteRanges)`, then `spark.read.format("byte_ranges").option("url", u).option("chunk_bytes", n).load()` has
one row for each line: its file, the byte it begins at, and its text. The url is a file, or a folder whose files are all read.
A line belongs to the range it begins in, so ranges need nothing from each other and a lost one is read again alone.

As a stream the source follows files that grow: an offset is the end of the last whole line of each file, so half a line waits for its
rest. With the option `complete` the files are known to be whole, and a last line without an end counts.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes that are looked through at once for the end of a line.
LOOK = 1 << 16


class Span(InputPartition):
    def __init__(self, url: str, start: int, end: int) -> None:
        self.url, self.start, self.end = url, start, end


def _over_http(url: str) -> bool:
    return url.startswith(("http://", "https://"))


def _store(url: str):
    """(file system, path) of a url that names none over HTTP; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


def files(url: str) -> list[str]:
    """The file itself, or all files of a folder in order of name, hidden ones left out."""
    if _over_http(url):
        return [url]
    from pyarrow import fs

    store, path = _store(url)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(url)
    if info.type == fs.FileType.File:
        return [url]
    found = (f for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
    return sorted(f"{url.rstrip('/')}/{f.base_name}" for f in found)


def size_of(url: str) -> int:
    if not _over_http(url):
        store, path = _store(url)
        return store.get_file_info(path).size
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=30) as answer:
        size = int(answer.headers.get("Content-Length") or -1)
    if size < 0:
        raise OSError(f"{url} does not tell its length; it cannot be read by ranges")
    return size


def fetch(url: str, start: int, end: int, tries: int = 5, wait: float = 0.5, timeout: float = 30.0) -> bytes:
    """Bytes [start, end) of a file, fewer if it is shorter. A server that ignores the range and sends all is cut to it; errors are tried again."""
    if not _over_http(url):
        store, path = _store(url)
        with store.open_input_file(path) as f:
            return f.read_at(max(0, min(end, f.size()) - start), start) if start < f.size() else b""
    request = urllib.request.Request(url, headers={"Range": f"bytes={start}-{end - 1}"})
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                body = answer.read()
                return body if answer.status == 206 else body[start:end]
        except urllib.error.HTTPError as e:
            if e.code == 416:
                return b""
            if attempt + 1 == tries:
                raise OSError(f"{url} at {start}: {e}") from e
            time.sleep(_asked(e.headers.get("Retry-After"), wait * (attempt + 1)))
        except OSError as e:
            if attempt + 1 == tries:
                raise OSError(f"{url} at {start}: {e}") from e
            time.sleep(wait * (attempt + 1))
    return b""


def _asked(hint: str | None, otherwise: float) -> float:
    """Seconds that a Retry-After header asks for, as a number or as a date; else the usual wait."""
    try:
        return max(0.0, float(hint or ""))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(hint or "").timestamp() - time.time())
    except (TypeError, ValueError):
        return otherwise


def last_line_end(url: str, size: int, start: int = 0) -> int:
    """The byte after the last end of a line in [start, size), or start if there is none."""
    end = size
    while end > start:
        begin = max(start, end - LOOK)
        cut = fetch(url, begin, end).rfind(b"\n")
        if cut >= 0:
            return begin + cut + 1
        end = begin
    return start


def save_cursor(spark: SparkSession, folder: str, offset: int) -> None:
    """The byte up to which a file was read, as a small JSON file in a folder of its own."""
    spark.createDataFrame([(json.dumps({"offset": offset}),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def load_cursor(spark: SparkSession, folder: str) -> int:
    """What save_cursor wrote; 0 if nothing is there or if it is no such file."""
    try:
        text = "".join(r["value"] for r in spark.read.text(folder).take(100))
        return max(0, int(json.loads(text)["offset"]))
    except (AnalysisException, ValueError, KeyError, TypeError):
        return 0


class ByteRanges(DataSource):
    """Options: url, chunk_bytes (1 MiB), start (skips bytes of each file; a line under way there is skipped too), complete (streams)."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RangeStream(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.chunk, self.start = options["url"], int(options.get("chunk_bytes", 1 << 20)), max(0, int(options.get("start", 0)))
        self.complete = str(options.get("complete", "false")).lower() == "true"

    def _spans(self, url: str, start: int, end: int) -> list[Span]:
        return [Span(url, a, min(a + self.chunk, end)) for a in range(start, end, self.chunk)]

    def partitions(self) -> list[Span]:
        return [s for url in files(self.url) for s in self._spans(url, self.start, size_of(url))] or [Span(self.url, 0, 0)]

    def read(self, part: Span) -> Iterator[tuple[str, int, str]]:
        if part.end <= part.start:
            return
        at = max(part.start - 1, 0)
        body = fetch(part.url, at, part.end)
        if part.start:  # the line under way belongs to the range before
            cut = body.find(b"\n")
            if cut < 0:
                return
            at, body = at + cut + 1, body[cut + 1 :]
        if at >= part.end:
            return
        end = part.end
        while not body.endswith(b"\n") and (more := fetch(part.url, end, end + LOOK)):
            cut = more.find(b"\n")
            body += more if cut < 0 else more[: cut + 1]
            end += len(more)
        for line in body.split(b"\n"):
            if line:
                yield part.url, at, line.decode("utf-8")
            at += len(line) + 1


class RangeStream(RangeReader, DataSourceStreamReader):
    """The lines of files that may grow. An offset is a byte for each file: a query that is started again goes on where its checkpoint says."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {url: size if self.complete else last_line_end(url, size, self.start) for url in files(self.url) for size in (size_of(url),)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [s for url, upto in sorted(end.items()) for s in self._spans(url, start.get(url, self.start), upto)]
