"""Sinks: chunked parquet, and small JSON records of what was written."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshgrain.sources.byte_ranges import fetch


def write_chunks(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Appends parquet files of rows_per_file rows at most."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def manifest(df: DataFrame, name: str, filters: dict | None = None, checks: dict[str, str] | None = None) -> str:
    """A table's record as JSON with sorted keys: columns, rows, and rows for which each named condition holds."""
    counts = df.agg(F.count("*").alias("rows"), *(F.count_if(F.expr(c)).alias(k) for k, c in (checks or {}).items())).first().asDict()
    return json.dumps({"name": name, "columns": dict(df.dtypes), "rows": counts.pop("rows"), "counts": counts, "filters": filters or {}}, sort_keys=True)


def file_digests(spark, path: str, pattern: str = "*.parquet", block: int = 8 << 20) -> DataFrame:
    """(file, bytes, sha256) of each file, read by the executors in blocks of that many bytes, so that no file has to fit in a value.

    The file system has to be one that Arrow opens (local, S3, HDFS).
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, size in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
                digest = sha256()
                for at in range(0, size, block):
                    digest.update(fetch(url, at, min(at + block, size)))
                yield pa.record_batch([pa.array([url.rsplit("/", 1)[1]]), pa.array([size]), pa.array([digest.hexdigest()])], names=["file", "bytes", "sha256"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")  # the content stays where it is
    return files.mapInArrow(hashed, "file string, bytes long, sha256 string")


def report(one_row: DataFrame) -> str:
    """A one-row report as JSON with sorted keys."""
    return json.dumps(one_row.first().asDict(), sort_keys=True, default=str)
