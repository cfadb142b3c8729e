"""Sharding by global prefix sums of sizes: contiguous shards of nearly equal bytes.

Rows are dealt out by ranges of an order and sorted there; running totals inside a range and the ranges' own totals (one
row each) give every row its place on one line that is as long as all sizes together. The line is cut into equal parts, and a row
goes to the shard that holds its middle. So a shard is a stretch of the order, and its size differs from its share by less than
the largest row at either end. Only what the caller carries is moved: without the text, a few numbers for each row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshgrain.operators.ranks import running_sums


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1, for what ends it in a file."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def sharded(rows: DataFrame, shards: int = 8, order: Sequence[str] = ("doc_id",), size: str = "size") -> DataFrame:
    """rows with `shard` (int, 0 to shards - 1) and `slot` (long, places from 0 inside the shard, in the order of the columns).

    size is a column of positive whole numbers. Nulls in `order` come first; rows alike there follow by size, and rows alike in both stand
    in any order, be they very many. A row larger than a shard's share may leave shards empty; an empty table gives
    an empty one. All columns of rows stay, but `shard` and `slot` are replaced. rows must be read straight from files.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = rows.drop("shard", "slot")
    placed = running_sums(rows, [*order, size], {"_bytes": F.col(size), "_rows": F.lit(1)}, numbered=True)
    total = placed.agg(F.sum(size).alias("_total"))
    middle = F.expr(f"cast((2 * cast(_bytes as decimal(38,0)) + `{size}`) * {shards} div (2 * _total) as int)")
    cut = placed.join(F.broadcast(total)).withColumn("shard", F.least(middle, F.lit(shards - 1)))
    first = cut.groupBy("shard").agg(F.min("_rows").alias("_first"))  # a row for each shard
    return cut.join(F.broadcast(first), "shard").select(*rows.columns, "shard", (F.col("_rows") - F.col("_first")).alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = 8, order: Sequence[str] = ("doc_id",), rows_per_file: int = 1_000_000) -> None:
    """Writes docs (with a column text) as Parquet files under folder/shard=k, each file a stretch of its shard in order of `slot`.

    Files hold rows_per_file rows at most. Other columns go along. The column size is text_size; one of that name is replaced.
    """
    rows = sharded(docs.withColumn("size", text_size(F.col("text"))), shards, order)
    rows = rows.withColumn("file", F.expr(f"slot div {rows_per_file}"))
    rows.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot").drop("file").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(folder)


def digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not by key)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    return sharded(rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
