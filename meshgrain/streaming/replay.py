"""Tables replayed as streams, and what a stream put out as a table again."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from meshgrain.sources.stored import own_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def arrivals(rows: DataFrame, slices: int, until: int) -> DataFrame:
    """rows (with an int column tick) as a stream that brings one slice of the range of ticks after the other, in about `slices` micro-batches.

    Inside a slice rows come in drawn order. After the last slice comes a row of nulls whose tick is `until`, so that the watermark gets there.
    """
    spark, folder = rows.sparkSession, own_folder(rows.sparkSession, "arrivals")
    lo, hi = rows.agg(F.min("tick"), F.max("tick")).first()
    width = ((hi or 0) - (lo or 0)) // slices + 1
    clock = spark.range(1).select(*(F.lit(until if c == "tick" else None).cast(t).alias(c) for c, t in rows.dtypes))
    for k in range(slices):
        part = rows.where(F.expr(f"(tick - {lo or 0}) div {width} = {k}")).sortWithinPartitions(F.xxhash64(*rows.columns))
        part.write.mode("append").parquet(folder)
    clock.write.mode("append").parquet(folder)
    files = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // slices)).parquet(folder)


@contextmanager
def rocks_db(spark: SparkSession):
    """State with timers needs this store, which writes changes instead of whole snapshots; the session's own settings come back afterwards."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    old = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run(df: DataFrame, mode: str) -> tuple[DataFrame, StreamingQuery]:
    """Runs a stream over all that is there: its rows with `_batch`, the number of the micro-batch that put them out, and the ended query."""
    spark, place = df.sparkSession, own_folder(df.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:  # written anew if the batch runs again
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{place}/rows/micro_batch={number}")

    with rocks_db(spark):
        query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*df.schema.fields, StructField("_batch", LongType())])).parquet(f"{place}/rows"), query


def run_to_table(df: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Runs a stream over all that is there; in complete and update mode the last row of each key that it put out, in append mode all rows."""
    rows, _ = run(df, mode)
    if mode == "append":
        return rows.select(*df.columns)
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("_batch"))
        return rows.join(F.broadcast(last), "_batch").select(*df.columns)
    value = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct("_batch", *value)).alias("r")).select(*keys, *[f"r.{c}" for c in value])


def window_counts(events: DataFrame, size: str = "6 hours", slide: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """Events for each sliding window and type, as a watermarked stream aggregation."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    each = timed.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return each.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
