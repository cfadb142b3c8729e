"""Graph and event views of the driver's tables, in the shapes of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshgrain.operators.ranks import next_in_order

HOURS = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour(ts: str = "ts"):
    return F.expr(f"cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', {ts}) as int)")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pre, post, nt, conf, event_id): each event's user to the user of the next event, in order of time.

    nt is the transmitter code of the event type, 255 (unknown) above value 150; conf is null
    on every fiftieth event.
    """
    events = next_in_order(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["ts", "event_id"], "user_id", "post")
    code = F.expr("case when value > 150 then 255 when event_type = 'error' then 0 when event_type = 'click' then 1 when event_type = 'view' then 2 when event_type = 'signup' then 3 else 4 end")
    conf = F.when(F.col("event_id") % 50 == 0, None).otherwise(F.col("value") / 600)
    return events.select(F.col("user_id").alias("pre"), "post", code.cast("int").alias("nt"), conf.alias("conf"), "event_id").where("post is not null")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, tgt) once each, without loops."""
    return raw_edges(spark, sf_dir).where("pre <> post").select(F.col("pre").alias("src"), F.col("post").alias("tgt")).distinct()


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nid, tick, kind, event_id): one spike for each event, in hourly ticks."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("nid"), hour().alias("tick"), F.col("event_type").alias("kind"), "event_id")


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pre_id, post_id, synapses, neurotransmitter) as text, some of them bad, as a CSV edge list would have them."""
    line = table(spark, sf_dir, "lineitem")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    return line.select(
        F.when(n % 97 == 0, "-1").when(n % 89 == 0, "x").otherwise(F.col("l_partkey").cast("string")).alias("pre_id"),
        F.col("l_suppkey").cast("string").alias("post_id"),
        F.when(n % 83 == 0, "0").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("synapses"),
        F.when(n % 79 == 0, "XYZ").when(F.col("l_returnflag") == "A", "ach").when(F.col("l_returnflag") == "N", " GABA ").otherwise("").alias("neurotransmitter"),
    )
