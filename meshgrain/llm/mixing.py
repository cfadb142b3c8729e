"""Mixing sources to target weights: a deterministic random sample of every source at its exact budget.

Every document gets a hash-random key. Inside a source the documents are ordered by that
key; key ranges (two levels of 256) give distributed prefix sums of sizes: sums of ranges are
added up over at most 256 rows at a time, and only documents of one small range are sorted
together. A source's budget is its target: whole epochs first, then the ordered documents
up to the exact cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshgrain.llm.common import stash


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row for each source.

    Sources in code point order, null last, take the weights in turn. The targets share the
    total of all sizes by weight; none exceeds most_epochs times its source's size, and what
    is above goes to the others by weight. Filling sources from the one that is full first
    gives the same as resharing until none is above: with the full ones taken off, every
    other gets its weight's share of the rest.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("long")
    sizes = sizes.withColumn("weight", weight).withColumn("cap", most_epochs * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    over = order.rowsBetween(Window.unboundedPreceding, -1)
    left = sizes.withColumn("rest", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(over), F.lit(0)))
    left = left.withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    left = left.withColumn("full", wide("cap") * F.col("weights") < wide("rest") * F.col("weight"))
    # the first source that is not full has the shares of all that follow
    share = F.first(F.when(~F.col("full"), F.struct("rest", "weights")), ignorenulls=True).over(Window.partitionBy())
    left = left.withColumn("share", share)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("share.rest")).cast("double") / F.col("share.weights"))
    return left.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    size counts the words of the text (null: 0); taken is the number of words that the mix
    takes, repeats included: whole epochs, plus the first documents in key order, the last
    one in part, so that a source's taken words are its target rounded down. Rows are ordered
    by a hash of doc_id, ties by doc_id and size, so reruns agree and equal rows are alike.
    A null source is a source of its own; sources of no words get target 0.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")))
    rows = rows.withColumn("r1", F.substring("key", 1, 2)).withColumn("r2", F.substring("key", 3, 2))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # null is a source too
    ranges = rows.groupBy(source.alias("s"), "r1", "r2").agg(F.sum("size").alias("size"))
    before = lambda keys, by: F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = ranges.groupBy("s", "r1").agg(F.sum("size").alias("size")).select("s", "r1", before(["s"], "r1").alias("before_1"))
    inner = ranges.select("s", "r1", "r2", before(["s", "r1"], "r2").alias("before_2"))
    starts = inner.join(outer, ["s", "r1"])
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs)
    plan = plan.withColumn("budget", F.floor("target").cast("long")).withColumn("epochs", F.expr("if(source_size = 0, 0L, budget div source_size)"))
    plan = plan.select(source.alias("s"), "source_size", "target", "epochs", F.expr("budget - epochs * source_size").alias("rest"))
    row = Window.partitionBy("s", "r1", "r2").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("s", source).withColumn("before_3", F.coalesce(F.sum("size").over(row), F.lit(0)))
    placed = placed.join(starts, ["s", "r1", "r2"]).join(plan, "s").withColumn("before", F.expr("before_1 + before_2 + before_3"))
    taken = F.expr("epochs * size + greatest(0L, least(size, rest - before))")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
