"""Ranks, prefix sums and order statistics without a single-task sort.

Rows are dealt out by ranges of the ordering key, as many ranges as the session has shuffle partitions, and sorted
inside each. A range's rows are added up as they stream by, and the totals of the ranges, one row each, give where every range
starts. The ranges are written once, so that both readings see the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meshgrain.sources.stored import stash


def _ranged(df: DataFrame, by: Sequence[Column]) -> DataFrame:
    """df in ranges of the order, sorted inside each, with the number of the range."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id())


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, Column], numbered: bool = False) -> DataFrame:
    """df with one more column for each entry of sums: the sum of its value (a whole number) over all rows before, in the order of the columns.

    Nulls come first. Rows alike in `order` stand in any order, but only in one range; with `numbered`, many such rows are
    spread over ranges by their places in df, which then must be read straight from files, so that a task that runs again numbers them alike.
    """
    weights = {out: f"_w{i}" for i, out in enumerate(sums)}
    rows = df.withColumns({weights[out]: value.cast("long") for out, value in sums.items()})
    by = [F.col(c) for c in order]
    if numbered:
        rows = rows.withColumn("_place", F.monotonically_increasing_id())
        by.append(F.col("_place"))
    ranged = _ranged(rows, by).drop("_place")
    schema = StructType([*ranged.schema.fields, *(StructField(out, LongType()) for out in sums)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sofar = dict.fromkeys(weights, 0)
        for batch in batches:
            made = []
            for out, w in weights.items():
                each = batch[w].fill_null(0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(each) + sofar[out]
                made.append(pa.array(upto - each))
                sofar[out] = int(upto[-1]) if len(upto) else sofar[out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    placed = stash(ranged.mapInArrow(add, schema))
    totals = placed.groupBy("_range").agg(*(F.sum(w).alias(w) for w in weights.values()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, as many as a shuffle has tasks
    starts = totals.select("_range", *(F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"_s{w}") for w in weights.values()))
    out = placed.join(F.broadcast(starts), "_range")
    return out.withColumns({name: F.col(name) + F.col(f"_s{w}") for name, w in weights.items()}).select(*df.columns, *sums)


def next_in_order(df: DataFrame, order: Sequence[str], column: str, out: str) -> DataFrame:
    """df with `out`: the column's value in the row after, in the order of the columns; null in the last row of all.

    A range's last row takes the first value of the next range that has rows.
    """
    ranged = _ranged(df, [F.col(c) for c in order])
    value = StructField(out, df.schema[column].dataType)
    schema = StructType([*ranged.schema.fields, value, StructField("_end", LongType())])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            if not len(batch):
                continue
            own, later = batch[column], batch.slice(0, len(batch) - 1)
            if held is not None:
                yield row(held, own.slice(0, 1), first, False)
                first = False
            if len(later):
                yield row(later, own.slice(1), first, False)
                first = False
            held = batch.slice(len(batch) - 1)
        if held is not None:
            yield row(held, pa.nulls(1, held[column].type), first, True)

    def row(batch: pa.RecordBatch, after: pa.Array, first: bool, last: bool) -> pa.RecordBatch:
        end = np.zeros(len(batch), np.int64)  # bit 1: the first row of its range, bit 2: the last
        end[0] += first
        end[-1] += 2 * last
        return pa.RecordBatch.from_arrays([*batch.columns, after, pa.array(end)], names=schema.names)

    placed = stash(ranged.mapInArrow(shift, schema))
    first = placed.where("_end in (1, 3)").select("_range", F.col(column).alias("_first"))
    start = first.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_first"))  # a row for each range
    rows = placed.join(F.broadcast(start), "_range")
    return rows.withColumn(out, F.when(F.col("_end") >= 2, F.col("_first")).otherwise(F.col(out))).select(*df.columns, out)


def places(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """df with `out`: the place, from 0, of each row inside its group in the order of the columns, which tell a group's rows apart. A group may be spread over ranges."""
    at = running_sums(df, [*group, *order], {out: F.lit(1)})
    start = at.groupBy(*group).agg(F.min(out).alias("_start"))
    return at.join(start, [*group]).withColumn(out, F.col(out) - F.col("_start")).select(*df.columns, out)


def nearest(values: DataFrame, column: str, ids: DataFrame, out: str) -> DataFrame:
    """Distinct values of a whole-number column with `out`: the id nearest to each, the smaller one if two are as near. ids: id.

    Values and ids are sorted together; a value's neighbours are the ids of the two ranks around it, so no value is compared with more than two ids.
    """
    marked = values.select(F.col(column).alias("_v"), F.lit(0).alias("_id")).distinct().unionAll(ids.select(F.col("id").alias("_v"), F.lit(-1).alias("_id")).distinct())
    ranked = running_sums(marked, ["_v", "_id"], {"_rank": -F.col("_id")})  # an id stands before its equal value
    own = ranked.where("_id = -1").select(F.col("_rank").alias("_at"), F.col("_v").alias("_near"))
    asked = ranked.where("_id = 0").select("_v", "_rank")
    both = asked.join(own.select((F.col("_at") + 1).alias("_rank"), F.col("_near").alias("_below")), "_rank", "left").join(own.select(F.col("_at").alias("_rank"), F.col("_near").alias("_above")), "_rank", "left")
    lower = F.col("_above").isNull() | (F.col("_v") - F.col("_below") <= F.col("_above") - F.col("_v"))
    return both.select(F.col("_v").alias(column), F.when(lower, F.col("_below")).otherwise(F.col("_above")).alias(out)).where(F.col(out).isNotNull())


def running(df: DataFrame, key: str, ties: list[str], weight: Column, out: str) -> DataFrame:
    """df with `out`: the sum of weight over rows before each row in the order of the column key, then ties."""
    return running_sums(df, [key, *ties], {out: weight})


def dense_ids(ids: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values of a long column and their rank from 0."""
    return running(ids.select(column).where(F.col(column).isNotNull()).distinct(), column, [], F.lit(1), out).select(column, F.col(out).cast("long").alias(out))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """One row, one column: the value at place count div 2 of the sorted values, from their histogram."""
    return at_place(values, column, "count_all div 2")


def at_place(values: DataFrame, column: str, place: str) -> DataFrame:
    """One row: the value at a place (from 0) of the sorted values; place is an SQL expression over count_all."""
    hist = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    upto = running(hist, column, [], F.col("n"), "before")
    total = upto.agg(F.sum("n").alias("count_all"))
    return upto.join(F.broadcast(total)).where(f"before + n > {place}").agg(F.min(column).alias(column))
