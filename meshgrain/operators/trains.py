"""Spike trains as rows (nid, tick): rates, health and fidelity. Silent nodes come from a table of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshgrain.operators.ranks import running


def counts(spikes: DataFrame, nodes: DataFrame, ticks: int) -> DataFrame:
    """(nid, n) of every node, zeros included."""
    n = spikes.where(F.col("tick").between(0, ticks - 1)).groupBy("nid").agg(F.count("*").alias("n"))
    return nodes.select(F.col("id").alias("nid")).join(n, "nid", "left").select("nid", F.coalesce("n", F.lit(0)).alias("n"))


def tick_histogram(spikes: DataFrame, ticks: int) -> DataFrame:
    return spikes.where(F.col("tick").between(0, ticks - 1)).groupBy("tick").agg(F.count("*").alias("n"))


def health(spikes: DataFrame, nodes: DataFrame, ticks: int, dt_ms: float = 0.1, max_hz: float = 100.0, sync_max: float = 0.5, gini_max: float = 0.9, isolation_max: float = 0.9, active_min: float = 0.01) -> DataFrame:
    """(check, value, threshold, passed): exploding, dead, synchrony, hub_dominated, isolation, and sparse_activity,
    which passes but warns, where a smaller share than active_min of the nodes is active.

    The Gini coefficient comes from the histogram of counts: nodes of one count take
    consecutive ranks, so their rank sum has a closed form.
    """
    c = counts(spikes, nodes, ticks)
    hist = c.groupBy("n").agg(F.count("*").alias("k"))
    weighted = running(hist, "n", [], F.col("k"), "below").agg(F.sum("k").alias("nodes"), F.sum(F.col("n") * F.col("k")).alias("total"), F.coalesce(F.sum(F.expr("case when n > 0 then k end")), F.lit(0)).alias("active"), F.sum(F.expr("n * (k * below + k * (k + 1) div 2)")).alias("ranked"))
    busiest = tick_histogram(spikes, ticks).agg(F.coalesce(F.max("n"), F.lit(0)).alias("busiest"))
    one = weighted.join(F.broadcast(busiest))
    seconds = ticks * dt_ms / 1000.0
    gini = "if(total = 0, 0D, 2D * ranked / (nodes * total) - (nodes + 1D) / nodes)"
    rows = F.array(
        F.struct(F.lit("exploding").alias("check"), F.expr(f"total / nodes / {seconds}D").alias("value"), F.lit(max_hz).alias("threshold")),
        F.struct(F.lit("dead").alias("check"), F.expr("cast(total as double)").alias("value"), F.lit(1.0).alias("threshold")),
        F.struct(F.lit("synchrony").alias("check"), F.expr("if(total = 0, 0D, busiest / total)").alias("value"), F.lit(sync_max).alias("threshold")),
        F.struct(F.lit("hub_dominated").alias("check"), F.expr(gini).alias("value"), F.lit(gini_max).alias("threshold")),
        F.struct(F.lit("isolation").alias("check"), F.expr("1D - active / nodes").alias("value"), F.lit(isolation_max).alias("threshold")),
        F.struct(F.lit("sparse_activity").alias("check"), F.expr("active / nodes").alias("value"), F.lit(active_min).alias("threshold")),
    )
    passed = F.when(F.col("check") == "dead", F.col("value") > 0).otherwise(F.col("value") <= F.col("threshold"))
    warned = (F.col("c.check") != "sparse_activity") | ((F.col("c.value") < F.col("c.threshold")) & (F.col("total") > 0))
    return one.select("total", F.explode(rows).alias("c")).where(warned).select("c.*").withColumn("passed", passed)


def key_gaps(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(nid, missing_in): nodes that only one of two sets of trains has; none where they may be compared as they are."""
    a, b = (df.select("nid").distinct().withColumn(side, F.lit(True)) for df, side in ((reference, "a"), (candidate, "b")))
    both = a.join(b, "nid", "full").where("a is null or b is null")
    return both.select("nid", F.when(F.col("a").isNull(), "reference").otherwise("candidate").alias("missing_in"))


def fidelity(reference: DataFrame, candidate: DataFrame, nodes: DataFrame, ticks: int, width: int = 10) -> DataFrame:
    """One row: rate_ratio, count_r, binned_cosine, max_count_diff and whether each, and all, pass.

    Sums are of whole numbers, so only the last division rounds. No variance or no spikes on
    both sides counts as equal (1), on one side as different (0).
    """
    both = F.col("r"), F.col("c")
    sides = counts(reference, nodes, ticks).withColumnRenamed("n", "r").join(counts(candidate, nodes, ticks).withColumnRenamed("n", "c"), "nid")
    s = sides.agg(F.count("*").alias("n"), F.sum("r").alias("sr"), F.sum("c").alias("sc"), F.sum(both[0] * both[0]).alias("srr"), F.sum(both[1] * both[1]).alias("scc"), F.sum(both[0] * both[1]).alias("src"), F.max(F.abs(both[0] - both[1])).alias("max_count_diff"))
    bins = lambda df, name: df.where(F.col("tick").between(0, ticks - 1)).groupBy("nid", F.expr(f"tick div {width}").alias("bin")).agg(F.count("*").alias(name))
    b = bins(reference, "x").join(bins(candidate, "y"), ["nid", "bin"], "full").na.fill(0, ["x", "y"])
    b = b.agg(F.coalesce(F.sum(F.expr("x * x")), F.lit(0)).alias("xx"), F.coalesce(F.sum(F.expr("y * y")), F.lit(0)).alias("yy"), F.coalesce(F.sum(F.expr("x * y")), F.lit(0)).alias("xy"))
    one = s.join(F.broadcast(b))
    ratio = F.expr("case when sr > 0 then sc / sr when sc = 0 then 1D else double('infinity') end")
    vr, vc = "(n * srr - sr * sr)", "(n * scc - sc * sc)"
    r = F.expr(f"case when {vr} = 0 and {vc} = 0 then 1D when {vr} = 0 or {vc} = 0 then 0D else (n * src - sr * sc) / (sqrt({vr}) * sqrt({vc})) end")
    cosine = F.expr("case when xx = 0 and yy = 0 then 1D when xx = 0 or yy = 0 then 0D else xy / (sqrt(xx) * sqrt(yy)) end")
    out = one.select(ratio.alias("rate_ratio"), F.round(r, 12).alias("count_r"), F.round(cosine, 12).alias("binned_cosine"), "max_count_diff")
    gates = {"rate_ok": F.col("rate_ratio").between(0.95, 1.05), "count_r_ok": F.col("count_r") >= 0.99, "cosine_ok": F.col("binned_cosine") >= 0.99, "diff_ok": F.col("max_count_diff") <= 0}
    return out.withColumns(gates).withColumn("all_ok", F.expr("rate_ok and count_r_ok and cosine_ok and diff_ok"))
