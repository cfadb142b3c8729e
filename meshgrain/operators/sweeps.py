"""Compression sweeps: the least residency that keeps fidelity, the knee, and how controls compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def knee(points: DataFrame, real: str = "real") -> DataFrame:
    """points (condition, budget_fraction, resident_fraction, gate_pass) to one row for each condition: the passing point
    of least residency (ties: the largest budget), its ratio to the real one's, the verdict and whether a knee was found.

    real_wins: the real condition gets by with less than the control. knee_found: some condition fails at some budget.
    """
    low = F.min(F.when(F.col("gate_pass"), F.struct("resident_fraction", (-F.col("budget_fraction")).alias("budget")))).alias("low")
    each = points.groupBy("condition").agg(low, F.bool_or(~F.col("gate_pass")).alias("failed"))
    best = each.where(F.col("condition") == real).select(F.col("low.resident_fraction").alias("real_low"))
    found = each.agg(F.bool_or("failed").alias("knee_found"))
    rows = each.join(F.broadcast(found)).join(F.broadcast(best), how="left").withColumn("least_resident", F.col("low.resident_fraction"))
    control = (F.col("condition") != real) & F.col("real_low").isNotNull() & F.col("least_resident").isNotNull()
    ratio = F.when(control, F.when(F.col("real_low") > 0, F.col("least_resident") / F.col("real_low")).otherwise(float("inf")))
    verdict = F.when(control, F.when(F.col("least_resident") > F.col("real_low"), "real_wins").otherwise("control_ties_or_wins"))
    return rows.select("condition", "least_resident", (-F.col("low.budget")).alias("budget_fraction"), ratio.alias("ratio"), verdict.alias("verdict"), "failed", "knee_found")


def budget_points(spikes: DataFrame, share: float = 0.6, budgets: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """Sweep points of trains (condition, nid): with a budget of 1/f of the nodes, the most active ones (ties: the smaller
    nid), a point passes if they hold `share` of all spikes."""
    c = spikes.groupBy("condition", "nid").agg(F.count("*").alias("n"))
    # ranks by histogram: nodes of one count take consecutive ranks
    w = Window.partitionBy("condition").orderBy(F.desc("n"))
    hist = c.groupBy("condition", "n").agg(F.count("*").alias("k"))
    before = lambda x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hist = hist.withColumn("above", before("k")).withColumn("spikes_above", before(F.col("n") * F.col("k")))
    total = c.groupBy("condition").agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    rows = hist.join(F.broadcast(total), "condition").withColumn("f", F.explode(F.array(*map(F.lit, budgets)))).withColumn("keep", F.expr("greatest(1L, size div f)"))
    at = rows.where("above < keep").groupBy("condition", "f").agg(F.max("keep").alias("keep"), F.max("size").alias("size"), F.max("total").alias("total"), F.max(F.expr("spikes_above + n * least(k, keep - above)")).alias("kept"))
    return at.select("condition", (1.0 / F.col("f")).alias("budget_fraction"), (F.col("keep") / F.col("size")).alias("resident_fraction"), (F.col("kept") >= F.col("total") * F.lit(share)).alias("gate_pass"))
