"""Structure of a directed graph: degrees, density, reciprocity, locality, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshgrain.operators.ranks import at_place, next_in_order, upper_median


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_deg, in_deg) of every node, zeros included. One pass over both ends of the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("tgt").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    count = ends.groupBy("id").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"))
    return nodes.select("id").join(count, "id", "left").na.fill(0, ["out_deg", "in_deg"])


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over out-degrees: n, mean, max, median (the upper one), sum_sq."""
    d = degrees(nodes, edges).select("out_deg")
    stats = d.agg(F.count("*").alias("n"), (F.sum("out_deg") / F.count("*")).alias("mean_deg"), F.max("out_deg").alias("max_deg"), F.sum(F.col("out_deg") * F.col("out_deg")).alias("sum_sq"))
    return stats.join(F.broadcast(upper_median(d, "out_deg").withColumnRenamed("out_deg", "median_deg")))


def structure_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: neurons, edges, density, mean and largest out-degree, isolated nodes, reciprocal edges, reciprocity."""
    d = degrees(nodes, edges)
    per_node = d.agg(F.count("*").alias("neurons"), F.sum("out_deg").alias("edges"), F.max("out_deg").alias("max_out_degree"), F.count_if((F.col("out_deg") == 0) & (F.col("in_deg") == 0)).alias("isolated"))
    once = edges.select("src", "tgt").distinct()
    back = once.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    mutual = once.join(back, ["src", "tgt"], "left_semi").agg(F.count("*").alias("reciprocal_edges"))
    both = per_node.join(F.broadcast(mutual))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n, e = F.col("neurons"), F.col("edges")
    return both.withColumns({"density": ratio(e, n * (n - 1)), "mean_out_degree": ratio(e, n), "reciprocity": ratio(F.col("reciprocal_edges"), e)})


def locality_ratio(edges: DataFrame, samples: int = 2000, each: int = 3) -> DataFrame:
    """One row: mean span of edges over the id range, from the first `each` targets of sources in
    ascending order until `samples` edges are taken. Only that many sources are ever gathered."""
    ends = edges.agg(F.least(F.min("src"), F.min("tgt")).alias("lo"), F.greatest(F.max("src"), F.max("tgt")).alias("hi"))
    first = edges.select("src").distinct().orderBy("src").limit(samples)
    rank = F.row_number().over(Window.partitionBy("src").orderBy("tgt"))
    some = edges.join(F.broadcast(first), "src").withColumn("rank", rank).where(F.col("rank") <= each)
    per = some.groupBy("src").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("tgt") - F.col("src"))).alias("reach"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = per.withColumn("before", before).where(F.col("before") < samples).agg(F.sum("n").alias("n"), F.sum("reach").alias("reach"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    return taken.join(F.broadcast(ends)).select("n", F.when(F.col("n") > 0, F.col("reach") / F.col("n") / span).otherwise(0.0).alias("locality"))


def top_nodes(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The n nodes of largest out-degree, ties to the smaller id."""
    return degrees(nodes, edges).orderBy(F.desc("out_deg"), "id").limit(n).select("id")


def among(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep (id)."""
    return edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("tgt")), "tgt", "left_semi").select(*edges.columns)


def without(edges: DataFrame, drop: DataFrame) -> DataFrame:
    """Edges with no end in drop (id)."""
    return edges.join(drop.select(F.col("id").alias("src")), "src", "left_anti").join(drop.select(F.col("id").alias("tgt")), "tgt", "left_anti").select(*edges.columns)


def hub_removed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that do not touch the hundredth part of nodes (one at least) of largest out-degree."""
    n = nodes.count()
    return without(edges, top_nodes(nodes, edges, max(1, n // 100)))


def short_span(edges: DataFrame) -> DataFrame:
    """Edges no longer, in ids, than the upper median of all spans."""
    span = F.abs(F.col("tgt") - F.col("src"))
    most = upper_median(edges.select(span.alias("span")), "span").withColumnRenamed("span", "most")
    return edges.join(F.broadcast(most)).where(span <= F.col("most")).drop("most")


def roles(nodes: DataFrame, edges: DataFrame, percent: int = 90) -> DataFrame:
    """(id, role) from topology alone: sensory, goal, association or unassigned."""
    d = degrees(nodes, edges).withColumn("deg", F.col("out_deg") + F.col("in_deg"))
    hub = at_place(d, "deg", f"least(count_all - 1, count_all * {percent} div 100)").withColumnRenamed("deg", "hub_at")
    role = F.expr("case when in_deg = 0 and out_deg > 0 then 'sensory' when out_deg = 0 and in_deg > 0 then 'goal' when hub_at > 0 and deg >= hub_at then 'association' else 'unassigned' end")
    return d.join(F.broadcast(hub)).select("id", role.alias("role"))


def id_gaps(nodes: DataFrame) -> DataFrame:
    """One row: mean and upper median of the gaps between consecutive ids, and how densely they fill their range."""
    ids = next_in_order(nodes.select("id").distinct(), ["id"], "id", "after")
    gaps = ids.select((F.col("after") - F.col("id")).alias("gap")).where("gap is not null")
    total = ids.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    middle = upper_median(gaps, "gap").withColumnRenamed("gap", "median_gap")
    return total.join(F.broadcast(middle), how="left").select("n", "median_gap", F.expr("if(n > 1, (hi - lo) / (n - 1), 0D)").alias("mean_gap"), F.expr("n / (hi - lo + 1)").alias("density"))
