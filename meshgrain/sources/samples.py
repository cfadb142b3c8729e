"""A small graph for trials and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def toy_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): 12 nodes; a chain 0 to 7 whose end goes back to 2, a hub 8 to all of the chain, and three nodes without edges."""
    # fixed values: the chain's, the back edge's and the hub's weights
    edges = [(i, i + 1, 0.6) for i in range(7)] + [(7, 2, 0.8)] + [(8, i, 0.4) for i in range(8)]
    return spark.createDataFrame(edges, "src long, tgt long, weight double"), spark.range(12)
