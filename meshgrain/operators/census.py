"""Exact census of the 16 kinds of triads, without listing open ones.

Only triangles need a join. Edges are oriented from the node of lower degree to that of
higher degree before it, so no node has more than about the square root of the edges to pair. Such a node's neighbours are coloured
in blocks of about BLOCK, and each pair of colours is a key of its own, so that no task gets more than a few BLOCK * BLOCK pairs of one node.
Open triads, single edges and empty triads follow from degrees by kind of dyad.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Canonical code of each of the 64 masks of a triad x < y < z, with
#: bits 1 = x→y, 2 = y→x, 4 = x→z, 8 = z→x, 16 = y→z, 32 = z→y.
CODES = (
    0, 1, 1, 3, 1, 5, 6, 7, 1, 6, 10, 11, 3, 7, 11, 15,
    1, 6, 5, 7, 10, 21, 21, 23, 6, 25, 21, 27, 11, 27, 30, 31,
    1, 10, 6, 11, 6, 21, 25, 27, 5, 21, 21, 30, 7, 23, 27, 31,
    3, 11, 7, 15, 11, 30, 27, 31, 7, 27, 23, 31, 15, 31, 31, 63,
)


#: Neighbours of a node that are paired as one block.
BLOCK = 512


def _closable(arcs: DataFrame) -> DataFrame:
    """The arcs (u, v, t) that can leave the lowest node of a triangle: to a middle node, which arcs enter and leave, or to a node that a middle one has an arc to.

    Where no node has both, as in a graph of parts and their suppliers, none is left, and no pair of neighbours is made.
    """
    middle = arcs.select(F.col("u").alias("v")).distinct().join(arcs.select("v").distinct(), "v", "left_semi")
    beyond = arcs.join(middle.withColumnRenamed("v", "u"), "u", "left_semi").select("v")
    return arcs.join(middle.unionAll(beyond).distinct(), "v", "left_semi")


def _wedges(arcs: DataFrame) -> DataFrame:
    """(v1, v2, xy, xz): pairs v1 < v2 of each node's upper neighbours, from arcs (u, v, t). Colours of a node: one for each BLOCK of its neighbours."""
    colours = arcs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    if (colours.agg(F.max("k")).first()[0] or 1) == 1:  # no node has more than one block
        p, q = (arcs.select("u", F.col("v").alias(v), F.col("t").alias(t)) for v, t in (("v1", "xy"), ("v2", "xz")))
        return p.join(q, "u").where("v1 < v2").select("v1", "v2", "xy", "xz")
    rows = arcs.join(colours, "u").withColumn("c", F.pmod(F.xxhash64("v"), F.col("k")).cast("int"))
    rows = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("u", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "c", "v", "t")
    p, q = (rows.select("u", "i", "j", F.col("c").alias(f"c{n}"), F.col("v").alias(f"v{n}"), F.col("t").alias(t)) for n, t in ((1, "xy"), (2, "xz")))
    pairs = p.join(q, ["u", "i", "j"]).where((F.col("v1") < F.col("v2")) & (F.least("c1", "c2") == F.col("i")) & (F.greatest("c1", "c2") == F.col("j")))
    return pairs.select("v1", "v2", "xy", "xz")


def properties(code: int) -> tuple[int, int, bool]:
    """(edges, mutual pairs, holds a directed cycle of three) of a code."""
    bit = [code >> i & 1 for i in range(6)]
    return sum(bit), sum(bit[i] & bit[i + 1] for i in (0, 2, 4)), bool((bit[0] and bit[4] and bit[3]) or (bit[2] and bit[5] and bit[1]))


def triad_census(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(code, count, concentration, n_edges, n_mutual, cyclic), codes 0, 1 and 3 always, others if they occur.

    count is a long, or a decimal(38,0) where a long can't hold all counts: from about 3.8 million nodes on.

    edges: src, tgt; loops and edges that leave the nodes do not count. nodes: id; without
    them the universe is the set of sources.
    """
    spark = edges.sparkSession
    edges = edges.select("src", "tgt").where("src <> tgt").distinct()
    nodes = (edges.select(F.col("src").alias("id")) if nodes is None else nodes.select("id")).distinct()
    for end in ("src", "tgt"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    way = F.when(F.col("src") < F.col("tgt"), 1).otherwise(2)
    dyads = edges.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), way.alias("t")).groupBy("a", "b").agg(F.sum("t").cast("int").alias("t")).persist()
    flip = lambda t: F.when(t == 3, 3).otherwise(3 - t)
    spokes = dyads.select(F.col("a").alias("u"), F.col("t")).unionAll(dyads.select(F.col("b").alias("u"), flip(F.col("t")).alias("t")))
    degree = spokes.groupBy("u").agg(*(F.count_if(F.col("t") == k).alias(f"d{k}") for k in (1, 2, 3))).withColumn("deg", F.col("d1") + F.col("d2") + F.col("d3")).persist()

    # from lower to higher (degree, id): u → v
    d = degree.select("u", "deg")
    sided = dyads.join(d.select(F.col("u").alias("a"), F.col("deg").alias("da")), "a").join(d.select(F.col("u").alias("b"), F.col("deg").alias("db")), "b").persist()
    up = F.struct("da", "a") < F.struct("db", "b")
    # kinds go along as seen from u, so a triangle knows its three kinds when it is closed
    arcs = sided.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(up, F.col("t")).otherwise(flip(F.col("t"))).alias("t"))
    tri = _wedges(_closable(arcs)).join(dyads.select(F.col("a").alias("v1"), F.col("b").alias("v2"), F.col("t").alias("yz")), ["v1", "v2"]).groupBy("xy", "xz", "yz").agg(F.count("*").alias("n"))

    comb3 = F.expr("cast(cast(n as decimal(38,0)) * (n - 1) * (n - 2) / 6 as decimal(38,0))")
    sums = degree.agg(
        *(F.coalesce(F.sum(F.expr(f"cast(d{k} as decimal(38,0)) * (d{k} - 1) / 2")), F.lit(0)).alias(f"s{k}{k}") for k in (1, 2, 3)),
        *(F.coalesce(F.sum(F.expr(f"cast(d{i} as decimal(38,0)) * d{j}")), F.lit(0)).alias(f"s{i}{j}") for i, j in ((1, 2), (1, 3), (2, 3))),
    )
    pairs = sided.agg(*(F.coalesce(F.sum(F.when(c, F.lit(1))), F.lit(0)).alias(f"p_{m}") for m, c in (("one", F.col("t") != 3), ("two", F.col("t") == 3))), *(F.coalesce(F.sum(F.when(c, F.col("da") + F.col("db"))), F.lit(0)).alias(f"g_{m}") for m, c in (("one", F.col("t") != 3), ("two", F.col("t") == 3))))
    whole = nodes.agg(F.count("*").alias("n")).withColumn("all3", comb3).join(F.broadcast(sums)).join(F.broadcast(pairs)).first()  # one row
    triangles = tri.collect()  # 27 rows at most
    sided.unpersist()
    dyads.unpersist()
    degree.unpersist()
    counts = _totals(whole.asDict(), [r.asDict() for r in triangles])
    if max(r[1] for r in counts) < 1 << 63:
        kind = "long"
    else:
        kind, counts = "decimal(38,0)", [(r[0], Decimal(r[1]), *r[2:]) for r in counts]
    return spark.createDataFrame(counts, f"code int, count {kind}, concentration double, n_edges int, n_mutual int, cyclic boolean").orderBy("code")


#: Codes of open triads by the kinds of their two spokes (1 out, 2 in, 3 both).
OPEN = {(1, 1): 5, (2, 2): 10, (1, 2): 6, (1, 3): 7, (2, 3): 11, (3, 3): 15}


def _totals(whole: dict, triangles: list[dict]) -> list[tuple]:
    count = dict.fromkeys((0, 1, 3), 0)
    wedges = {k: int(whole[f"s{k[0]}{k[1]}"]) for k in OPEN}
    common = {"one": 0, "two": 0}
    flip = {1: 2, 2: 1, 3: 3}
    for t in triangles:
        xy, xz, yz, n = t["xy"], t["xz"], t["yz"], t["n"]
        code = CODES[xy + 4 * xz + 16 * yz]
        count[code] = count.get(code, 0) + n
        for corner in ((xy, xz), (flip[xy], yz), (flip[xz], flip[yz])):
            wedges[tuple(sorted(corner))] -= n
        for side in (xy, xz, yz):
            common["two" if side == 3 else "one"] += n
    for k, code in OPEN.items():
        if wedges[k]:
            count[code] = count.get(code, 0) + wedges[k]
    n = whole["n"]
    for kind, code in (("one", 1), ("two", 3)):
        count[code] = int(whole[f"p_{kind}"]) * n - int(whole[f"g_{kind}"]) + common[kind]
    total = int(whole["all3"])
    count[0] = total - sum(count.values())
    return [(c, k, k / total if total else 0.0, *properties(c)) for c, k in sorted(count.items())]
