"""Scaled and null-model graphs from keyed draws.

Nodes of a source graph are 0..n-1 (operators.ranks.dense_ids makes them so); edges are
(src, tgt, weight), but for the controls, which rewire (src, tgt). No generator looks at all pairs of nodes: where a pair exists with probability p,
every node goes through its possible partners in skips of geometric length, which is the law of one coin
for each pair at the work of the edges made. Drawn edges have the mean weight of the source graph, those of graphs without a source a drawn one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meshgrain.functions.draws import CrossedDraws, Draws, below, draw, uniform
from meshgrain.operators.far_field import far_sum
from meshgrain.operators.ranks import nearest, running
from meshgrain.sources.stored import stash

#: Weight of drawn edges where the source graph has no edges.
NO_WEIGHT = 0.5
#: Hits expected in a stretch of possible partners, and skips tried there; more hits have a chance below 1e-70.
HITS, SKIPS = 16, 128
#: Stretches that numpy draws side by side, and numbers in a row where all are hits.
STRETCHES, SURE = 1 << 15, 1 << 12
#: Rows that a task makes, and tasks at most.
TASK_ROWS, MOST_TASKS = 1 << 20, 20000


def _checked(positive: dict[str, float] | None = None, **chances: float) -> None:
    """Raises one ValueError for numbers that are not positive or chances that are not in [0, 1]."""
    wrong = [f"{k} must be positive, not {v}" for k, v in (positive or {}).items() if not v > 0]
    wrong += [f"{k} must be in [0, 1], not {v}" for k, v in chances.items() if not 0 <= v <= 1]
    if wrong:
        raise ValueError("; ".join(wrong))


def mean_weight(edges: DataFrame) -> DataFrame:
    """One row, `mean`: the mean weight of the edges."""
    return edges.agg(F.coalesce(F.avg("weight"), F.lit(NO_WEIGHT)).alias("mean"))


def _with_mean(drawn: DataFrame, edges: DataFrame) -> DataFrame:
    return drawn.select("src", "tgt").join(F.broadcast(mean_weight(edges))).select("src", "tgt", F.col("mean").alias("weight"))


#: Columns of a batch, by name.
Arrays = dict[str, np.ndarray]


def _spread(nodes: DataFrame, made: float, *by: str) -> DataFrame:
    """nodes dealt out by hash, a task for each TASK_ROWS of the rows that they will be made into; a small table would stay in one task."""
    return nodes.repartition(min(MOST_TASKS, max(1, math.ceil(made / TASK_ROWS))), *by)


def partners(nodes: DataFrame, among: Column, p: float, *key: str | int, ids: tuple[str, ...] = ("id",), made: float | None = None, then: Callable[[Arrays], Arrays] | None = None, schema: str = "src long, tgt long") -> DataFrame:
    """nodes (ids and more) with `pick`: each number in [0, among) with probability p, independently.

    The numbers are cut into stretches of HITS / p; in each the distance from hit to hit is geometric, drawn for the ids, the stretch and the
    place of the hit. made: about how many rows come out, for which nodes are dealt out anew. then: what numpy makes of
    the rows before Spark gets them (the way from Python to Spark is what a row costs most), in columns of `schema`.
    """
    if p <= 0:
        none = nodes.withColumn("pick", F.lit(0).cast("long")).where("false")
        return none if then is None else none.sparkSession.createDataFrame([], schema)
    rows = nodes.withColumn("among", among.cast("long")).where("among > 0")
    if made is not None:
        rows = _spread(rows, made if p < 1 else made / 8, *ids)
    if p >= 1:  # no draw decides anything
        rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("among") - 1, F.lit(SURE).cast("long"))))
        sure = rows.withColumn("pick", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + SURE, "among") - 1))).drop("among", "start")
        return sure if then is None else sure.mapInArrow(lambda batches: (_made(b, then) for b in batches), schema)
    stretch, slope, head = math.ceil(HITS / p), math.log1p(-p), ":".join(map(str, key))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_of = batch.column("among").to_numpy(zero_copy_only=False)
            upto = np.cumsum(-(-all_of // stretch))  # stretches up to each row
            for start in range(0, int(upto[-1]) if len(upto) else 0, STRETCHES):
                place = np.arange(start, min(start + STRETCHES, upto[-1]))
                row = np.searchsorted(upto, place, side="right")
                number = place - np.where(row > 0, upto[row - 1], 0)
                texts = Draws(head, *(batch.column(c).to_pandas().iloc[row] for c in ids), number)
                which, at = _hits(texts, np.minimum(stretch, all_of[row] - number * stretch), slope)
                out = batch.drop_columns(["among"]).take(pa.array(row[which]))
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(number[which] * stretch + at)], names=[*out.schema.names, "pick"])
                yield out if then is None else _made(out, then)

    return rows.mapInArrow(hits, schema if then else StructType([*nodes.schema.fields, StructField("pick", LongType())]))


def _made(batch: pa.RecordBatch, then: Callable[[Arrays], Arrays]) -> pa.RecordBatch:
    """What `then` makes of a batch, in as many rows at once as fit in a processor's cache."""
    parts = []
    for start in range(0, batch.num_rows, STRETCHES):
        part = batch.slice(start, STRETCHES)
        parts.append(then({c: part.column(c).to_numpy(zero_copy_only=False) for c in part.schema.names}))
    return pa.RecordBatch.from_pydict({c: np.concatenate([x[c] for x in parts]) for c in parts[0]} if parts else then({c: np.empty(0, np.int64) for c in batch.schema.names}))


def _hits(texts: Draws, size: np.ndarray, slope: float) -> tuple[np.ndarray, np.ndarray]:
    """(which stretch, place in it) of all hits in stretches of these sizes."""
    live, at, found = np.arange(len(size)), np.full(len(size), -1, np.int64), []
    for k in range(min(SKIPS, int(size.max(initial=0)))):
        if not len(live):
            break
        at = at + 1 + np.minimum(np.floor(np.log(1 - texts.at(k)) / slope), size).astype(np.int64)
        inside = at < size
        found.append((live[inside], at[inside]))
        if inside.sum() < 0.9 * len(live):
            texts.keep(inside)
            live, at, size = live[inside], at[inside], size[inside]
    which, where = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (live[:0], at[:0])
    return which, where


def copies(edges: DataFrame, n: int, times: int) -> DataFrame:
    """`times` tiles of a graph, tile c moved by c * n."""
    tile = edges.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return tile.select((F.col("src") + F.col("c") * n).alias("src"), (F.col("tgt") + F.col("c") * n).alias("tgt"), "weight")


def replication(edges: DataFrame, n: int, times: int, p_cross: float = 0.0, seed: int = 0) -> DataFrame:
    """Tiles; each pair of nodes of different tiles is joined both ways with probability p_cross."""
    _checked({"times": times}, p_cross=p_cross)
    out = copies(edges, n, times)
    if p_cross <= 0:
        return out
    first = F.expr(f"(id div {n} + 1) * {n}")  # nodes of later tiles begin here; an edge either way for each pair
    other = partners(edges.sparkSession.range(n * times), n * times - first, p_cross, "replicate", seed, made=n * n * p_cross * times * (times - 1) / 2)
    ends = other.select(F.col("id").alias("a"), (first + F.col("pick")).alias("b"))
    both = ends.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("tgt")), F.struct(F.col("b").alias("src"), F.col("a").alias("tgt")))).alias("e")).select("e.*")
    return out.unionAll(_with_mean(both, edges))


def duplication(edges: DataFrame, n: int, p_drop: float = 0.1, p_rewire: float = 0.05, seed: int = 0) -> DataFrame:
    """Two tiles whose edges are dropped, or sent to a drawn node of either tile."""
    _checked(p_drop=p_drop, p_rewire=p_rewire, both=p_drop + p_rewire)
    twice = copies(edges, n, 2)
    r = uniform("duplicate", seed, F.col("src"), F.col("tgt"))
    tgt = F.when(F.col("r") < p_drop + p_rewire, below(2 * n, "rewire", seed, F.col("src"), F.col("tgt"))).otherwise(F.col("tgt"))
    return twice.withColumn("r", r).where(F.col("r") >= p_drop).select("src", tgt.alias("tgt"), "weight")


def _duplicated(src: np.ndarray, tgt: np.ndarray, n: int, p_drop: float, p_rewire: float, seed: int) -> Arrays:
    """The ends that duplication makes of edges, in numpy."""
    src, tgt = np.concatenate([src, src + n]), np.concatenate([tgt, tgt + n])
    r = Draws(f"duplicate:{seed}", src, tgt).at()
    src, tgt, r = (x[r >= p_drop] for x in (src, tgt, r))
    new = r < p_drop + p_rewire
    tgt[new] = Draws(f"rewire:{seed}", src[new], tgt[new]).below(2 * n)
    return {"src": src, "tgt": tgt}


def modular(edges: DataFrame, n: int, modules: int, times: int, p_inter: float = 0.0, seed: int = 0) -> DataFrame:
    """Edges inside modules (id mod modules), each module numbered on its own and
    tiled; from each made node an edge to each later one with probability p_inter.

    Node (module m, copy c, place i) is base(m) + c * size(m) + i, modules one after another.
    """
    _checked({"modules": modules, "times": times}, p_inter=p_inter)
    size = lambda m: F.expr(f"{n} div {modules}") + (m < n % modules).cast("int")
    base = lambda m: m * F.expr(f"{n} div {modules}") + F.least(m, F.lit(n % modules))
    inner = edges.where(F.pmod("src", F.lit(modules)) == F.pmod("tgt", F.lit(modules))).withColumn("m", F.pmod("src", F.lit(modules)))
    inner = inner.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    start = base(F.col("m")) * times + F.col("c") * size(F.col("m"))
    out = inner.select((start + F.expr(f"src div {modules}")).alias("src"), (start + F.expr(f"tgt div {modules}")).alias("tgt"), "weight")
    if p_inter <= 0:
        return out
    return out.unionAll(_with_mean(_later(edges, n * times, p_inter, seed), edges))


def _later(edges: DataFrame, n: int, p: float, seed: int, then: Callable[[np.ndarray, np.ndarray], Arrays] = lambda src, tgt: {"src": src, "tgt": tgt}) -> DataFrame:
    """(src, tgt) that `then` makes of edges from each of n nodes to each later one with probability p."""
    return partners(edges.sparkSession.range(n), F.lit(n - 1) - F.col("id"), p, "modules", seed, made=n * n * p / 2, then=lambda c: then(c["id"], c["id"] + 1 + c["pick"]))


def population(edges: DataFrame, n: int, size: int = 5, p_intra: float = 0.5, p_inter: float = 0.3, seed: int = 0) -> DataFrame:
    """Every node becomes `size` members, each joined to each other of its node with probability p_intra; every edge is
    handed on, with its weight, to each pair of members of its ends with probability p_inter."""
    _checked({"size": size}, p_intra=p_intra, p_inter=p_inter)
    inside = partners(edges.sparkSession.range(n * size), F.lit(size - 1), p_intra, "intra", seed, made=n * size * size * p_intra)
    own = F.col("id") % size
    intra = inside.select(F.col("id").alias("src"), (F.col("id") - own + F.col("pick") + (F.col("pick") >= own).cast("int")).alias("tgt"))
    pairs = partners(edges, F.lit(size * size), p_inter, "inter", seed, ids=("src", "tgt"))
    inter = pairs.select((F.col("src") * size + F.expr(f"pick div {size}")).alias("src"), (F.col("tgt") * size + F.col("pick") % size).alias("tgt"), "weight")
    return _with_mean(intra, edges).unionAll(inter)


def hybrid(edges: DataFrame, n: int, modules: int = 2, times: int = 2, p_drop: float = 0.05, p_inter: float = 0.01, seed: int = 0) -> DataFrame:
    """Modular growth with links between modules, then duplication with as many rewired as dropped."""
    _checked(p_drop=p_drop, p_inter=p_inter, both=2 * p_drop)
    own = duplication(modular(edges, n, modules, times), n * times, p_drop, p_drop, seed + 1)
    later = _later(edges, n * times, p_inter, seed, lambda src, tgt: _duplicated(src, tgt, n * times, p_drop, p_drop, seed + 1))
    return own.unionAll(_with_mean(later, edges)) if p_inter > 0 else own


def drawn_weight(low: float, high: float, seed: int) -> Column:
    """A weight in [low, high) for the edge src, tgt."""
    return F.lit(low) + uniform("edge weight", seed, F.col("src"), F.col("tgt")) * F.lit(high - low)


def _weighed(src: np.ndarray, tgt: np.ndarray, low: float, high: float, seed: int) -> Arrays:
    """Edges with the weights of drawn_weight, in numpy."""
    return {"src": src, "tgt": tgt, "weight": low + Draws(f"edge weight:{seed}", src, tgt).at() * (high - low)}


WEIGHED = "src long, tgt long, weight double"


def gnp(nodes: DataFrame, n: int, p: float, seed: int = 0, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Each directed edge between two different nodes (id in 0..n-1) with probability p, and a drawn weight in [low, high)."""
    _checked({"n": n, "width": high - low}, p=p)
    nodes, made = nodes.select("id"), n * n * p
    if p >= 1:  # all Spark's own, so that weights nobody asks for are not drawn
        every = partners(nodes, F.lit(n - 1), p, "gnp", seed, made=made)
        return every.select(F.col("id").alias("src"), F.pmod(F.col("id") + 1 + F.col("pick"), F.lit(n)).alias("tgt")).withColumn("weight", drawn_weight(low, high, seed))
    return partners(nodes, F.lit(n - 1), p, "gnp", seed, made=made, then=lambda c: _weighed(c["id"], (c["id"] + 1 + c["pick"]) % n, low, high, seed), schema=WEIGHED)


def planted(nodes: DataFrame, n: int, modules: int, p_in: float, p_out: float, seed: int = 0, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """As gnp, with p_in inside a module (id mod modules) and p_out between modules."""
    _checked({"n": n, "modules": modules, "nodes in each module": n // max(modules, 1), "width": high - low}, p_in=p_in, p_out=p_out)
    rows = nodes.select("id")
    size = F.expr(f"{n} div {modules}") + (F.pmod("id", F.lit(modules)) < n % modules).cast("int")

    def inside(c: Arrays) -> Arrays:
        own, m = np.divmod(c["id"], modules)
        return _weighed(c["id"], (c["pick"] + (c["pick"] >= own)) * modules + m, low, high, seed)

    def outside(c: Arrays) -> Arrays:
        # of `modules` ids in a row, all but one are of other modules
        row, turn = np.divmod(c["pick"], modules - 1)
        return _weighed(c["id"], row * modules + turn + (turn >= c["id"] % modules), low, high, seed)

    out = partners(rows, size - 1, p_in, "in", seed, made=n * n / modules * p_in, then=inside, schema=WEIGHED)
    if modules > 1:
        out = out.unionAll(partners(rows, n - size, p_out, "out", seed, made=n * n * p_out, then=outside, schema=WEIGHED))
    return out


def motif_edges(code: int) -> list[tuple[int, int]]:
    """Edges among nodes 0, 1, 2 of a triad code."""
    return [e for i, e in enumerate([(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)]) if code >> i & 1]


def stamped(instances: DataFrame, code: int) -> DataFrame:
    """The triad of a code once for each instance number, nodes 3i to 3i + 2."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in motif_edges(code)))
    return instances.withColumn("e", F.explode(pairs)).select((F.col("id") * 3 + F.col("e.a")).alias("src"), (F.col("id") * 3 + F.col("e.b")).alias("tgt"))


def motif_fill(instances: DataFrame, n: int, code: int, p_inter: float = 0.01, weight: float = 0.5, seed: int = 0) -> DataFrame:
    """(src, tgt, weight): the triad of a code for each instance number in 0..n-1, and an edge from each node that
    has edges in it to each later such node with probability p_inter."""
    _checked({"n": n, "code": code}, p_inter=p_inter)
    own = sorted({a for a, _ in motif_edges(code)})
    m = len(own)
    node = lambda i: F.expr(f"{i} div {m}") * 3 + F.element_at(F.array(*map(F.lit, own)), (F.expr(f"{i} % {m}") + 1).cast("int"))
    senders = instances.select(F.explode(F.array(*((F.col("id") * m + k) for k in range(m)))).alias("id"))
    drawn = partners(senders, F.lit(m * n - 1) - F.col("id"), p_inter, "motif", seed, made=(m * n) ** 2 * p_inter / 2).withColumn("to", F.col("id") + 1 + F.col("pick"))
    return stamped(instances, code).unionAll(drawn.select(node("id").alias("src"), node("to").alias("tgt"))).withColumn("weight", F.lit(weight))


def _shuffled(edges: DataFrame, value: Column, *key: str | int) -> DataFrame:
    """Sources in order, each with a value of an edge at the same place of a drawn order: (src, value)."""
    left = running(edges, "src", ["tgt"], F.lit(1), "place").select("src", "place")
    drawn = edges.select(draw(*key, F.col("src"), F.col("tgt")).alias("order"), "src", "tgt", value.alias("value"))
    right = running(drawn, "order", ["src", "tgt"], F.lit(1), "place").select("value", "place")
    return left.join(right, "place").select("src", "value")


def random_control(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Configuration model: out-degrees and the multiset of targets stay, who meets whom is drawn; all edges have the mean weight."""
    return _with_mean(_shuffled(edges, F.col("tgt"), "stubs", seed).withColumnRenamed("value", "tgt"), edges)


def uniform_targets(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Out-degrees stay, targets are drawn from all nodes with replacement."""
    return edges.select("src", below(n, "uniform", seed, F.col("src"), F.col("tgt")).alias("tgt"))


def motif_destroyed(edges: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """Out-degrees and, as far as the ids allow, the multiset of spans stay: a span that leads to no node ends at the nearest one, the smaller of two as near.

    nodes: id, any whole numbers.
    """
    moved = _shuffled(edges, F.col("tgt") - F.col("src"), "spans", seed).select("src", (F.col("src") + F.col("value")).alias("end"))
    return moved.join(nearest(moved, "end", nodes, "tgt"), "end").select("src", "tgt")


#: Points of a grid cell that are paired as one block.
CELL_BLOCK = 512
#: Pairs of blocks that a task takes.
TASK_PAIRS = 32


def _distance() -> Column:
    return F.sqrt((F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0")))


def _blocks(points: DataFrame, far: float) -> DataFrame:
    """(cx, cy, b, k, ids, xs, ys): points (id, x, y) of each grid cell in k blocks of about CELL_BLOCK, stashed."""
    cell = points.withColumn("cx", F.floor(F.col("x") / far)).withColumn("cy", F.floor(F.col("y") / far)).where("id is not null and cx is not null and cy is not null")
    sizes = cell.groupBy("cx", "cy").agg(F.ceil(F.count("*") / CELL_BLOCK).cast("int").alias("k"))
    dealt = cell.join(sizes, ["cx", "cy"]).withColumn("b", F.pmod(F.xxhash64("id"), "k").cast("int"))
    blocks = dealt.groupBy("cx", "cy", "b", "k").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("p"))
    return stash(blocks.select("cx", "cy", "b", "k", F.col("p.id").alias("ids"), F.col("p.x").alias("xs"), F.col("p.y").alias("ys")))


def _met_blocks(blocks: DataFrame) -> DataFrame:
    """Each pair of blocks whose cells touch, both ways: cx0, cy0, b0, ids0, xs0, ys0 of the sources, cx, cy, b, ids, xs, ys of the targets.

    A block of sources goes to each block of targets by the target's number, so that no task has to pair a whole cell.
    """
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    around = blocks.select(*(F.col(c).alias(f"{c}0") for c in ("cx", "cy", "b", "ids", "xs", "ys")), F.explode(near).alias("d"))
    around = around.withColumn("cx", F.col("cx0") + F.col("d.a")).withColumn("cy", F.col("cy0") + F.col("d.b")).drop("d")
    sizes = blocks.select("cx", "cy", "k").distinct()
    total = blocks.select("cx", "cy", F.explode(near).alias("d")).select((F.col("cx") + F.col("d.a")).alias("cx"), (F.col("cy") + F.col("d.b")).alias("cy")).join(sizes, ["cx", "cy"]).agg(F.sum("k")).first()[0] or 0  # one number
    sent = around.join(sizes, ["cx", "cy"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
    sent = sent.repartition(min(MOST_TASKS, max(1, math.ceil(total / TASK_PAIRS))), "cx", "cy", "b")
    return sent.join(blocks.drop("k"), ["cx", "cy", "b"])


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray]]]]:
    """(sources, targets, slabs) of the pairs of blocks in a batch; slabs: (first source, distances from it and some after it to each target), as many as fit in a processor's cache."""
    for row in range(batch.num_rows):
        ids0, xs0, ys0, ids, xs, ys = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids0", "xs0", "ys0", "ids", "xs", "ys"))
        step = max(1, STRETCHES // len(ids))

        def slabs(xs0=xs0, ys0=ys0, xs=xs, ys=ys, step=step) -> Iterator[tuple[int, np.ndarray]]:
            for at in range(0, len(xs0), step):
                dx, dy = xs[None, :] - xs0[at : at + step, None], ys[None, :] - ys0[at : at + step, None]
                yield at, np.sqrt(dx * dx + dy * dy)

        yield ids0, ids, slabs()


def _near_sum(blocks: DataFrame, length: float) -> float:
    """Sum of exp(-distance / length) over all ordered pairs of points whose cells touch; pairs of blocks are taken one way only."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = 0.0
            for src, tgt, slabs in _slabs(batch):
                for at, d in slabs:
                    d[src[at : at + len(d), None] == tgt[None, :]] = np.inf  # no point with itself
                    total += float(np.exp(d / -length).sum())
            yield pa.RecordBatch.from_pydict({"total": [total]})

    arrays = ["ids0", "xs0", "ys0", "ids", "xs", "ys"]
    met = _met_blocks(blocks)
    own, other = F.struct("cx0", "cy0", "b0"), F.struct("cx", "cy", "b")
    sides = (met.where(c).select(*arrays).mapInArrow(sums, "total double").agg(F.sum("total")).first()[0] or 0.0 for c in (own < other, own == other))
    return 2 * next(sides) + next(sides)


def _near(blocks: DataFrame, far: float, length: float = 1.0, base: float | None = None, seed: int = 0) -> DataFrame:
    """(src, tgt, distance) of all ordered pairs of points within a distance; with a base of those whose coin falls, of probability base * exp(-distance / length)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, tgt, slabs in _slabs(batch):
                coins, found = base is not None and CrossedDraws(f"spatial:{seed}", src, tgt), []
                for at, d in slabs:
                    i, j = np.divmod(np.flatnonzero(d <= far), len(tgt))
                    away, i = d[i, j], i + at
                    if coins:
                        which, u = coins.rare(i, j, base)
                        which = which[u < base * np.exp(-away[which] / length)]
                        i, j, away = i[which], j[which], away[which]
                    other = src[i] != tgt[j]
                    found.append((src[i[other]], tgt[j[other]], away[other]))
                yield pa.RecordBatch.from_pydict({c: np.concatenate(x) for c, x in zip(("src", "tgt", "distance"), zip(*found, strict=True), strict=True)})

    return _met_blocks(blocks).select("ids0", "xs0", "ys0", "ids", "xs", "ys").mapInArrow(pairs, "src long, tgt long, distance double")


def _near_pairs(points: DataFrame, far: float) -> DataFrame:
    """(src, tgt, distance) of all ordered pairs of points (id, x, y) within a distance."""
    return _near(_blocks(points, far), far)


def spatial(points: DataFrame, n: int, length: float, edges: float, reach: float = 4.0, seed: int = 0, source: DataFrame | None = None) -> DataFrame:
    """(src, tgt, weight) between points (id in 0..n-1, x, y), likelier the nearer they are: probability base * exp(-distance / length).

    base is set so that about `edges` are expected, one at most per ordered pair. Pairs within `reach` lengths meet in
    grid cells of that size, crowded ones in blocks, with a coin each, in numpy. No farther pair is likelier than base * e**-reach: candidates
    are drawn at that rate and kept at the rest of their probability, which is exact. The sum that sets base
    is added up pair by pair where cells touch and by far_field.far_sum beyond, to six digits at least with the usual reach. Edges have the mean weight of `source`.
    """
    _checked({"length": length, "reach": reach})
    far = reach * length
    points = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    blocks = _blocks(points, far)
    distance = _distance()
    ends = lambda df: df.join(points.select(F.col("id").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0")), "src").join(points.withColumnRenamed("id", "tgt"), "tgt").select("src", "tgt", distance.alias("distance")).where(F.col("distance") > far)
    other = lambda pick: F.pmod(F.col("id") + 1 + pick, F.lit(n))
    total = _near_sum(blocks, length)  # two numbers
    total += far_sum(points, n, length, far, 1e-8 * max(total, edges, 1e-9))  # base is 1 where the sum is below the edges wanted
    base = min(1.0, edges / total) if total else 0.0
    close = _near(blocks, far, length, base, seed).select("src", "tgt")
    drawn = partners(points.select("id"), F.lit(n - 1), base * math.exp(-reach), "far", seed, made=n * n * base * math.exp(-reach)).select(F.col("id").alias("src"), other(F.col("pick")).alias("tgt"))
    kept = ends(drawn).where(uniform("keep", seed, F.col("src"), F.col("tgt")) < F.exp((far - F.col("distance")) / length))
    out = close.unionAll(kept.select("src", "tgt"))
    return out.withColumn("weight", F.lit(NO_WEIGHT)) if source is None else _with_mean(out, source)
