import hashlib
import math
import random
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshgrain.functions.draws import CrossedDraws, Draws
from meshgrain.operators import generate, structure
from meshgrain.operators.census import CODES, _closable, properties, triad_census
from meshgrain.operators.far_field import far_sum
from meshgrain.operators.ranks import dense_ids, running, upper_median

TOY = [(i, i + 1) for i in range(7)] + [(7, 2)] + [(8, i) for i in range(8)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.range(12), spark.createDataFrame(TOY, "src long, tgt long").withColumn("weight", F.lit(0.5))


def mask(edges, x, y, z):
    return sum(1 << i for i, e in enumerate([(x, y), (y, x), (x, z), (z, x), (y, z), (z, y)]) if e in edges)


def test_codes_are_the_least_of_all_orders():
    pairs = [(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)]
    for m in range(64):
        edges = {e for i, e in enumerate(pairs) if m >> i & 1}
        assert CODES[m] == min(mask(edges, *order) for order in permutations(range(3)))


def brute(nodes, edges):
    edges, count = set(edges), {}
    for x, y, z in combinations(sorted(nodes), 3):
        code = min(mask(edges, *order) for order in permutations((x, y, z)))
        count[code] = count.get(code, 0) + 1
    return {0: 0, 1: 0, 3: 0} | count


def census(spark, edges, nodes=None):
    e = spark.createDataFrame(edges, "src long, tgt long") if edges else spark.createDataFrame([], "src long, tgt long")
    n = None if nodes is None else spark.createDataFrame([(x,) for x in nodes], "id long")
    return {r["code"]: r["count"] for r in triad_census(e, n).collect()}


def test_toy_structure(toy):
    nodes, edges = toy
    r = structure.structure_report(nodes, edges).first()
    assert (r["neurons"], r["edges"], r["isolated"], r["reciprocity"], r["max_out_degree"]) == (12, 16, 3, 0.0, 8)
    assert {r["role"]: r["count"] for r in structure.roles(nodes, edges).groupBy("role").count().collect()} == {"sensory": 1, "association": 1, "unassigned": 10}


def test_toy_census(spark):
    assert census(spark, TOY, range(12)) == {0: 105, 1: 78, 3: 0, 5: 20, 6: 8, 10: 1, 21: 8}


@pytest.mark.parametrize("seed", range(3))
def test_census_equals_brute_force(spark, seed):
    r = random.Random(seed)
    n, p = r.randrange(4, 20), r.choice([0.1, 0.35, 0.6])
    edges = [(a, b) for a in range(n) for b in range(n) if a != b and r.random() < p]
    assert census(spark, edges + [(0, 0)], range(n)) == brute(range(n), edges)


def test_census_of_nothing_and_of_sources_only(spark):
    assert census(spark, []) == {0: 0, 1: 0, 3: 0}
    assert census(spark, [(0, 1)], [0, 1]) == {0: 0, 1: 0, 3: 0}
    assert sum(census(spark, [(0, 1), (1, 0), (2, 0), (2, 9)]).values()) == 1


def test_code_properties():
    assert properties(25) == (3, 0, True) and properties(21) == (3, 0, False) and properties(63) == (6, 3, True)


def test_ranks(spark):
    ids = spark.createDataFrame([(x,) for x in (5, -3, 10**15, 7, 5)], "id long")
    assert [tuple(r) for r in dense_ids(ids, "id", "k").orderBy("id").collect()] == [(-3, 0), (5, 1), (7, 2), (10**15, 3)]
    assert sorted(r["b"] for r in running(ids, "id", [], F.lit(2), "b").collect()) == [0, 2, 4, 6, 8]
    assert upper_median(spark.range(6), "id").first()["id"] == 3


def test_ranks_of_wide_and_crowded_ids(spark):
    wide = spark.createDataFrame([(x,) for x in (-(2**63), 2**63 - 1, 0, 5)], "id long")
    assert [r["k"] for r in dense_ids(wide, "id", "k").orderBy("id").collect()] == [0, 1, 2, 3]
    crowded = spark.range(720 * 10**15, 720 * 10**15 + 5000).unionAll(spark.range(1))
    got = dense_ids(crowded, "id", "k").orderBy("id").collect()
    assert [r["k"] for r in got] == list(range(5001))


@pytest.mark.parametrize("p", [0.003, 0.05, 0.5, 0.97])
def test_drawn_pairs_follow_the_law_of_coins(spark, p):
    """Number of edges and spread of out-degrees of independent coins; every pair at most once."""
    n = 300
    got = generate.gnp(spark.range(n), n, p, seed=5).collect()
    assert len({tuple(r) for r in got}) == len(got) and all(r["src"] != r["tgt"] and 0 <= r["tgt"] < n for r in got)
    pairs = n * (n - 1)
    assert abs(len(got) - pairs * p) < 5 * (pairs * p * (1 - p)) ** 0.5
    degree = [0] * n
    for r in got:
        degree[r["src"]] += 1
    var = sum((d - len(got) / n) ** 2 for d in degree) / n
    assert 0.6 < var / ((n - 1) * p * (1 - p)) < 1.5


def test_sure_and_impossible_pairs(spark, toy):
    _, edges = toy
    assert generate.gnp(spark.range(40), 40, 1.0).count() == 40 * 39 and generate.gnp(spark.range(40), 40, 0.0).count() == 0
    assert generate.planted(spark.range(41), 41, 4, 1.0, 1.0).distinct().count() == 41 * 40
    inside = generate.planted(spark.range(41), 41, 4, 1.0, 0.0).collect()
    assert len(inside) == 11 * 10 + 3 * 10 * 9 and all(r["src"] % 4 == r["tgt"] % 4 for r in inside)
    cross = generate.replication(edges, 12, 3, 1.0).where("src div 12 <> tgt div 12")
    assert cross.distinct().count() == 36 * 24 and {r["weight"] for r in cross.select("weight").distinct().collect()} == {0.5}
    quarter = edges.withColumn("weight", F.lit(0.25))
    assert {r["weight"] for r in generate.population(quarter, 12, 2).collect()} == {0.25}
    assert {r["weight"] for r in generate.population(quarter.limit(0), 3, 2).collect()} == {0.5}
    assert generate.modular(edges, 12, 3, 2, 1.0).count() == generate.modular(edges, 12, 3, 2).count() + 24 * 23 // 2
    filled = generate.motif_fill(spark.range(5), 5, 25, 1.0)
    assert filled.count() == 15 + 15 * 14 // 2 and filled.where("src >= 15 or tgt >= 15").count() == 0


def test_spatial_edges_at_all_distances(spark):
    r = random.Random(7)
    points = [(i, r.random(), r.random()) for i in range(400)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {tuple(e)[:2] for e in generate.spatial(df, 400, 0.1, 3000, seed=3).collect()}
    away = lambda a, b: ((points[a][1] - points[b][1]) ** 2 + (points[a][2] - points[b][2]) ** 2) ** 0.5
    pull = {(a, b): 2.718281828459045 ** (-away(a, b) / 0.1) for a in range(400) for b in range(400) if a != b}
    total = sum(pull.values())
    assert abs(len(got) - 3000) < 250
    far = [e for e in got if away(*e) > 0.4]
    want = 3000 * sum(v for e, v in pull.items() if away(*e) > 0.4) / total
    assert abs(len(far) - want) < 5 * want**0.5


@pytest.mark.parametrize("wide", [1.0, 30.0])
def test_far_pairs_add_up_by_polynomials(spark, wide):
    """Within 1e-6 of the sum over all pairs whose cells don't touch; half of the points crowd one spot, one stands far away, one has no place."""
    r = np.random.default_rng(3)
    xy = np.r_[r.random((300, 2)) * wide - wide / 3, r.normal(0.3, 0.01, (300, 2)), [[40.0, -40.0]]]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in xy] + [(None, 1.0), (float("nan"), 0.0)], "x double, y double")
    cell = np.floor(xy / 0.4)
    apart = np.abs(cell[:, None] - cell[None]).max(-1) > 1
    far = np.hypot(*np.moveaxis(xy[:, None] - xy[None], -1, 0))
    want = np.exp(-far / 0.1)[apart].sum()
    assert far_sum(df, len(xy), 0.1, 0.4, 1e-8 * want) == pytest.approx(want, rel=1e-6)
    assert far_sum(df.limit(0), 0, 0.1, 0.4, 1e-8) == 0


def test_generators_keep_their_promises(spark, toy):
    _, edges = toy
    assert generate.replication(edges, 12, 3).count() == 48
    assert generate.duplication(edges, 12, 0.0, 0.0).count() == 32
    assert generate.population(edges, 12, 5, 1.0, 1.0).count() == 640
    assert generate.modular(edges, 12, 3, 2).count() == 2 * sum(a % 3 == b % 3 for a, b in TOY)
    control = generate.random_control(edges).collect()
    assert sorted(r["src"] for r in control) == sorted(a for a, _ in TOY)
    assert sorted(r["tgt"] for r in control) == sorted(b for _, b in TOY)
    assert generate.gnp(spark.range(200), 200, 0.05, seed=2).groupBy("src").count().agg(F.avg("count")).first()[0] == pytest.approx(9.9, abs=0.5)
    planted = generate.planted(spark.range(300), 300, 3, 0.08, 0.005)
    assert planted.where("src % 3 = tgt % 3").count() > planted.count() / 2
    assert planted.where("src = tgt").count() == 0
    assert {(r["src"], r["tgt"]) for r in generate.stamped(spark.range(1), 25).collect()} in ({(0, 1), (1, 2), (2, 0)}, {(1, 0), (2, 1), (0, 2)})


def plain_draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def plain_partners(ident, among, p, *key):
    """The numbers that a node gets, one draw after another."""
    width, found = math.ceil(16 / p), []
    for stretch in range(-(-among // width)):
        at, k, size = -1, 0, min(width, among - stretch * width)
        while (at := at + 1 + math.floor(math.log(1 - plain_draw(*key, ident, stretch, k)) / math.log1p(-p))) < size:
            found.append(stretch * width + at)
            k += 1
    return found


def test_sure_pairs_are_dealt_out_and_not_drawn(spark):
    """Nodes that come in one partition, as a small table does, are not worked on by one task; nothing is drawn for them."""
    made = generate.gnp(spark.range(6000, numPartitions=1), 6000, 1.0).groupBy("src").agg(F.count("*").alias("n"), F.sum("tgt").alias("total"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "aggregate(" not in plan
    assert generate.gnp(spark.range(6000, numPartitions=1), 6000, 1.0).rdd.getNumPartitions() > 1
    assert made.where(F.expr("n = 5999 and total = 6000 * 5999 div 2 - src")).count() == 6000


@pytest.mark.parametrize("top", [5, 12345, 10**8, 10**12, 2**62])
def test_draws_in_numpy_are_those_of_md5(top):
    r = np.random.default_rng(top)
    x, y = r.integers(0, top, 200), r.integers(0, 120, 200)
    d = Draws("edge weight:1", x, y)
    for k in (None, 0, 9, 10, 127):
        assert d.at(k).tolist() == [plain_draw("edge weight", 1, a, b, *([] if k is None else [k])) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    d.keep(x % 2 == 0)
    assert d.at(3).tolist() == [plain_draw("edge weight", 1, a, b, 3) for a, b in zip(x.tolist(), y.tolist(), strict=True) if a % 2 == 0]
    assert Draws("z:1", np.array([-3, 5]), pd.Series([1, None])).at(1).tolist() == [plain_draw("z", 1, -3, 1, 1), plain_draw("z", 1, 5, 1)]


def test_drawn_pairs_are_dealt_out(spark):
    """As above, with a weight for each edge that is the draw of its ends."""
    assert generate.gnp(spark.range(8000, numPartitions=1), 8000, 0.05, seed=1).rdd.getNumPartitions() > 3
    got = {(r["src"], r["tgt"]): r["weight"] for r in generate.gnp(spark.range(70, numPartitions=1), 70, 0.3, seed=1).collect()}
    assert got == {(a, b): 0.2 + plain_draw("edge weight", 1, a, b) * (0.8 - 0.2) for a in range(70) for b in ((a + 1 + k) % 70 for k in plain_partners(a, 69, 0.3, "gnp", 1))}


def test_filled_pairs_are_dealt_out(spark):
    assert generate.motif_fill(spark.range(6000, numPartitions=1), 6000, 27, 0.03, seed=8).rdd.getNumPartitions() > 5
    got = [(r["src"], r["tgt"]) for r in generate.motif_fill(spark.range(20, numPartitions=1), 20, 27, 0.1, seed=8).collect()]
    assert sorted(got) == sorted([(3 * i + a, 3 * i + b) for i in range(20) for a, b in generate.motif_edges(27)] + [(a, a + 1 + k) for a in range(60) for k in plain_partners(a, 59 - a, 0.1, "motif", 8)])


@pytest.mark.parametrize("top", [30, 2000, 10**6, 10**11, 2**61])
def test_rare_pairs_of_two_lists(top):
    r = np.random.default_rng(top)
    a, b = np.sort(r.integers(0, top, 20)), r.integers(0, top, 30)
    i, j = np.divmod(np.arange(600), 30)
    which, u = CrossedDraws("spatial:6", a, b).rare(i, j, 0.3)
    assert dict(zip(which.tolist(), u.tolist(), strict=True)) == {k: v for k, (x, y) in enumerate(zip(a[i].tolist(), b[j].tolist(), strict=True)) if (v := plain_draw("spatial", 6, x, y)) < 0.3}


def test_near_coins_are_those_of_pairs(spark, monkeypatch):
    """Blocks of points are paired in numpy, each pair with its own draw; no row for each pair goes through a join."""
    r = random.Random(4)
    points = [(i, r.random(), r.random()) for i in range(150)] + [(150, None, 0.5)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    monkeypatch.setattr(generate, "CELL_BLOCK", 16)
    away = {(a, b): ((q - x) ** 2 + (v - y) ** 2) ** 0.5 for a, x, y in points[:150] for b, q, v in points[:150] if a != b}
    got = {(e["src"], e["tgt"]) for e in generate._near(generate._blocks(df, 0.2), 0.2, 0.05, 0.9, 6).collect()}
    assert got == {e for e, d in away.items() if d <= 0.2 and plain_draw("spatial", 6, *e) < 0.9 * math.exp(-d / 0.05)}


def test_census_counts_beyond_a_long(spark):
    """Four million nodes have more triads than a long holds."""
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 6)], "src long, tgt long")
    n = 4_000_000
    got = {r["code"]: int(r["count"]) for r in triad_census(edges, spark.range(n)).collect()}
    assert got == {0: n * (n - 1) * (n - 2) // 6 - 1 - 3 * (n - 3) - (n - 2), 1: 3 * (n - 3) + n - 2, 3: 0, 25: 1}


def test_no_wedges_where_no_neighbour_goes_on(spark):
    """Parts have suppliers, suppliers have nothing above them: no pair of suppliers is made. In a whole graph all arcs stay."""
    parts = spark.createDataFrame([(p, 1000 + s, 1) for p in range(100, 150) for s in range(20)], "u long, v long, t int")
    whole = spark.createDataFrame([(a, b, 3) for a in range(30) for b in range(a + 1, 30)], "u long, v long, t int")
    assert _closable(parts).count() == 0 and _closable(whole).count() == 30 * 29 // 2
    assert _closable(parts.unionAll(whole)).count() == 30 * 29 // 2


def spread(df):
    """Rows of the fullest task over the mean of tasks with rows."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return len(n), max(n) * len(n) / sum(n)


def test_planted_pairs_are_dealt_out(spark):
    assert generate.planted(spark.range(8000, numPartitions=1), 8000, 4, 0.08, 0.005).rdd.getNumPartitions() > 2


def test_hybrid_duplicates_in_numpy_as_in_spark(spark, toy):
    _, edges = toy
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(generate.duplication(generate.modular(edges, 12, 3, 4, 0.3, 2), 48, 0.2, 0.2, 3))
    assert rows(generate.hybrid(edges, 12, 3, 4, 0.2, 0.3, 2)) == want
    made = generate._duplicated(np.arange(40), np.arange(1, 41), 50, 0.2, 0.2, 3)
    ends = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("tgt"), F.lit(0.5).alias("weight"))
    assert sorted(zip(made["src"].tolist(), made["tgt"].tolist(), strict=True)) == [r[:2] for r in rows(generate.duplication(ends, 50, 0.2, 0.2, 3))]


def test_links_to_later_nodes_are_dealt_out_evenly(spark, toy, monkeypatch):
    """First nodes have the most later ones; no task gets most of the links."""
    monkeypatch.setattr(generate, "TASK_ROWS", 1 << 14)
    tasks, most = spread(generate.modular(toy[1].limit(0), 800, 4, 2, 0.05))
    assert tasks > 2 and most < 1.4


def test_links_between_tiles_are_dealt_out_evenly(spark, toy, monkeypatch):
    monkeypatch.setattr(generate, "TASK_ROWS", 1 << 14)
    tasks, most = spread(generate.replication(toy[1].limit(0), 500, 3, 0.05))
    assert tasks > 1 and most < 1.4
