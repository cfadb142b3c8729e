import random

import pytest
from pyspark.sql import functions as F

from meshgrain.operators import census, generate
from meshgrain.operators.ranks import dense_ids, nearest, next_in_order, places, running_sums, upper_median
from meshgrain.sources.samples import toy_graph


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_sums_and_places(spark, ranges):
    r = random.Random(1)
    data = [(r.choice([None, *range(5)]), i, r.randrange(-3, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "g int, i long, w long")
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    sums, at = {}, 0
    for x in order:
        sums[x[1]] = at
        at += x[2]
    assert {x["i"]: x["s"] for x in running_sums(df, ["g", "i"], {"s": F.col("w")}).collect()} == sums
    known = df.where("g is not null")
    want = {x[1]: sum(y[0] == x[0] and y[1] < x[1] for y in data) for x in data if x[0] is not None}
    assert {x["i"]: x["p"] for x in places(known, ["g"], ["i"], "p").collect()} == want
    assert running_sums(df.limit(0), ["i"], {"s": F.col("w")}).count() == 0


def test_next_row(spark, ranges):
    r = random.Random(2)
    data = [(r.randrange(10**6), i, f"v{i}" if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(data, "t long, i long, v string")
    order = sorted(data)
    want = {a[1]: b[2] for a, b in zip(order, [*order[1:], (0, 0, None)], strict=True)}
    assert {x["i"]: x["after"] for x in next_in_order(df, ["t", "i"], "v", "after").collect()} == want
    assert next_in_order(df.limit(0), ["t"], "v", "after").count() == 0
    assert [x["after"] for x in next_in_order(df.limit(1), ["t"], "v", "after").collect()] == [None]


def test_nearest(spark, ranges):
    r = random.Random(3)
    ids, values = sorted(r.sample(range(-2000, 2000), 60)), [r.randrange(-4000, 4000) for _ in range(400)] + [0, 0]
    got = nearest(spark.createDataFrame([(v,) for v in values], "x long"), "x", spark.createDataFrame([(i,) for i in ids], "id long"), "near")
    assert {x["x"]: x["near"] for x in got.collect()} == {v: min(ids, key=lambda i: (abs(i - v), i)) for v in values}
    assert nearest(spark.range(3), "id", spark.range(0), "near").count() == 0


def test_medians_and_ids(spark, ranges):
    df = spark.createDataFrame([(x,) for x in (5, 5, 1, 9, None, 7)], "x long")
    assert upper_median(df, "x").first()["x"] == 5
    assert sorted(map(tuple, dense_ids(df, "x", "i").collect())) == [(1, 0), (5, 1), (7, 2), (9, 3)]


def test_wedges_of_a_hub_are_spread(spark, monkeypatch):
    """Two hubs whose neighbours are joined to each other: the census stays, and no key holds more than a few blocks of pairs."""
    r = random.Random(4)
    n = 220
    edges = [(h, x) for h in range(20) for x in range(20, n)] + [(r.randrange(20, n), r.randrange(20, n)) for _ in range(900)]
    df = spark.createDataFrame(edges, "src long, tgt long")
    whole = census.triad_census(df, spark.range(n)).collect()
    monkeypatch.setattr(census, "BLOCK", 4)
    assert census.triad_census(df, spark.range(n)).collect() == whole
    arcs = spark.createDataFrame([(0, v, 1) for v in range(2000)], "u long, v long, t int")
    monkeypatch.setattr(census, "BLOCK", 64)
    pairs = census._wedges(arcs)
    assert pairs.count() == 2000 * 1999 // 2 and pairs.distinct().count() == 2000 * 1999 // 2
    blocks = arcs.withColumn("c", F.pmod(F.xxhash64("v"), F.lit(32))).groupBy("c").count().collect()
    assert len(blocks) == 32 and max(b["count"] for b in blocks) <= 2 * 64


def test_arguments_of_generators(spark):
    edges, nodes = toy_graph(spark)
    wrong = [
        lambda: generate.replication(edges, 12, 0), lambda: generate.replication(edges, 12, 2, 1.5), lambda: generate.duplication(edges, 12, -0.1),
        lambda: generate.modular(edges, 12, 0, 2), lambda: generate.population(edges, 12, 0), lambda: generate.population(edges, 12, 2, 2.0), lambda: generate.hybrid(edges, 12, 2, 2, 0.05, -1.0),
        lambda: generate.gnp(nodes, 12, 2.0), lambda: generate.planted(nodes, 12, 13, 0.1, 0.1), lambda: generate.planted(nodes, 12, 0, 0.1, 0.1), lambda: generate.gnp(nodes, 12, 0.5, low=0.8, high=0.2),
        lambda: generate.motif_fill(nodes, 12, 27, 7.0), lambda: generate.spatial(nodes, 12, 0.0, 4),
    ]
    for call in wrong:
        with pytest.raises(ValueError):
            call()


def test_grown_toy_graphs(spark):
    edges, nodes = toy_graph(spark)
    assert edges.count() == 16 and nodes.count() == 12
    full = generate.population(edges, 12, 5, 1.0, 1.0)
    assert full.count() == full.distinct().count() == 12 * 20 + 16 * 25 and full.where("src = tgt").count() == 0
    assert {round(r["weight"], 9) for r in full.where("src div 5 <> tgt div 5").select("weight").distinct().collect()} == {0.4, 0.6, 0.8}
    assert generate.population(edges, 12, 2, 0.0, 0.0).count() == 0
    some = generate.population(edges, 12, 40, 0.5, 0.3, seed=3)
    inside, between = some.where("src div 40 = tgt div 40").count(), some.where("src div 40 <> tgt div 40").count()
    assert abs(inside - 0.5 * 12 * 40 * 39) < 5 * (0.25 * 12 * 40 * 39) ** 0.5 and abs(between - 0.3 * 16 * 1600) < 5 * (0.21 * 16 * 1600) ** 0.5
    # hybrid: two modules tiled twice, then links between all later nodes, then twice; with nothing dropped all of it stays
    grown = generate.hybrid(edges, 12, 2, 2, 0.0, 1.0)
    kept = edges.where("src % 2 = tgt % 2").count() * 2
    assert grown.count() == 2 * (kept + 24 * 23 // 2) and grown.agg(F.max("src")).first()[0] < 48
    drawn = generate.gnp(spark.range(300), 300, 0.02, seed=5)
    assert drawn.where("weight < 0.2 or weight >= 0.8").count() == 0 and 1200 < drawn.count() < 2400
    control = generate.random_control(edges, seed=8)
    assert {round(r["weight"], 9) for r in control.collect()} == {round((7 * 0.6 + 0.8 + 8 * 0.4) / 16, 9)}
    for end in ("src", "tgt"):
        assert sorted(r[end] for r in control.collect()) == sorted(r[end] for r in edges.collect())


def test_a_crowded_cell_is_paired_in_blocks(spark, monkeypatch):
    """Most points in one spot: all near pairs come once, whatever the blocks, and no key holds more than a few blocks' pairs."""
    r = random.Random(5)
    points = [(i, r.gauss(0, 0.01), r.gauss(0, 0.01)) if i < 250 else (i, r.random(), r.random()) for i in range(330)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    want = sorted((a[0], b[0]) for a in points for b in points if a[0] != b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 0.2)
    for block in (512, 16):
        monkeypatch.setattr(generate, "CELL_BLOCK", block)
        assert sorted((x["src"], x["tgt"]) for x in generate._near_pairs(df, 0.2).collect()) == want
