import math
import random

import pytest
from pyspark.sql import functions as F

from meshgrain.functions.draws import blake2b_64, keyed_target, keyed_uniform
from meshgrain.operators import dynamics, trains
from meshgrain.sources import edge_files
from tests.compare import plain_hash


def lif(currents, ticks):
    decay, v, until, n = math.exp(-0.1 / 20.0), 0.0, 0, 0
    for t in range(ticks):
        i = currents.get(t, 0.0)
        if t < until:
            v = 0.0
            continue
        v = i + (v - i) * decay
        if v >= 1.0:
            v, until, n = 0.0, t + 21, n + 1
    return n, v


def test_integration_is_exact(spark):
    r = random.Random(1)
    runs = {k: {t: r.choice([0.5, 3.0, 24.0, 250.0]) for t in range(300) if r.random() < k / 10} for k in range(10)}
    rows = spark.createDataFrame([(k, t, i) for k, x in runs.items() for t, i in x.items()], "nid long, tick int, i double")
    got = {r["nid"]: (r["n_spikes"], r["v"]) for r in dynamics.integrate(rows, spark.range(10), 300).collect()}
    assert got == {k: lif(x, 300) for k, x in runs.items()}


def test_currents_add_one_by_one(spark):
    s = spark.createDataFrame([(0, 3)] * 7, "nid long, tick int")
    assert dynamics.currents(s, 10, 0.4).first()["i"] == 0.4 + 0.4 + 0.4 + 0.4 + 0.4 + 0.4 + 0.4


def test_delivery_needs_a_delay(spark):
    with pytest.raises(ValueError):
        dynamics.delivered(spark.range(1), spark.range(1), 0, 10)


@pytest.mark.parametrize("seed", range(3))
def test_frontier_equals_sweeping_every_tick(spark, seed):
    r = random.Random(seed)
    seen = [(k, t, e) for k in range(20) for e, t in enumerate(sorted(r.randrange(400) for _ in range(r.randrange(1, 25))))]
    rows = spark.createDataFrame([(k, t, k * 1000 + e) for k, t, e in seen], "nid long, tick int, event_id long")
    got = {x["nid"]: (x["activations"], x["reactivations"], x["abandoned"], x["quieted"], x["evictions"], x["state"]) for x in dynamics.frontier(rows, 400).collect()}
    for k in range(20):
        ticks = [t for i, t, _ in seen if i == k]
        state, count, first, last = None, 0, 0, 0
        n = dict.fromkeys(("act", "re", "ab", "qu", "ev"), 0)
        for t in range(400):
            for _ in range(ticks.count(t)):
                if state in (None, "dormant", "evicted"):
                    state, count, first = "candidate", 1, t
                elif state == "candidate":
                    count += 1
                    if count >= 2:
                        state, n["act"] = "active", n["act"] + 1
                elif state in ("quiescent", "evicting"):
                    state, n["re"] = "active", n["re"] + 1
                last = t
            if state == "candidate" and t - first >= 15:
                state, n["ab"] = "dormant", n["ab"] + 1
            elif state == "active" and t - last >= 15:
                state, n["qu"] = "quiescent", n["qu"] + 1
            elif state == "quiescent" and t - last >= 60:
                state = "evicting"
            elif state == "evicting":
                state, n["ev"] = "evicted", n["ev"] + 1
        assert got[k] == (*n.values(), state), k


def test_fidelity_rules(spark):
    nodes = spark.range(4)
    a = spark.createDataFrame([(0, 1), (0, 5), (1, 2), (3, 7)], "nid long, tick int")
    same = trains.fidelity(a, a, nodes, 10).first()
    assert same["all_ok"] and same["count_r"] == 1.0
    none = a.limit(0)
    both = trains.fidelity(none, none, nodes, 10).first()
    assert (both["rate_ratio"], both["count_r"], both["binned_cosine"]) == (1.0, 1.0, 1.0)
    one = trains.fidelity(none, a, nodes, 10).first()
    assert (one["rate_ratio"], one["count_r"], one["binned_cosine"], one["all_ok"]) == (math.inf, 0.0, 0.0, False)


def test_health_of_silence(spark):
    h = {r["check"]: r["passed"] for r in trains.health(spark.createDataFrame([], "nid long, tick int"), spark.range(5), 100).collect()}
    assert not h["dead"] and not h["isolation"] and h["exploding"]


def test_bad_edge_rows(spark):
    rows = [("0", "1", "5", "GABA"), ("3", "4", "1", ""), ("-1", "1", "1", "ACH"), ("0", "1", "0", "ACH"), ("0", "1", "1", "XYZ"), ("x", "1", "1", "ACH"), (None, "1", "1", "ACH")]
    got = [r["problem"] for r in edge_files.normalised(spark.createDataFrame(rows, edge_files.CSV_SCHEMA)).collect()]
    assert got == [None, None, "negative id", "no synapses", "unknown transmitter", "not a number", "not a number"]


def test_files_and_names(spark, tmp_path):
    spark.createDataFrame([(1, 2, 0, 0.5), (0, 2, 1, None), (3, 3, 1, None), (2, 1, 255, 0.01)], edge_files.CHUNK_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "c"))
    part = next((tmp_path / "c").glob("part-*.parquet"))
    part.rename(part.with_name("chunk-00000.parquet"))
    chunks = edge_files.read_chunks(spark, str(tmp_path / "c"))
    assert edge_files.cleaned(chunks).count() == 1
    assert [tuple(r)[:2] for r in edge_files.describe(spark, str(tmp_path / "c/chunk-00000.parquet")).collect()] == [("chunk-00000.parquet", 4)]
    (tmp_path / "e.csv").write_text("pre_id,post_id,synapses,neurotransmitter\n0,1,5,GABA\n1,2,3,ach\n")
    assert edge_files.normalised(edge_files.read_edge_csv(spark, str(tmp_path / "e.csv"))).where("problem is null").count() == 2
    assert [r[0] for r in spark.range(8).select(edge_files.nt_name(F.col("id"))).collect()][4:] == ["SER", "DA", "UNKNOWN", "UNKNOWN"]


def test_keyed_hash_layout(spark):
    rows = [(0, 0), (5, 2), (-1, 7), (2**62, 2**31), (-(2**63), 3)]
    df = spark.createDataFrame(rows, "id long, k long")
    got = df.select("id", "k", keyed_target(F.col("id"), F.col("k"), 97, 9, 7).alias("t"), keyed_uniform(F.col("id"), F.col("k"), -4, 7, 2).alias("u")).collect()
    for r in got:
        assert r["t"] == plain_hash("QQQQII", 9, r["id"], 7, 0, r["k"], 0) % 97
        assert r["u"] == plain_hash("QQQQII", -4, r["id"], 7, 2, r["k"], 1) / 2.0**64
    assert int(blake2b_64([1, 2, 3, 4, 5], 40)[0]) == plain_hash("QQQQQ", 1, 2, 3, 4, 5)
