import random

import pytest
from pyspark.sql import functions as F

from meshgrain.operators import dynamics
from meshgrain.streaming import replay
from meshgrain.streaming.residency import ACTIVE, CANDIDATE, DORMANT, EVICTED, EVICTING, QUIESCENT, Rules, frontier_counts, numbered, queue_stream, transition_stream


def lives(seen, horizon, rules):
    """(nid, tick, step, from, to, cause) by going through every tick, observations first, and ticks at whose end each node was resident."""
    out, resident = [], {}
    for nid in sorted({n for n, _ in seen}):
        state, count, first, last, held = DORMANT, 0, 0, 0, 0
        ticks = [t for n, t in seen if n == nid]
        for t in range(horizon):
            step = 0
            for _ in range(ticks.count(t)):
                old, last = state, t
                if state in (DORMANT, EVICTED):
                    state, count, first = CANDIDATE, 1, t
                elif state == CANDIDATE:
                    count += 1
                    state = ACTIVE if count >= rules.activate else CANDIDATE
                else:
                    state = ACTIVE
                if state != old:
                    out.append((nid, t, step, old, state, "observed"))
                    step += 1
            held += state in (ACTIVE, QUIESCENT, EVICTING)
            old = state
            if state == CANDIDATE and t - first >= rules.timeout:
                state = DORMANT
            elif state == ACTIVE and t - last >= rules.quiet:
                state = QUIESCENT
            elif state == QUIESCENT and t - last >= rules.evict:
                state = EVICTING
            elif state == EVICTING:
                state = EVICTED
            if state != old:
                out.append((nid, t, 0, old, state, "swept"))
        resident[nid] = held
    return sorted(out), resident


def observations(seed, nodes=12, horizon=300):
    r = random.Random(seed)
    return [(k, t) for k in range(nodes) for t in sorted(r.choice([r.randrange(horizon), r.randrange(40)]) for _ in range(r.randrange(1, 25))) for _ in range(r.choice([1, 1, 2]))]


@pytest.mark.parametrize("seed", range(3))
def test_transitions_from_gaps(spark, seed):
    seen, rules = observations(seed), Rules(2, 5, 30, 8)
    rows = spark.createDataFrame(seen, "nid long, tick int")
    want, resident = lives(seen, 300, rules)
    got = dynamics.frontier_transitions(rows, 300, rules.quiet, rules.evict, rules.timeout).select("nid", "tick", "step", "from_state", "to_state", "cause")
    assert sorted(map(tuple, got.collect())) == want
    held = {r["nid"]: (r["resident_ticks"], r["eviction_requests"]) for r in dynamics.frontier_residency(rows, 300, rules.quiet, rules.evict, rules.timeout).collect()}
    assert held == {n: (resident[n], sum(x[0] == n and x[4] == EVICTING for x in want)) for n in resident}


@pytest.mark.parametrize("rules", [Rules(2, 5, 30, 8), Rules(3, 10, 20, 10)])
def test_stream_with_timers(spark, rules):
    """A replay in more than five batches, rows in drawn order inside each, equals going through every tick."""
    seen = observations(7)
    rows = spark.createDataFrame(seen, "nid long, tick int")
    out, query = replay.run(transition_stream(replay.arrivals(rows.coalesce(1), 6, 299 + 50), rules, late=50), "append")
    got = out.select("nid", "tick", "step", "from_state", "to_state", "cause").collect()
    forgotten = [(*x[:3], DORMANT if x[3] == EVICTED else x[3], *x[4:]) for x in lives(seen, 300, rules)[0]]
    assert sorted(map(tuple, got)) == sorted(forgotten)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 5
    if rules.activate == 2:
        a = sorted(map(tuple, frontier_counts(out).collect()))
        b = dynamics.frontier(rows.withColumn("event_id", F.monotonically_increasing_id()), 300, rules.quiet, rules.evict, rules.timeout)
        assert a == sorted(map(tuple, b.select("nid", "activations", "reactivations", "abandoned", "quieted", "evictions", "state").collect()))


def test_state_goes_with_eviction(spark):
    """Forty nodes are busy early on, one late: the state of the forty is gone at the end, and so are their timers."""
    seen = [(k, t) for k in range(40) for t in (1, 2, 3)] + [(99, t) for t in range(100, 400, 10)]
    rows = spark.createDataFrame(seen, "nid long, tick int").coalesce(1)
    _, query = replay.run(transition_stream(replay.arrivals(rows, 5, 399 + 100), Rules(2, 15, 60, 15), late=100), "append")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    last = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(last) >= 80 and last[-1] <= 8, (held, last)


def test_rules():
    for bad in (Rules(1), Rules(2, 0), Rules(2, 10, 10), Rules(2, 5, 10, 0)):
        with pytest.raises(ValueError):
            bad.checked()


def test_queue_as_a_stream(spark):
    r = random.Random(3)
    events = [(r.randrange(60), r.randrange(9), e) for e in range(400)] + [(7, 1, 1000 + e) for e in range(300)]
    rows = spark.createDataFrame(events, "tick int, nid long, event_id long")
    out, query = replay.run(queue_stream(replay.arrivals(rows.coalesce(1), 6, 59 + 10), late=10, width=128), "append")
    got = numbered(out).select("tick", "seq", "event_id", "nid")
    want = dynamics.queue_order(rows).select("tick", "seq", "event_id", "nid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 700
    assert out.groupBy("tick").agg(F.countDistinct("_batch").alias("n")).where("n > 1").count() == 0  # a tick comes out at once
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 5


def test_late_events_are_dropped_and_counted(spark):
    first = spark.createDataFrame([(5, 1, 1), (30, 1, 2)], "tick int, nid long, event_id long")
    then = spark.createDataFrame([(6, 1, 3), (31, 1, 4)], "tick int, nid long, event_id long")  # tick 6 comes out in this batch
    late = spark.createDataFrame([(7, 1, 5), (32, 1, 6)], "tick int, nid long, event_id long")
    from meshgrain.sources.stored import own_folder

    folder = own_folder(spark, "late")
    for part in (first, then, late, spark.createDataFrame([(99, None, None)], "tick int, nid long, event_id long")):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out, query = replay.run(queue_stream(stream, late=10), "append")
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3, 4, 6]
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) == 1
