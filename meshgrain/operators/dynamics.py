"""Keyed state over integer ticks: leaky integration, delayed delivery, residency. Order is (tick, seq)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshgrain.functions.draws import below, uniform
from meshgrain.operators.ranks import places, running


def currents(spikes: DataFrame, ticks: int, each: float) -> DataFrame:
    """(nid, tick, i): `each` for every spike of a node in a tick, added one by one as a running sum would be."""
    n = spikes.where(F.col("tick").between(0, ticks - 1)).groupBy("nid", "tick").agg(F.count("*").cast("int").alias("n"))
    return n.select("nid", "tick", F.aggregate(F.array_repeat(F.lit(each), F.col("n")), F.lit(0.0), lambda a, x: a + x).alias("i"))


def integrate(inputs: DataFrame, nodes: DataFrame, ticks: int, tau_ms: float = 20.0, threshold: float = 1.0, reset: float = 0.0, start: float = 0.0, dt_ms: float = 0.1, refractory_ms: float = 2.0) -> DataFrame:
    """(nid, n_spikes, v): spikes of every node within `ticks` and its voltage at the end.

    inputs: nid, tick, i, one row at most for each node and tick. A node's rows, at most
    `ticks` of them, are folded in order of tick; ticks without input decay step by step, as
    they would one at a time, so the result is the same to the bit.
    """
    decay, quiet = math.exp(-dt_ms / tau_ms), round(refractory_ms / dt_ms)
    state = F.struct(F.lit(start).alias("v"), F.lit(0).alias("until"), F.lit(-1).alias("last"), F.lit(0).alias("n"))

    def idle(s, upto):  # from the tick after the last to the one before upto
        first = F.greatest(s["last"] + 1, s["until"])
        steps = F.greatest(upto - first, F.lit(0))
        v = F.when(s["until"] > s["last"] + 1, F.when(upto > s["last"] + 1, F.lit(reset)).otherwise(s["v"])).otherwise(s["v"])
        return F.aggregate(F.array_repeat(F.lit(0.0), steps.cast("int")), v, lambda a, x: x + (a - x) * F.lit(decay))

    def step(s, x):
        v = x["i"] + (idle(s, x["tick"]) - x["i"]) * F.lit(decay)
        held, fires = x["tick"] < s["until"], (x["tick"] >= s["until"]) & (v >= threshold)
        return F.struct(
            F.when(held | fires, F.lit(reset)).otherwise(v).alias("v"),
            F.when(fires, x["tick"] + 1 + quiet).otherwise(s["until"]).cast("int").alias("until"),
            x["tick"].cast("int").alias("last"),
            (s["n"] + fires.cast("int")).alias("n"),
        )

    rows = inputs.groupBy("nid").agg(F.array_sort(F.collect_list(F.struct("tick", "i"))).alias("x"))
    rows = nodes.select(F.col("id").alias("nid")).join(rows, "nid", "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<tick:int,i:double>>")))
    end = rows.select("nid", F.aggregate("x", state, step).alias("s"))
    return end.select("nid", F.col("s.n").alias("n_spikes"), idle(F.col("s"), F.lit(ticks)).alias("v"))


def delivered(spikes: DataFrame, edges: DataFrame, delay: int, ticks: int) -> DataFrame:
    """(tick, nid, n): spikes that reach each node `delay` ticks later over edges (src, tgt), within `ticks`."""
    if delay < 1:
        raise ValueError("delay must be at least one tick")
    sent = spikes.select(F.col("nid").alias("src"), (F.col("tick") + delay).alias("tick")).where(F.col("tick") < ticks)
    return sent.groupBy("src", "tick").agg(F.count("*").alias("k")).join(edges, "src").groupBy("tick", F.col("tgt").alias("nid")).agg(F.sum("k").alias("n"))


def queue_order(events: DataFrame) -> DataFrame:
    """events (tick, nid, event_id) with seq: first in, first out within each tick."""
    return places(events, ["tick"], ["event_id"], "seq").withColumn("seq", (F.col("seq") + 1).cast("int"))


def drained(queue: DataFrame, upto: int) -> DataFrame:
    """What a queue in order (tick, seq) gives out up to and with a tick."""
    return queue.where(F.col("tick") <= upto)


def queue_head(queue: DataFrame, after: int) -> DataFrame:
    """One row: what is left after a drain up to `after`: how many events, the next tick and the first event (nulls: none)."""
    left = queue.where(F.col("tick") > after)
    return left.agg(F.count("*").alias("waiting"), F.min("tick").alias("next_tick"), F.min(F.struct("tick", "seq", "event_id", "nid")).alias("first")).select("waiting", "next_tick", F.col("first.event_id").alias("event_id"), F.col("first.nid").alias("nid"))


def peak_resident(observations: DataFrame, keep: int) -> DataFrame:
    """One row (tick, resident): the first tick at which most nodes are resident, each for `keep` ticks after an observation."""
    seen = observations.select("nid", "tick").distinct()
    until = F.least(F.coalesce(F.lead("tick").over(Window.partitionBy("nid").orderBy("tick")), F.lit(2**31 - 1)), F.col("tick") + keep + 1)
    stays = seen.withColumn("until", until)
    step = stays.select(F.explode(F.array(F.struct("tick", F.lit(1).alias("d")), F.struct(F.col("until").alias("tick"), F.lit(-1).alias("d")))).alias("s")).select("s.*")
    change = step.groupBy("tick").agg(F.sum("d").alias("d"))
    count = running(change, "tick", [], F.col("d"), "before").select("tick", (F.col("before") + F.col("d")).alias("resident"))
    return count.agg(F.max(F.struct("resident", (-F.col("tick")).alias("t"))).alias("m")).select((-F.col("m.t")).alias("tick"), F.col("m.resident").alias("resident"))


def drive_slots(ticks: int, slots: int, nodes: DataFrame, n: int, amplitude: float, seed: int = 0) -> DataFrame:
    """(tick, nid, i): `slots` draws with replacement from ids 0..n-1 in each tick, a node drawn twice gets twice the input; only nodes of `nodes` count."""
    rows = nodes.sparkSession.range(ticks).select(F.col("id").alias("tick"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    drawn = rows.select("tick", below(n, "slot", seed, F.col("tick"), F.col("slot")).alias("nid")).join(nodes.select(F.col("id").alias("nid")), "nid", "left_semi")
    return drawn.groupBy("tick", "nid").agg((F.count("*") * amplitude).alias("i"))


def drive_blocks(nodes: DataFrame, ticks: int, density: float, block: int = 100, seed: int = 0) -> DataFrame:
    """(block, nid): nodes driven in each block; the first and last third of the time share one pattern (A-B-A)."""
    blocks = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((ticks - 1) // block))))
    third = F.least(F.lit(2), F.expr(f"block * {block} * 3 div {ticks}"))
    return blocks.where(uniform("drive", seed, F.when(third == 1, "B").otherwise("A"), F.col("id"), F.expr("block")) < density).select("block", F.col("id").alias("nid"))


def drive_carry(nodes: DataFrame, blocks: int, density: float, seed: int = 0) -> DataFrame:
    """(block, nid): fresh nodes of each block, and half of the fresh ones of the block before."""
    rows = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    fresh = rows.where(uniform("fresh", seed, F.col("id"), F.col("block")) < density)
    carry = fresh.where(uniform("carry", seed, F.col("id"), F.col("block")) < 0.5).withColumn("block", F.col("block") + 1).where(F.col("block") < blocks)
    return fresh.unionAll(carry).select("block", F.col("id").alias("nid")).distinct()


def fan_out(nodes: DataFrame, degree: int, n: int, weight: float = 0.4, spread: float = 0.2, bits: int | None = None, delay_max: int = 4, seed: int = 0) -> DataFrame:
    """(src, k, tgt, weight, delay): each node's synapses, drawn when asked for. Weights in 2**bits levels if bits are given, halves to even."""
    k = nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(degree - 1))))
    u = uniform("weight", seed, F.col("id"), F.col("k"))
    w = F.lit(weight) + F.lit(spread) * (2 * u - 1)
    if bits is not None:
        levels, low = (1 << bits) - 1, weight - spread
        w = F.lit(low) + F.rint((w - low) / (2 * spread) * levels) / levels * (2 * spread)
    return k.select(F.col("id").alias("src"), "k", below(n, "target", seed, F.col("id"), F.col("k")).alias("tgt"), w.alias("weight"), (1 + below(delay_max, "delay", seed, F.col("id"), F.col("k"))).alias("delay"))


def frontier(observations: DataFrame, horizon: int, quiet: int = 15, evict: int = 60, timeout: int = 15) -> DataFrame:
    """(nid, activations, reactivations, abandoned, quieted, evictions, state) of nodes that activate on their second observation.

    With a sweep after every tick, all that happens between two observations follows from
    their gap and from whether the node was active: a gap over evict + 1 evicts an active node
    (it starts anew), one over quiet quiets it, and a candidate gives up after timeout. So a node's
    state is told by its last decisive gap, in one pass in order of tick.
    """
    if timeout > evict + 1:
        raise ValueError("timeout must not exceed evict + 1")
    w = Window.partitionBy("nid").orderBy("tick", "event_id")
    gap = F.col("tick") - F.lag("tick").over(w)
    decisive = F.when(F.col("gap").isNull(), 0).when(F.col("gap") >= evict + 2, 0).when(F.col("gap") <= timeout, 1)
    rows = observations.withColumn("gap", gap).withColumn("set", decisive)
    rows = rows.withColumn("active", F.last("set", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("was", F.lag("active").over(w)).withColumn("next", F.lead("tick").over(w))
    rows = rows.withColumn("rest", F.coalesce("next", F.lit(horizon)) - F.col("tick"))
    last = F.col("next").isNull()
    # a sweep runs at ticks tick, tick + 1, ..., up to the one before the next observation
    idle = F.col("rest") - 1
    return rows.groupBy("nid").agg(
        F.count_if((F.col("active") == 1) & ((F.col("was") == 0) & (F.col("gap") <= timeout))).alias("activations"),
        F.count_if((F.col("was") == 1) & (F.col("gap") > quiet) & (F.col("gap") <= evict + 1)).alias("reactivations"),
        F.count_if((F.col("active") == 0) & (idle >= timeout)).alias("abandoned"),
        F.count_if((F.col("active") == 1) & (idle >= quiet)).alias("quieted"),
        F.count_if((F.col("active") == 1) & (idle >= evict + 1)).alias("evictions"),
        F.max(F.when(last, F.expr(f"case when active = 0 then if(rest - 1 >= {timeout}, 'dormant', 'candidate') when rest - 1 >= {evict + 1} then 'evicted' when rest - 1 >= {evict} then 'evicting' when rest - 1 >= {quiet} then 'quiescent' else 'active' end"))).alias("state"),
    )


def _stays(observations: DataFrame, horizon: int, quiet: int, evict: int, timeout: int) -> DataFrame:
    """(nid, tick, before, after, rest): the state in which each tick with observations finds and leaves a node that activates on its second
    observation, and the ticks until the next such tick, or until the horizon.

    Observations of a node in one tick are counted first, so a node that is seen very often has a row for each tick at most.
    """
    if timeout > evict + 1:
        raise ValueError("timeout must not exceed evict + 1")
    w = Window.partitionBy("nid").orderBy("tick")
    rows = observations.groupBy("nid", "tick").agg(F.count("*").alias("n")).withColumn("gap", F.col("tick") - F.lag("tick").over(w))
    # one observation sets a node that was out to candidate, one soon after it, or two at once, to active; others leave it as it was
    decisive = F.when(F.col("n") > 1, 1).when(F.col("gap").isNull() | (F.col("gap") >= evict + 2), 0).when(F.col("gap") <= timeout, 1)
    rows = rows.withColumn("set", decisive).withColumn("active", F.last("set", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("was", F.lag("active").over(w)).withColumn("rest", F.coalesce(F.lead("tick").over(w), F.lit(horizon)) - F.col("tick"))
    waited = F.expr(f"""case when was is null then 'dormant' when was = 0 then if(gap - 1 >= {timeout}, 'dormant', 'candidate')
        when gap - 1 >= {evict + 1} then 'evicted' when gap - 1 >= {evict} then 'evicting' when gap - 1 >= {quiet} then 'quiescent' else 'active' end""")
    return rows.select("nid", "tick", waited.alias("before"), F.when(F.col("active") == 1, "active").otherwise("candidate").alias("after"), "rest")


def frontier_transitions(observations: DataFrame, horizon: int, quiet: int = 15, evict: int = 60, timeout: int = 15) -> DataFrame:
    """(nid, tick, step, from_state, to_state, cause): every change of state before the horizon, by an observation or by the sweep at the end of a tick.

    step orders the changes of a node in one tick. A gap between two ticks with observations tells which sweeps changed something in it, so gaps become timed rows.
    """
    stays = _stays(observations, horizon, quiet, evict, timeout)
    change = lambda when, tick, step, old, new, cause: F.when(when, F.struct(tick.cast("int").alias("tick"), F.lit(step).alias("step"), old.alias("from_state"), new.alias("to_state"), F.lit(cause).alias("cause")))
    out, lit = F.col("before").isin("dormant", "evicted"), F.lit
    active = F.col("after") == "active"
    after = lambda ticks: F.col("tick") + ticks
    left = lambda ticks: F.col("rest") > ticks
    changes = F.array(
        change(out, F.col("tick"), 0, F.col("before"), lit("candidate"), "observed"),
        change(active & out, F.col("tick"), 1, lit("candidate"), lit("active"), "observed"),
        change(active & ~out & (F.col("before") != "active"), F.col("tick"), 0, F.col("before"), lit("active"), "observed"),
        change(~active & left(timeout), after(timeout), 0, lit("candidate"), lit("dormant"), "swept"),
        change(active & left(quiet), after(quiet), 0, lit("active"), lit("quiescent"), "swept"),
        change(active & left(evict), after(evict), 0, lit("quiescent"), lit("evicting"), "swept"),
        change(active & left(evict + 1), after(evict + 1), 0, lit("evicting"), lit("evicted"), "swept"),
    )
    return stays.select("nid", F.explode(F.array_compact(changes)).alias("c")).select("nid", "c.*")


def frontier_residency(observations: DataFrame, horizon: int, quiet: int = 15, evict: int = 60, timeout: int = 15) -> DataFrame:
    """(nid, resident_ticks, eviction_requests): ends of ticks at which a node held resident state, and how often it was to be evicted."""
    stays = _stays(observations, horizon, quiet, evict, timeout)
    active = F.col("after") == "active"
    held = F.when(active, F.least(F.col("rest"), F.lit(evict + 2))).otherwise(0)  # the sweep that evicts it still finds it resident
    return stays.groupBy("nid").agg(F.sum(held).cast("long").alias("resident_ticks"), F.count_if(active & (F.col("rest") > evict)).alias("eviction_requests"))


def stalest(observations: DataFrame, budget: int) -> DataFrame:
    """(day, nid, last): of the nodes seen in each day of 24 ticks, those that a budget of resident
    nodes turns out at its end: the longest idle first, ties to the smaller id."""
    seen = observations.groupBy("nid", F.expr("tick div 24").alias("day")).agg(F.max("tick").alias("last"))
    rank = places(seen.withColumn("_order", -F.col("last")).withColumn("_id", -F.col("nid")), ["day"], ["_order", "_id"], "rank")
    return rank.where(F.col("rank") >= budget).select("day", "nid", "last")
