"""Residency of nodes and a queue of events as streams with event-time timers.

A tick is a second of event time, so a watermark is a tick too. What belongs to a tick is taken up in the first micro-batch whose
watermark has reached it; events that come in later batches than that are dropped, and the progress of the query counts them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The states of a node, in the order of a life.
DORMANT, CANDIDATE, ACTIVE, QUIESCENT, EVICTING, EVICTED = "dormant", "candidate", "active", "quiescent", "evicting", "evicted"
TRANSITION = "nid long, tick int, step int, from_state string, to_state string, cause string"
QUEUED = "tick int, part long, place int, event_id long, nid long"
_Change, _Queued = (Row(*(c.split()[0] for c in schema.split(", "))) for schema in (TRANSITION, QUEUED))


#: The second of event time of tick 0; Spark's watermark begins at 0 and takes all before it as late.
ZERO = 1_000_000_000


def _ms(tick: int) -> int:
    return (ZERO + tick) * 1000


class Rules(NamedTuple):
    """Observations that make a candidate active, and ticks without one until an active node is quiet, is to be evicted, and a candidate gives up."""

    activate: int = 2
    quiet: int = 15
    evict: int = 60
    timeout: int = 15

    def checked(self) -> Rules:
        if self.activate < 2:
            raise ValueError("a node needs two observations at least to become active")
        if min(self.quiet, self.evict, self.timeout) < 1 or self.evict <= self.quiet:
            raise ValueError("waiting times must be positive, and evicting must take longer than falling quiet")
        return self


class Node:
    """One node: its state, observations as a candidate, the first of them, and the last tick at which it was seen."""

    def __init__(self, state: str = DORMANT, seen: int = 0, first: int = 0, last: int = 0) -> None:
        self.state, self.seen, self.first, self.last = state, seen, first, last

    def _to(self, state: str, tick: int, step: int, cause: str) -> tuple:
        old, self.state = self.state, state
        return tick, step, old, state, cause

    def due(self, rules: Rules) -> int | None:
        """The tick at whose end the next change by time comes, if nothing is seen before."""
        wait = {CANDIDATE: self.first + rules.timeout, ACTIVE: self.last + rules.quiet, QUIESCENT: self.last + rules.evict, EVICTING: self.last + rules.evict + 1}
        return wait.get(self.state)

    def idle(self, upto: int, rules: Rules) -> Iterator[tuple]:
        """What the ends of all ticks up to and with `upto` change."""
        after = {CANDIDATE: DORMANT, ACTIVE: QUIESCENT, QUIESCENT: EVICTING, EVICTING: EVICTED}
        while (tick := self.due(rules)) is not None and tick <= upto:
            yield self._to(after[self.state], tick, 0, "swept")
            if self.state == EVICTED:
                self.state = DORMANT  # nothing of it is kept

    def seen_at(self, tick: int, times: int, rules: Rules) -> Iterator[tuple]:
        """What the observations of one tick change."""
        self.last = max(self.last, tick)
        step = 0
        if self.state == DORMANT:
            self.seen, self.first, self.last = 0, tick, tick
            yield self._to(CANDIDATE, tick, step, "observed")
            step = 1
        if self.state == CANDIDATE:
            self.seen += times
            if self.seen >= rules.activate:
                yield self._to(ACTIVE, tick, step, "observed")
        elif self.state != ACTIVE:
            yield self._to(ACTIVE, tick, step, "observed")


class Residency(StatefulProcessor):
    """Counts of observations of a node by tick, each final, to its transitions. A dormant or evicted node has no state and no timer."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("node", "state string, seen int, first int, last int, timer long")

    def _load(self) -> tuple[Node, int]:
        if not self.kept.exists():
            return Node(), 0
        *node, timer = self.kept.get()
        return Node(*node), timer

    def _save(self, node: Node, timer: int) -> None:
        """Keeps one timer for the next change, or forgets the node."""
        due = node.due(self.rules)
        wanted = 0 if due is None else _ms(due)
        if timer and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted and timer != wanted:
            self.handle.registerTimer(wanted)
        if due is None:
            self.kept.clear()
        else:
            self.kept.update((node.state, node.seen, node.first, node.last, wanted))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        node, timer = self._load()
        for tick, n in sorted((r["tick"], r["n"]) for r in rows):
            for change in (*node.idle(tick - 1, self.rules), *node.seen_at(tick, n, self.rules)):
                yield _Change(key[0], *change)
        self._save(node, timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        node, _ = self._load()
        for change in node.idle(timerValues.getCurrentWatermarkInMs() // 1000 - ZERO, self.rules):
            yield _Change(key[0], *change)
        self._save(node, 0)

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, late: int) -> DataFrame:
    return rows.withColumn("at", F.timestamp_seconds(F.col("tick") + ZERO)).withWatermark("at", f"{late} seconds")


def transition_stream(seen: DataFrame, rules: Rules = Rules(), late: int = 0) -> DataFrame:  # noqa: B008
    """Transitions of nodes (nid, tick, step, from_state, to_state, cause) from a stream of (nid, tick) whose ticks are at most `late` out of order.

    Observations are first counted by node and tick, in parts before the shuffle, so that a node seen very often moves as few rows; a
    count comes out when the watermark has passed its tick. step orders what happens to a node in one tick. An evicted node is
    forgotten like a dormant one, and so begins anew from dormant. Needs the RocksDB state store.
    """
    rules.checked()
    each = _timed(seen.select("nid", F.col("tick").cast("int").alias("tick")), late).groupBy("nid", "tick", "at").agg(F.count("*").cast("int").alias("n"))
    return each.groupBy("nid").transformWithState(Residency(rules), TRANSITION, "Append", "EventTime")


def frontier_counts(transitions: DataFrame) -> DataFrame:
    """(nid, activations, reactivations, abandoned, quieted, evictions, state) from transitions: how often each happened, and the last state."""
    moved = lambda old, new: F.count_if(F.col("from_state").isin(*old) & (F.col("to_state") == new))
    return transitions.groupBy("nid").agg(
        moved([CANDIDATE], ACTIVE).alias("activations"),
        moved([QUIESCENT, EVICTING], ACTIVE).alias("reactivations"),
        moved([CANDIDATE], DORMANT).alias("abandoned"),
        moved([ACTIVE], QUIESCENT).alias("quieted"),
        moved([EVICTING], EVICTED).alias("evictions"),
        F.max_by("to_state", F.struct("tick", "step")).alias("state"),
    )


class Buffer(StatefulProcessor):
    """Events of one tick and range of ids, held until the watermark reaches the tick, then given out in order of id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("events", "event_id long, nid long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.held.exists():
            self.handle.registerTimer(_ms(key[0]))
        self.held.appendList([(r["event_id"], r["nid"]) for r in rows])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for place, (event, node) in enumerate(sorted(self.held.get(), key=lambda e: e[0])):
            yield _Queued(key[0], key[1], place, event, node)
        self.held.clear()

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, late: int = 0, width: int = 1 << 16) -> DataFrame:
    """(tick, part, place, event_id, nid) of a stream of (tick, nid, event_id): a tick's events come out together, when the watermark reaches it.

    A tick is held in parts of `width` event ids, so no key holds more than that; `numbered` joins them to one order.
    """
    keyed = _timed(events.select("tick", "nid", "event_id", F.expr(f"event_id div {width}").alias("part")), late)
    return keyed.groupBy("tick", "part").transformWithState(Buffer(), QUEUED, "Append", "EventTime")


def numbered(released: DataFrame) -> DataFrame:
    """(tick, seq, event_id, nid): what queue_stream gave out for whole ticks, first in first out from 1 in each tick."""
    parts = released.groupBy("tick", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tick").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("tick", "part", before.alias("start"))  # a row for each part of a tick
    return released.join(starts, ["tick", "part"]).select("tick", (F.col("start") + F.col("place") + 1).cast("int").alias("seq"), "event_id", "nid")
