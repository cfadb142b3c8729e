"""Registered queries over the driver's tables, with the DuckDB SQL that each is held against."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshgrain.functions import scalars, surface
from meshgrain.functions.draws import keyed_target, keyed_uniform
from meshgrain.functions.draws import virtual_ids as virtual_ids_of
from meshgrain.operators import census, dynamics, generate, structure, sweeps, trains
from meshgrain.operators.ranks import dense_ids
from meshgrain.plans.oracles import ORACLES
from meshgrain.sources import edge_files, records, sinks
from meshgrain.sources.byte_ranges import ByteRanges
from meshgrain.sources.graph_views import HOURS, edge_rows, graph, hour, raw_edges, spikes, table, users
from meshgrain.sources.stored import own_folder
from meshgrain.streaming import replay, residency

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def triad_census(s, d):
    return census.triad_census(graph(s, d), users(s, d))


@query
def census_sources_only(s, d):
    """Over contacts of one transmitter: users without such a contact of their own leave the universe, and edges to them go."""
    one = edge_files.cleaned(raw_edges(s, d)).where("nt = 255")
    return census.triad_census(one.select(F.col("pre").alias("src"), F.col("post").alias("tgt")))


@query
def motif_query_top(s, d):
    all_ = census.triad_census(graph(s, d), users(s, d))
    return all_.where("n_edges >= 3 and n_mutual >= 1").orderBy(F.desc("count"), "code").limit(5).select("code", "count", "n_edges", "n_mutual", "cyclic")


@query
def census_part_supplier(s, d):
    """A sparse, skewed graph: parts to suppliers, whose numbers stand apart."""
    pairs = table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("tgt")).distinct()
    nodes = pairs.select(F.explode(F.array("src", "tgt")).alias("id")).distinct()
    return census.triad_census(pairs, nodes).select("code", "count")


@query
def edge_scan_filter(s, d):
    return edge_files.cleaned(raw_edges(s, d)).select("pre", "post", "nt", "event_id")


@query
def edge_dedupe_weighted(s, d):
    return edge_files.weighted(edge_files.cleaned(raw_edges(s, d), known_only=True), 0.5)


@query
def edge_normalize_counts(s, d):
    return edge_files.normalised(edge_rows(s, d)).groupBy("neurotransmitter", F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("problem").isNull(), F.col("synapses"))).alias("synapses"))


@query
def nt_distribution(s, d):
    n = raw_edges(s, d).groupBy(edge_files.nt_name(F.col("nt")).alias("nt")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("nt", "n", (F.col("n") / F.col("total")).alias("share"))


@query
def nt_argmax(s, d):
    p = F.array(*(F.when(F.pmod(F.col("event_id") * (k + 3), F.lit(19)) == 0, None).otherwise(F.pmod(F.col("event_id") * (k + 3), F.lit(17)) / 16.0) for k in range(6)))
    code, conf = edge_files.argmax_code(p, F.col("event_id") % 29 != 0)
    return table(s, d, "events").select("event_id", code.alias("nt"), conf.alias("conf"))


@query
def confidence_stats(s, d):
    return raw_edges(s, d).agg(F.count("*").alias("n"), F.count("conf").alias("known"), F.min("pre").alias("lo"), F.max("pre").alias("hi"), F.round(F.avg("conf"), 9).alias("mean_conf"), F.round(F.min("conf"), 12).alias("least_conf"))


@query
def compact_ids(s, d):
    e = edge_files.cleaned(raw_edges(s, d))
    return dense_ids(e.select(F.explode(F.array("pre", "post")).alias("id")), "id", "compact")


@query
def compact_part_ids(s, d):
    return dense_ids(table(s, d, "lineitem").select((F.col("l_partkey") * 1_000_003 + F.col("l_suppkey")).alias("id")), "id", "compact")


@query
def connectome_stats(s, d):
    e = edge_files.cleaned(raw_edges(s, d))
    one = e.agg(F.count("*").alias("n_rows"), F.countDistinct("pre").alias("sources"), F.countDistinct("pre", "post").alias("edges"))
    nodes = e.select(F.explode(F.array("pre", "post")).alias("id")).agg(F.countDistinct("id").alias("nodes"))
    return one.join(F.broadcast(nodes)).withColumn("collapsed", F.col("n_rows") - F.col("edges"))


@query
def degree_stats(s, d):
    return structure.degree_stats(users(s, d), graph(s, d))


@query
def degrees(s, d):
    return structure.degrees(users(s, d), graph(s, d))


@query
def structure_report(s, d):
    return structure.structure_report(users(s, d), graph(s, d))


@query
def locality_ratio(s, d):
    return structure.locality_ratio(graph(s, d))


@query
def node_subset(s, d):
    g = graph(s, d)
    return structure.among(g, structure.top_nodes(users(s, d), g, 40))


@query
def assign_roles(s, d):
    """Orders to parts to suppliers, their numbers set apart: sources, relays and sinks."""
    line = table(s, d, "lineitem")
    part, supplier = F.col("l_partkey") + 10**12, F.col("l_suppkey") + 2 * 10**12
    edges = line.select(F.explode(F.array(F.struct(F.col("l_orderkey").alias("src"), part.alias("tgt")), F.struct(part.alias("src"), supplier.alias("tgt")))).alias("e")).select("e.*").distinct()
    return structure.roles(edges.select(F.explode(F.array("src", "tgt")).alias("id")).distinct(), edges)


@query
def control_hub_removed(s, d):
    return structure.hub_removed(users(s, d), graph(s, d))


@query
def control_short_span(s, d):
    return structure.short_span(graph(s, d))


@query
def id_gap_stats(s, d):
    return structure.id_gaps(table(s, d, "lineitem").select((F.col("l_orderkey") * 7 + F.col("l_partkey")).alias("id")))


@query
def resume_anti_join(s, d):
    done = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("id")).join(done, "id", "left_anti")


def _weighted(s, d) -> DataFrame:
    """Weights in quarters, so that their mean is the same in any order of adding."""
    return graph(s, d).withColumn("weight", (1 + (F.col("src") + F.col("tgt")) % 4) / 4.0)


def _n(s, d) -> int:
    return users(s, d).agg(F.max("id")).first()[0] + 1


@query
def gen_replication(s, d):
    return generate.replication(_weighted(s, d), _n(s, d), 3)


@query
def gen_replication_cross(s, d):
    return generate.replication(_weighted(s, d), _n(s, d), 3, 0.01, seed=7)


@query
def gen_duplication(s, d):
    return generate.duplication(_weighted(s, d), _n(s, d), seed=3)


@query
def gen_modular(s, d):
    return generate.modular(_weighted(s, d), _n(s, d), 4, 2)


@query
def gen_modular_inter(s, d):
    return generate.modular(_weighted(s, d), _n(s, d), 4, 2, 0.02, seed=5)


@query
def gen_population(s, d):
    return generate.population(_weighted(s, d), _n(s, d), 3, seed=6)


@query
def gen_hybrid(s, d):
    return generate.hybrid(_weighted(s, d), _n(s, d), 4, 2, seed=2)


@query
def gen_gnp(s, d):
    return generate.gnp(users(s, d), _n(s, d), 0.05, seed=1)


@query
def gen_planted(s, d):
    return generate.planted(users(s, d), _n(s, d), 4, 0.08, 0.005, seed=1)


@query
def gen_spatial(s, d):
    """Points are the first two components of vectors."""
    points = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    n = points.count()
    return generate.spatial(points, n, 0.05, 8 * n, seed=6, source=_weighted(s, d))


@query
def gen_motif_fill(s, d):
    return generate.motif_fill(users(s, d), _n(s, d), 27, 0.01, seed=8)


@query
def gen_gnp_certain(s, d):
    """With probability 1 every pair is there."""
    return generate.gnp(users(s, d), _n(s, d), 1.0).groupBy("src").agg(F.count("*").alias("n"), F.sum("tgt").alias("total"))


@query
def motif_instantiate(s, d):
    return generate.stamped(users(s, d), 27)


@query
def gen_random_control(s, d):
    return generate.random_control(_weighted(s, d), seed=4)


@query
def control_uniform(s, d):
    return generate.uniform_targets(graph(s, d), _n(s, d), seed=4)


@query
def control_motif_destroyed(s, d):
    return generate.motif_destroyed(graph(s, d), users(s, d), seed=4)


@query
def control_gapped_spans(s, d):
    """The same over ids with gaps: parts in steps of 3 to suppliers in steps of 50."""
    pairs = table(s, d, "lineitem").select((F.col("l_partkey") * 3).alias("src"), (F.col("l_suppkey") * 50).alias("tgt")).distinct()
    return generate.motif_destroyed(pairs, pairs.select(F.explode(F.array("src", "tgt")).alias("id")), seed=4)


@query
def spike_counts(s, d):
    return trains.counts(spikes(s, d), users(s, d), HOURS)


@query
def rate_histogram(s, d):
    return trains.tick_histogram(spikes(s, d), HOURS)


@query
def graph_health(s, d):
    h = trains.health(spikes(s, d), users(s, d), HOURS)
    return h.select("check", F.round("value", 9).alias("value"), "threshold", "passed")


@query
def fidelity(s, d):
    """Trains without error events against all."""
    all_ = spikes(s, d)
    return trains.fidelity(all_, all_.where("kind <> 'error'"), users(s, d), HOURS)


@query
def fidelity_shifted(s, d):
    all_ = spikes(s, d)
    return trains.fidelity(all_, all_.withColumn("tick", F.col("tick") + 5), users(s, d), HOURS)


DAYS = 2500


def _orders(s, d) -> DataFrame:
    """(nid, tick, kind): an order of a customer on a day, by its status."""
    return table(s, d, "orders").select(F.col("o_custkey").alias("nid"), F.expr("cast(datediff(o_orderdate, date'1995-01-01') as int)").alias("tick"), F.col("o_orderstatus").alias("kind"))


@query
def graph_health_sparse(s, d):
    """Finished orders of all customers, of whom not every one has any: the warning comes too."""
    h = trains.health(_orders(s, d).where("kind = 'F'"), table(s, d, "customer").select(F.col("c_custkey").alias("id")), DAYS, active_min=0.999)
    return h.select("check", F.round("value", 9).alias("value"), "threshold", "passed")


@query
def sweep_knee(s, d):
    """All events as the real condition, each kind of event as a control."""
    each = spikes(s, d).select(F.explode(F.array(F.lit("real"), F.col("kind"))).alias("condition"), "nid")
    return sweeps.knee(sweeps.budget_points(each))


@query
def train_key_gaps(s, d):
    """Customers with finished orders and customers with pending ones."""
    all_ = _orders(s, d)
    return trains.key_gaps(all_.where("kind = 'F'"), all_.where("kind = 'P'"))


@query
def queue_drain(s, d):
    return dynamics.drained(dynamics.queue_order(spikes(s, d)), 100).select("tick", "seq", "event_id")


@query
def queue_next(s, d):
    return dynamics.queue_head(dynamics.queue_order(spikes(s, d)), 100)


@query
def peak_resident(s, d):
    return dynamics.peak_resident(spikes(s, d), 15)


@query
def drive_slots(s, d):
    return dynamics.drive_slots(HOURS, 40, users(s, d), 2 * _n(s, d), 0.5, seed=5)


@query
def closed_form(s, d):
    v = scalars.closed_form_voltage(F.col("value") / 100, F.col("user_id") % 7, F.col("event_id") % 50, 0.9950124791926823)
    finite = scalars.is_finite(F.when(F.col("event_id") % 10 == 0, float("inf")).when(F.col("event_id") % 10 == 1, float("nan")).when(F.col("event_id") % 10 != 2, F.col("value")))
    return table(s, d, "events").select("event_id", F.round(v, 9).alias("v"), scalars.ms_to_tick(F.round("value", 1)).alias("tick"), finite.alias("finite"))


@query
def readable_numbers(s, d):
    o = table(s, d, "orders")
    cents = F.floor(F.col("o_totalprice") * 100).cast("long")
    size = F.element_at(F.array(*(F.lit(1024**k) for k in range(5))), (F.col("o_orderkey") % 5 + 1).cast("int")) * (F.col("o_custkey") % 3000)
    seconds = (F.col("o_orderkey") % 997) * F.element_at(F.array(*map(F.lit, (1e-7, 1e-4, 0.03, 4.0))), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", scalars.fmt_count(cents).alias("amount"), scalars.fmt_bytes(size).alias("size"), scalars.fmt_seconds(seconds).alias("took"), scalars.iso_second(F.col("o_orderdate")).alias("at"))


@query
def plain_texts(s, d):
    t = F.coalesce("text", F.lit(""))
    return table(s, d, "documents").select("doc_id", F.md5(scalars.ascii_text(t)).alias("ascii"), F.md5(scalars.html_escape(t)).alias("html"))


@query
def retry_hints(s, d):
    """Waiting times named in messages as a server sends them."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.format_string("429: {'Retry-After': '%d'}", "user_id")).when(k == 1, F.format_string("429 Client Error: Too Many Requests: %d", "user_id")).when(k == 2, F.format_string("retry-after=%d s", "user_id")).otherwise("timed out")
    return table(s, d, "events").select("event_id", scalars.retry_after(text).alias("seconds"))


@query
def learned_updates(s, d):
    """Counts by kind as a map of each user: of the first half of the time, then updated by the second."""
    c = spikes(s, d).withColumn("late", F.col("tick") >= HOURS // 2).groupBy("nid", "late", "kind").agg(F.count("*").alias("n"))
    m = lambda late: F.map_from_entries(F.collect_list(F.when(F.col("late") == late, F.struct("kind", "n"))))
    both = c.groupBy("nid").agg(m(False).alias("old"), m(True).alias("new")).withColumn("now", scalars.map_update(F.col("old"), F.col("new")))
    return both.select("nid", *(scalars.map_get(F.col("now"), k, F.lit(0)).alias(k) for k in ("click", "error", "purchase", "signup", "view")), F.size("now").alias("kinds"))


@query
def virtual_ids(s, d):
    """64-bit ids of orders."""
    o = table(s, d, "orders")
    return o.select("o_orderkey", virtual_ids_of(F.lit(3), F.col("o_custkey"), F.lit(0), F.col("o_orderkey"), 42).alias("id"))


@query
def drive_blocks(s, d):
    return dynamics.drive_blocks(users(s, d), 1500, 0.4, seed=1)


@query
def drive_hot_carry(s, d):
    return dynamics.drive_carry(users(s, d), 8, 0.2, seed=1)


@query
def fan_out(s, d):
    return dynamics.fan_out(users(s, d), 8, _n(s, d), seed=9)


@query
def weight_quantize(s, d):
    return dynamics.fan_out(users(s, d), 8, _n(s, d), bits=2, seed=9).select("src", "k", F.round("weight", 9).alias("weight"))


@query
def keyed_draws(s, d):
    """64-bit keyed hashes of (user, salt), folded."""
    k = users(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return k.select("id", "k", keyed_target(F.col("id"), F.col("k"), 256, 9, 0xD21E).alias("tgt"), keyed_uniform(F.col("id"), F.col("k"), 9, 0xD21E).alias("u"))


@query
def sql_fan_out(s, d):
    """Synapses by the table function, in SQL text alone."""
    surface.register(s)
    users(s, d).createOrReplaceTempView("fan_out_nodes")
    return s.sql(f"SELECT src, k, tgt, weight FROM fan_out(TABLE(SELECT id FROM fan_out_nodes) PARTITION BY (id), 8, 256, 9, {0xD21E}, 0, 0.4D, 0.2D)")


@query
def sql_virtual_ids(s, d):
    """Ids, targets and draws of orders by the SQL functions."""
    surface.register(s)
    table(s, d, "orders").createOrReplaceTempView("id_orders")
    return s.sql("SELECT o_orderkey, virtual_id(7, o_custkey, 1, 0, o_orderkey) AS id, keyed_target(o_custkey, o_orderkey, 1000, 7, 5, 1) AS tgt, keyed_uniform(o_custkey, o_orderkey, 7, 5, 1) AS u FROM id_orders")


@query
def byte_range_edges(s, d):
    """The edge list as text files, read back by byte ranges and decoded."""
    folder = own_folder(s, "edges")
    edge_rows(s, d).write.csv(folder, emptyValue="", nullValue="")
    s.dataSource.register(ByteRanges)
    lines = s.read.format("byte_ranges").option("url", folder).option("chunk_bytes", 1 << 18).load()
    part = F.split("line", ",", 4)
    rows = lines.select(*(part[i].alias(c) for i, c in enumerate(edge_files.CSV_SCHEMA.names)))
    return edge_files.normalised(rows).groupBy("neurotransmitter", F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("problem").isNull(), F.col("synapses"))).alias("synapses"))


@query
def corpus_chunks(s, d):
    """Contacts written as chunk files and loaded again: rows, distinct edges and neurons of the dataset, and the digests' and the manifest's counts."""
    folder = own_folder(s, "corpus")
    contacts = raw_edges(s, d).select("pre", "post", F.col("nt").cast("short").alias("nt"), F.col("conf").cast("float").alias("conf"))
    sinks.write_chunks(contacts, folder, 2000)
    chunks = records.load_contacts(s, folder, "part-*.parquet")
    _, seen = records.load_dataset(chunks)
    manifest = json.loads(sinks.manifest(chunks, "contacts", checks={"unknown": "nt = 255"}))
    files = sinks.file_digests(s, folder).join(edge_files.describe(s, folder).withColumnRenamed("file_name", "file"), "file")
    one = files.agg(F.sum("rows").alias("described"), F.count_if(F.length("sha256") == 64).alias("digests"), F.count("*").alias("files"))
    return one.select(F.lit(manifest["rows"]).cast("long").alias("manifest_rows"), F.lit(manifest["counts"]["unknown"]).cast("long").alias("unknown"), *(F.lit(seen[c]).cast("long").alias(c) for c in ("rows_seen", "distinct", "neurons")), "described", (F.col("digests") == F.col("files")).alias("all_digested"))


@query
def graph_file(s, d):
    """A grown graph written as JSON lines with what it was made from, read back."""
    folder = own_folder(s, "graph")
    records.write_graph(generate.replication(_weighted(s, d), _n(s, d), 2), folder, {"name": "replication", "times": 2})
    return s.read.schema("src long, tgt long, weight double").json(f"{folder}/edges")


@query
def lif_fold(s, d):
    inputs = dynamics.currents(spikes(s, d), HOURS, 24.0)
    return dynamics.integrate(inputs, users(s, d), HOURS).select("nid", "n_spikes", F.round("v", 9).alias("v"))


@query
def event_order(s, d):
    return dynamics.queue_order(spikes(s, d)).select("tick", "nid", "event_id", "seq")


@query
def event_delivery(s, d):
    return dynamics.delivered(spikes(s, d), graph(s, d), 2, HOURS)


@query
def frontier_fold(s, d):
    return dynamics.frontier(spikes(s, d), HOURS)


@query
def frontier_states(s, d):
    return dynamics.frontier(spikes(s, d), HOURS).groupBy("state").agg(F.count("*").alias("n"), F.sum("evictions").alias("evictions"))


@query
def budget_evict(s, d):
    return dynamics.stalest(spikes(s, d), 20)


@query
def stream_window_counts(s, d):
    return replay.run_to_table(replay.window_counts(replay.stream(s, d, "events")), "complete", ["start", "event_type"])


@query
def frontier_transitions(s, d):
    return dynamics.frontier_transitions(spikes(s, d), HOURS)


@query
def frontier_residency(s, d):
    return dynamics.frontier_residency(spikes(s, d), HOURS)


#: Micro-batches in which a table is replayed, and ticks by which rows may come late: the ticks of one slice.
SLICES = 5
LATE = HOURS // SLICES


@query
def stream_frontier(s, d):
    """The same life of every user from a stream of observations with timers, up to the last hour."""
    seen = replay.arrivals(spikes(s, d).select("nid", "tick"), SLICES, HOURS - 1 + LATE)
    return residency.frontier_counts(replay.run_to_table(residency.transition_stream(seen, late=LATE), "append", []))


@query
def stream_queue(s, d):
    """Events given out tick by tick, in order of arrival inside each, from a stream that brings them in drawn order."""
    events = replay.arrivals(spikes(s, d).select("tick", "nid", "event_id"), SLICES, HOURS - 1 + LATE)
    return residency.numbered(replay.run_to_table(residency.queue_stream(events, LATE), "append", []))
