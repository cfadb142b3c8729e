import json
import math

import pytest
from pyspark.sql import functions as F

from meshgrain.functions import scalars
from meshgrain.functions.draws import virtual_ids
from meshgrain.operators import dynamics, sweeps, trains
from meshgrain.sources import records
from meshgrain.sources.byte_ranges import _asked
from tests.compare import plain_hash


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_scalars(spark):
    r = one(
        spark,
        v=scalars.closed_form_voltage(F.lit(0.25), F.lit(3.0), F.lit(60), math.exp(-0.1 / 20)),
        ticks=F.array(*(scalars.ms_to_tick(F.lit(x)) for x in (0.0, 0.25, 0.31, 7.96))),
        finite=F.array(*(scalars.is_finite(F.lit(x).cast("double")) for x in (1.5, float("nan"), float("inf"), None))),
        sizes=F.array(*(scalars.fmt_bytes(F.lit(x)) for x in (0, 1023, 1280, 5 * 1024**2, 3 * 1024**3, 7 * 1024**5))),
        times=F.array(*(scalars.fmt_seconds(F.lit(x)) for x in (5e-6, 0.0321, 4.5, 61.04, 3599.0))),
        plain=scalars.ascii_text(F.lit("a — b → µ ✓ é")),
        escaped=scalars.html_escape(F.lit("<a href='x'>\"&\"</a>")),
        old=scalars.map_get(F.create_map(F.lit("a"), F.lit(1)), "b", F.lit(7)),
        both=scalars.map_update(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(5))),
    )
    v = 0.25
    for _ in range(60):
        v = 3.0 + (v - 3.0) * math.exp(-0.1 / 20)
    assert r["v"] == pytest.approx(v) and r["ticks"] == [0, 2, 3, 80] and r["finite"] == [True, False, False, False]
    assert r["sizes"] == ["0 B", "1023 B", "1.2 KiB", "5.0 MiB", "3.0 GiB", "7168.0 TiB"]
    assert r["times"] == ["5 us", "32.1 ms", "4.50 s", "1m 01.0s", "59m 59.0s"]
    assert r["plain"] == "a -- b -> u OK ?" and r["escaped"] == "&lt;a href=&#x27;x&#x27;&gt;&quot;&amp;&quot;&lt;/a&gt;"
    assert r["old"] == 7 and r["both"] == {"a": 1, "b": 5}


def test_virtual_ids_as_a_column(spark):
    rows = spark.range(5).select("id", virtual_ids(F.lit(1), F.lit(2), F.lit(3), F.col("id"), 42).alias("v")).collect()
    assert [int(r["v"]) for r in rows] == [plain_hash("QQQQQ", 42, 1, 2, 3, i) for i in range(5)]


def test_corpus_loader(spark, tmp_path):
    with pytest.raises(records.NoChunks):
        records.chunk_files(spark, str(tmp_path))
    rows = [(1, 2, 0, 0.9), (1, 2, 0, 0.5), (0, 2, 1, 0.9), (2, 2, 1, 0.9), (2, 3, 1, None), (3, 1, 255, 0.01)]
    for i in range(3):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], records.CHUNK_SCHEMA).coalesce(1).toPandas().astype({"nt": "int16", "conf": "float32"}).to_parquet(tmp_path / f"chunk-{i}.parquet")
    assert [p.rsplit("/", 1)[1] for p in records.chunk_files(spark, str(tmp_path), limit=2)] == ["chunk-0.parquet", "chunk-1.parquet"]
    assert records.load_contacts(spark, str(tmp_path), limit=1).count() == 2
    contacts = records.load_contacts(spark, str(tmp_path))
    assert records.successors(contacts).count() == 5
    edges, seen = records.load_dataset(contacts)
    assert seen == {"rows_seen": 6, "distinct": 2, "neurons": 3}
    assert {(r["pre"], r["post"], r["weight"]) for r in edges.collect()} == {(1, 2, -1.0), (2, 3, 1.0)}


def test_configuration_errors_come_together():
    good = {"experiment": {"id": "e"}, "network": {}, "neuron": {"dt_ms": 0.1}, "runtime": {"active_neuron_budget": 5}}
    records.validate_config(good)
    assert records.config_hash(good) == records.config_hash(dict(reversed(good.items()))) != records.config_hash(good | {"x": 1})
    with pytest.raises(ValueError) as e:
        records.validate_config({"neuron": {"dt_ms": -1}, "runtime": {"gpu_memory_budget_mb": True}})
    assert all(x in str(e.value) for x in ("5 faults", "`experiment` is not there", "`network` is not there", "`experiment.id` is not there", "dt_ms` has to be a number above 0, but is -1", "gpu_memory_budget_mb` has to be a whole"))
    assert records.faults({"experiment": {"id": 1}, "network": {}, "neuron": {"dt_ms": "x"}, "runtime": []}) == ["`runtime` has to be a mapping, but is []", "`neuron.dt_ms` has to be a number above 0, but is 'x'"]
    with pytest.raises(TypeError):
        records.validate_config([])


#: A run record as an experiment writes it: scores nested under `fidelity`, none for the condition that others are held against.
RECORD = {
    "experiment_id": "e1", "run_id": "0011-9", "created": "2024-01-01T00:00:00", "seed": 9, "config_hash": "00112233", "observation": "seen",
    "spec": {"n_neurons": 20, "ticks": 100},
    "conditions": [
        {"condition": "dense", "total_spikes": 50, "events_delivered": 400, "peak_resident": 20, "materializations": 0, "evictions": 0, "wall_seconds": 1.5, "stored_synapses": 80, "resident_synapses": 80, "fidelity": None, "health_ok": True, "health_failures": []},
        {"condition": "lazy", "total_spikes": 48, "events_delivered": 390, "peak_resident": 5, "materializations": 31, "evictions": 26, "wall_seconds": 2.5, "stored_synapses": 80, "resident_synapses": 32,
         "fidelity": {"rate_ratio": 0.96, "count_correlation": 0.99, "binned_cosine": 0.98, "max_count_diff": 2, "passed": {"rate": True, "cosine": False}, "overall_pass": False}, "health_ok": False, "health_failures": ["too <quiet>"]},
        {"condition": "none"},
    ],
}


def test_run_records(spark, tmp_path):
    record = records.build_record({"x": 1}, 9, RECORD["conditions"], spec={"n_neurons": 20})
    assert record["run_id"] == record["config_hash"][:8] + "-9" and "0.9600" in record["observation"]
    assert "none scored" in records.build_record({}, 1, [{"condition": "a"}])["observation"]
    records.write_record(spark, RECORD, str(tmp_path / "run"))
    rows = {r["condition"]: r for r in records.read_conditions(spark, str(tmp_path / "run")).collect()}
    lazy, dense, none = rows["lazy"], rows["dense"], rows["none"]
    assert (lazy["rate_ratio"], lazy["count_correlation"], lazy["binned_cosine"], lazy["max_count_diff"], lazy["gate_pass"]) == (0.96, 0.99, 0.98, 2, False)
    assert (lazy["materializations"], lazy["wall_seconds"], lazy["health_ok"], lazy["resident_fraction"], lazy["compression_ratio"]) == (31, 2.5, False, 0.25, 2.5)
    assert dense["rate_ratio"] is None and dense["gate_pass"] is None and dense["compression_ratio"] == 1.0
    assert (none["peak_resident"], none["wall_seconds"], none["compression_ratio"], none["health_ok"]) == (0, 0.0, float("inf"), None)
    page = records.run_report(spark, str(tmp_path / "run"))
    assert "too &lt;quiet&gt;" in page and page.count("<table>") == 3 and "00112233" in page and "http" not in page
    assert records.html_table(spark.createDataFrame([("<b>", None)], "x string, y string"), "t & u").count("&lt;b&gt;") == 1


def test_configuration_files(spark, tmp_path):
    good = {"experiment": {"id": "e"}, "network": {}, "neuron": {"dt_ms": 0.1}, "runtime": {"active_neuron_budget": 5}}
    (tmp_path / "c.json").write_text(json.dumps(good, indent=1))
    assert records.load_config(spark, str(tmp_path / "c.json")) == good
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        records.load_config(spark, str(tmp_path / "bad.json"))


@pytest.mark.parametrize("text, seconds", [("429: {'Retry-After': '12'}", 12.0), ("retry-after=7 s", 7.0), ('"RETRY-AFTER" : 3', 3.0), ("429 Client Error: Too Many Requests: 30", 30.0), ("Too Many Requests", None), ("timed out after 9", None), (None, None)])
def test_waiting_times_in_messages(spark, text, seconds):
    assert one(spark, s=scalars.retry_after(F.lit(text).cast("string")))["s"] == seconds


def test_sweep_and_knee(spark, tmp_path):
    points = [("real", 1.0, 0.9, True), ("real", 0.5, 0.4, True), ("real", 0.25, 0.2, False), ("shuffled", 1.0, 0.8, True), ("uniform", 1.0, 0.4, True), ("none", 1.0, 0.9, False)]
    df = spark.createDataFrame(points, "condition string, budget_fraction double, resident_fraction double, gate_pass boolean")
    records.write_sweep(spark, df, str(tmp_path / "sweep"))
    again = records.read_sweep(spark, str(tmp_path / "sweep"))
    assert sorted(map(tuple, again.collect())) == sorted(points)
    got = {r["condition"]: r for r in sweeps.knee(again).collect()}
    assert got["real"]["least_resident"] == 0.4 and got["real"]["verdict"] is None and all(r["knee_found"] for r in got.values())
    assert (got["shuffled"]["ratio"], got["shuffled"]["verdict"]) == (2.0, "real_wins")
    assert got["uniform"]["verdict"] == "control_ties_or_wins" and got["none"]["least_resident"] is None and got["none"]["verdict"] is None


def test_graph_files(spark, tmp_path):
    records.write_graph(spark.createDataFrame([(0, 1, 0.5)], "src long, tgt long, weight double"), str(tmp_path / "g"), {"name": "replication", "seed": 3})
    (line,) = spark.read.text(str(tmp_path / "g/metadata")).collect()
    assert json.loads(line["value"]) == {"name": "replication", "seed": 3, "edges": 1}


def test_queue_and_keys(spark):
    events = spark.createDataFrame([(5, 1, 10), (3, 2, 11), (3, 1, 12), (9, 1, 13)], "tick int, nid long, event_id long")
    queue = dynamics.queue_order(events)
    assert [r["event_id"] for r in dynamics.drained(queue, 3).orderBy("tick", "seq").collect()] == [11, 12]
    assert tuple(dynamics.queue_head(queue, 3).first()) == (2, 5, 10, 1)
    assert tuple(dynamics.queue_head(queue, 9).first()) == (0, None, None, None)
    assert tuple(dynamics.peak_resident(events, 4).first()) == (3, 2)
    gaps = trains.key_gaps(events, events.where("nid = 1").withColumn("nid", F.lit(7).cast("long")))
    assert {tuple(r) for r in gaps.collect()} == {(1, "candidate"), (2, "candidate"), (7, "reference")}


def test_waiting_hints():
    assert _asked("12", 1.0) == 12.0 and _asked(None, 1.5) == 1.5 and _asked("12s", 1.5) == 1.5
    assert _asked("Wed, 21 Oct 2015 07:28:00 GMT", 1.5) == 0.0


def test_command_line(spark, tmp_path, capsys):
    from meshgrain.__main__ import main

    assert main(["nt_distribution", "--data", "/root/testdata/sf0.001", "--json", str(tmp_path / "new/out.json"), "--limit", "3"]) == 0
    written = json.loads((tmp_path / "new/out.json").read_text())
    assert written["query"] == "nt_distribution" and len(written["rows"]) == 3 and set(written["rows"][0]) == {"nt", "n", "share"}
    assert main(["nt_distribution", "--data", "/root/testdata/sf0.001"]) == 0 and "share" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["no_such_query", "--data", "x"])
