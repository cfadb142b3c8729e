"""Corpora of chunk files, run and sweep records, configurations, graph files: small JSON beside Spark tables."""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshgrain.sources.edge_files import CHUNK_SCHEMA, cleaned, weighted


class NoChunks(FileNotFoundError):
    """A corpus folder without a matching file."""


def chunk_files(spark: SparkSession, folder: str, pattern: str = "chunk-*.parquet", limit: int | None = None) -> list[str]:
    """Paths of the chunk files in order of name, the first `limit` of them if that is given and not 0."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    names = sorted(r["path"] for r in found.collect())  # names of files
    if not names:
        raise NoChunks(f"no {pattern} in {folder}")
    return names[:limit] if limit else names


def load_contacts(spark: SparkSession, folder: str, pattern: str = "chunk-*.parquet", limit: int | None = None) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(*chunk_files(spark, folder, pattern, limit))


def successors(contacts: DataFrame) -> DataFrame:
    """(src, tgt) once each; loops and unmapped ids stay."""
    return contacts.select(F.col("pre").alias("src"), F.col("post").alias("tgt")).distinct()


def load_dataset(contacts: DataFrame, floor: float = 0.05, known_only: bool = False, scale: float = 1.0) -> tuple[DataFrame, dict[str, int]]:
    """Weighted edges, and how many rows were seen, are distinct, and how many neurons they join."""
    edges = weighted(cleaned(contacts, floor, known_only), scale)
    ids = edges.select(F.explode(F.array("pre", "post")).alias("id"))
    return edges, {"rows_seen": contacts.count(), "distinct": edges.count(), "neurons": ids.distinct().count()}


class Rule(NamedTuple):
    """What holds for one place of a configuration, given by its keys: whether it must be there, and what its value must be, in words and as a test."""

    at: str
    needed: bool = False
    must: str = ""
    holds: Callable[[object], bool] = lambda value: True


def _number(value: object) -> bool:
    try:
        float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return False
    return True


#: Places and limits are fixed values; a section is a place without a dot.
RULES = (
    *(Rule(section, True, "be a mapping", lambda v: isinstance(v, dict)) for section in ("experiment", "network", "neuron", "runtime")),
    Rule("experiment.id", True),
    Rule("neuron.dt_ms", False, "be a number above 0", lambda v: v is None or (_number(v) and float(v) > 0)),
    *(Rule(f"runtime.{k}", False, "be a whole number above 0", lambda v: type(v) is int and v > 0) for k in ("active_neuron_budget", "gpu_memory_budget_mb")),
)


def faults(data: dict, rules: Sequence[Rule] = RULES) -> list[str]:
    """What breaks the rules, in their order; a place inside a missing section is missing only if it is needed."""
    found = []
    for rule in rules:
        value, there = data, True
        for key in rule.at.split("."):
            there = isinstance(value, dict) and key in value
            value = value[key] if there else None
            if not there:
                break
        if not there and rule.needed:
            found.append(f"`{rule.at}` is not there")
        elif there and not rule.holds(value):
            found.append(f"`{rule.at}` has to {rule.must}, but is {value!r}")
    return found


def validate_config(data: dict, rules: Sequence[Rule] = RULES) -> None:
    """Raises one ValueError with everything that breaks the rules, a TypeError if data is no mapping."""
    if not isinstance(data, dict):
        raise TypeError(f"a configuration is a mapping, this is a {type(data).__name__}")
    if found := faults(data, rules):
        raise ValueError(f"{len(found)} faults in the configuration: " + "; ".join(found))


def load_config(spark: SparkSession, path: str) -> dict:
    """A configuration file, JSON or (where that library is there) YAML, from any file system of the cluster; it has to keep the rules."""
    rows = spark.read.text(path, wholetext=True).take(1)
    text = rows[0]["value"] if rows else ""
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    validate_config(data)
    return data


def config_hash(data: dict) -> str:
    """SHA-256 of the configuration as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def build_record(config: dict, seed: int, conditions: list[dict], **more) -> dict:
    """A run's record; its id is the head of the configuration's hash and the seed. A condition may have its scores under `fidelity`."""
    digest = config_hash(config)
    low = min((r for c in conditions if (r := (c.get("fidelity") or {}).get("rate_ratio")) is not None), default=None)
    seen = f"{len(conditions)} conditions, " + ("none scored" if low is None else f"least rate ratio {low:.4f}")
    return {"run_id": f"{digest[:8]}-{seed}", "config_hash": digest, "seed": seed, "conditions": conditions, "observation": seen, **more}


def write_text(spark: SparkSession, text: str, folder: str) -> None:
    """One small text as a file of a folder that any file system of the cluster may hold."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def write_record(spark: SparkSession, record: dict, folder: str) -> None:
    write_text(spark, json.dumps(record, sort_keys=True), folder)


_FIDELITY = "struct<rate_ratio:double,count_correlation:double,binned_cosine:double,max_count_diff:long,passed:map<string,boolean>,overall_pass:boolean>"
_CONDITION = (
    "struct<condition:string,total_spikes:long,events_delivered:long,peak_resident:long,materializations:long,evictions:long,wall_seconds:double,"
    f"stored_synapses:long,resident_synapses:long,health_ok:boolean,health_failures:array<string>,fidelity:{_FIDELITY}>"
)
_RUN = f"experiment_id string, run_id string, created string, seed long, config_hash string, observation string, spec struct<n_neurons:long>, conditions array<{_CONDITION}>"


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run records as they are, one row for each file."""
    return spark.read.schema(_RUN).json(folder, multiLine=True)


def read_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each condition of run records, with what a report shows: counts, residency and compression ratios, and the scores, null where it was not scored."""
    rows = read_runs(spark, folder).select("experiment_id", "run_id", "seed", "spec.n_neurons", F.explode("conditions").alias("c"))
    none = lambda c, value: F.coalesce(F.col(f"c.{c}"), F.lit(value)).alias(c)
    counts = ("total_spikes", "events_delivered", "peak_resident", "evictions", "materializations", "stored_synapses", "resident_synapses")
    scores = ("rate_ratio", "count_correlation", "binned_cosine", "max_count_diff")
    rows = rows.select(
        "experiment_id", "run_id", "seed", "n_neurons", "c.condition", *(none(c, 0) for c in counts), *(F.col(f"c.fidelity.{c}") for c in scores),
        F.col("c.fidelity.overall_pass").alias("gate_pass"), none("wall_seconds", 0.0), "c.health_ok", "c.health_failures",
    )
    ratio = lambda a, b, none: F.when(F.coalesce(b, F.lit(0)) != 0, a / b).otherwise(none)
    rows = rows.withColumn("resident_fraction", ratio(F.col("peak_resident"), F.col("n_neurons"), 0.0))
    return rows.withColumn("compression_ratio", ratio(F.col("stored_synapses"), F.col("resident_synapses"), float("inf")))


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """Points of a sweep file {real: [...], controls: {name: [...]}} with their condition."""
    point = "array<struct<budget_fraction:double,resident_fraction:double,gate_pass:boolean>>"
    data = spark.read.schema(f"real {point}, controls map<string,{point}>").json(path, multiLine=True)
    real = data.select(F.lit("real").alias("condition"), F.explode("real").alias("p"))
    controls = data.select(F.explode("controls").alias("condition", "ps")).select("condition", F.explode("ps").alias("p"))
    return real.unionAll(controls).select("condition", "p.*")


def write_sweep(spark: SparkSession, points: DataFrame, folder: str, real: str = "real") -> None:
    """The file that read_sweep reads; points are a few for each condition."""
    rows = [r.asDict() for r in points.orderBy("condition", F.desc("budget_fraction")).collect()]
    each: dict[str, list] = {}
    for r in rows:
        each.setdefault(r["condition"], []).append({k: v for k, v in r.items() if k != "condition"})
    write_text(spark, json.dumps({"real": each.pop(real, []), "controls": each}, sort_keys=True), folder)


def write_graph(edges: DataFrame, folder: str, metadata: dict) -> None:
    """Edges as JSON lines, and beside them what they were made from, with counts."""
    spark = edges.sparkSession
    edges.write.mode("overwrite").json(f"{folder}/edges")
    write_record(spark, metadata | {"edges": spark.read.json(f"{folder}/edges").count()}, f"{folder}/metadata")


def _html_rows(rows: DataFrame) -> str:
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows.collect())
    return f"<table><tr>{''.join(cell('th', c) for c in rows.columns)}</tr>{body}</table>"


def html_table(rows: DataFrame, title: str) -> str:
    """A small table (a report's) as a page of its own; every value is escaped."""
    return html_page(title, {}, {"": rows})


def html_page(title: str, facts: dict[str, object], tables: dict[str, DataFrame]) -> str:
    """A page without anything from elsewhere: facts as a list, then small tables under their headings. Everything is escaped."""
    escape = lambda x: html.escape("" if x is None else str(x))
    style = "body{font:15px sans-serif;margin:2em}td,th{border:1px solid;padding:.2em .6em;text-align:right}table{border-collapse:collapse}"
    listed = "".join(f"<dt>{escape(k)}</dt><dd>{escape(v)}</dd>" for k, v in facts.items())
    parts = "".join((f"<h2>{escape(name)}</h2>" if name else "") + _html_rows(rows) for name, rows in tables.items())
    return f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><style>{style}</style><h1>{escape(title)}</h1>" + (f"<dl>{listed}</dl>" if facts else "") + parts


def run_report(spark: SparkSession, folder: str) -> str:
    """The report of run records of one folder as a page: what ran, how it was scored, how it was resident, and what failed."""
    runs, rows = read_runs(spark, folder), read_conditions(spark, folder)
    facts = runs.orderBy("run_id").select("experiment_id", "run_id", "created", "seed", "config_hash", "observation").first()
    tables = {
        "Scores": rows.select("run_id", "condition", "rate_ratio", "count_correlation", "binned_cosine", "max_count_diff", "gate_pass"),
        "Residency": rows.select("run_id", "condition", "peak_resident", "resident_fraction", "evictions", "materializations", "stored_synapses", "resident_synapses", "compression_ratio"),
        "Failures": rows.where("not health_ok or not gate_pass").select("run_id", "condition", "health_ok", F.array_join("health_failures", "; ").alias("failures")),
    }
    return html_page("Runs", facts.asDict() if facts else {}, {k: t.orderBy("run_id", "condition") for k, t in tables.items()})
