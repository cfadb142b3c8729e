"""Edge files: parquet chunks and CSV lists, with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, LongType, ShortType, StringType, StructField, StructType

#: Transmitter names by code; any other code is unknown.
NT_NAMES = ("GABA", "ACH", "GLUT", "OCT", "SER", "DA")
#: Names that an edge list may use.
NT_ALLOWED = ("ACH", "DA", "GABA", "GLUT", "HIST", "OCT", "SER", "TYR", "UNKNOWN")

CHUNK_SCHEMA = StructType([StructField("pre", LongType()), StructField("post", LongType()), StructField("nt", ShortType()), StructField("conf", FloatType())])
CSV_SCHEMA = StructType([StructField(c, StringType()) for c in ("pre_id", "post_id", "synapses", "neurotransmitter")])


def read_chunks(spark: SparkSession, folder: str, pattern: str = "chunk-*.parquet") -> DataFrame:
    """Contacts of all chunk files of a folder."""
    return spark.read.schema(CHUNK_SCHEMA).option("pathGlobFilter", pattern).parquet(folder)


def read_edge_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edge list with a header; a malformed line fails the read."""
    return spark.read.schema(CSV_SCHEMA).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def describe(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: rows and bytes, from the scan's own metadata."""
    files = spark.read.parquet(path).select("_metadata.file_name", "_metadata.file_size")
    return files.groupBy("file_name").agg(F.count("*").alias("rows"), F.max("file_size").alias("bytes"))


def nt_name(code: Column) -> Column:
    return F.when(code.between(0, len(NT_NAMES) - 1), F.element_at(F.array(*map(F.lit, NT_NAMES)), F.when(code.between(0, len(NT_NAMES) - 1), code).otherwise(0).cast("int") + 1)).otherwise("UNKNOWN")


def normalised(rows: DataFrame) -> DataFrame:
    """Edge rows with typed columns and `problem`: null for good rows, else the first rule that fails."""
    nt = F.upper(F.trim(F.coalesce("neurotransmitter", F.lit(""))))
    typed = rows.select(
        F.expr("try_cast(trim(pre_id) as bigint)").alias("pre_id"),
        F.expr("try_cast(trim(post_id) as bigint)").alias("post_id"),
        F.expr("try_cast(trim(synapses) as int)").alias("synapses"),
        F.when(nt == "", "UNKNOWN").otherwise(nt).alias("neurotransmitter"),
    )
    problem = F.expr("case when pre_id is null or post_id is null or synapses is null then 'not a number' when pre_id < 0 or post_id < 0 then 'negative id' when synapses <= 0 then 'no synapses' end")
    return typed.withColumn("problem", F.coalesce(problem, F.when(~F.col("neurotransmitter").isin(*NT_ALLOWED), "unknown transmitter")))


def cleaned(edges: DataFrame, floor: float = 0.05, known_only: bool = False) -> DataFrame:
    """Contacts between two different mapped ids; a null confidence passes the floor."""
    kept = edges.where("pre <> 0 and post <> 0 and pre <> post").where(F.col("conf").isNull() | (F.col("conf") >= floor))
    return kept.where("nt <> 255") if known_only else kept


def weighted(edges: DataFrame, scale: float = 1.0) -> DataFrame:
    """Each (pre, post, nt) once, with its signed weight: GABA inhibits, all else excites."""
    sign = F.when(F.col("nt") == 0, -1.0).otherwise(1.0)
    return edges.select("pre", "post", "nt").distinct().withColumn("weight", sign * scale)


def argmax_code(probabilities: Column, valid: Column) -> tuple[Column, Column]:
    """(code, confidence): the first of the largest probabilities, null counting as 0; 255 where not valid."""
    known = F.transform(probabilities, lambda p: F.coalesce(p, F.lit(0.0)))
    top = F.array_max(known)
    return F.when(valid, F.array_position(known, top) - 1).otherwise(255).cast("int"), top
