"""The library's functions for queries in SQL text.

`register(spark)` makes scalar functions (virtual_id, keyed_target, keyed_uniform, retry_after, readable numbers) and the table function
`fan_out(TABLE(nodes) PARTITION BY (id), degree, n, seed, population, version, weight, spread)` known to a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.types import LongType

from meshgrain.functions.draws import blake2b_64, keyed_ints

FAN_OUT = "src long, k int, tgt long, weight double"


def _words(x: pd.Series) -> np.ndarray:
    return x.to_numpy(np.int64).view(np.uint64)


class FanOut:
    """Each node's synapses, made when asked for: targets in [0, n) and weights in [weight - spread, weight + spread] from keyed hashes. The node is the first column."""

    def eval(self, nodes: pa.RecordBatch, degree: pa.Array, n: pa.Array, seed: pa.Array, population: pa.Array, version: pa.Array, weight: pa.Array, spread: pa.Array) -> Iterator[pa.Table]:
        k, most, s, pop, ver, w, d = (x[0].as_py() for x in (degree, n, seed, population, version, weight, spread))
        ids = nodes.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        src, salt = pd.Series(np.repeat(ids, k)), pd.Series(np.tile(np.arange(k, dtype=np.int64), len(ids)))
        target = (keyed_ints(s, src, pop, ver, salt, 0) % np.uint64(most)).astype(np.int64)
        u = keyed_ints(s, src, pop, ver, salt, 1).astype(np.float64) / 2.0**64
        yield pa.table({"src": src.to_numpy(), "k": salt.to_numpy().astype(np.int32), "tgt": target, "weight": float(w) + float(d) * (2 * u - 1)})


#: SQL functions over the two hashes, over each other and over Spark's own.
SQL = {
    "unsigned(bits BIGINT) RETURNS DECIMAL(20,0)": "CAST(bits AS DECIMAL(20,0)) + IF(bits < 0, CAST(18446744073709551616 AS DECIMAL(20,0)), CAST(0 AS DECIMAL(20,0)))",
    "virtual_id(seed BIGINT, module BIGINT, lineage BIGINT, generation BIGINT, place BIGINT) RETURNS DECIMAL(20,0)": "unsigned(virtual_bits(seed, module, lineage, generation, place))",
    "keyed_target(source BIGINT, salt BIGINT, n BIGINT, seed BIGINT, population BIGINT, version BIGINT) RETURNS BIGINT": "CAST(unsigned(keyed_bits(seed, source, population, version, salt, 0L)) % n AS BIGINT)",
    "keyed_uniform(source BIGINT, salt BIGINT, seed BIGINT, population BIGINT, version BIGINT) RETURNS DOUBLE": "CAST(unsigned(keyed_bits(seed, source, population, version, salt, 1L)) AS DOUBLE) / 18446744073709551616D",
    "closed_form_voltage(v0 DOUBLE, input DOUBLE, steps BIGINT, decay DOUBLE) RETURNS DOUBLE": "input + (v0 - input) * power(decay, steps)",
    "ms_to_tick(ms DOUBLE, dt_ms DOUBLE) RETURNS BIGINT": "CAST(rint(ms / dt_ms) AS BIGINT)",
}


def register(spark: SparkSession) -> None:
    """Makes all of them known to the session; again is harmless."""

    @F.pandas_udf(LongType())
    def keyed_bits(seed: pd.Series, source: pd.Series, population: pd.Series, version: pd.Series, salt: pd.Series, domain: pd.Series) -> pd.Series:
        tail = (_words(salt) & np.uint64(0xFFFFFFFF)) | (_words(domain) << np.uint64(32))
        return pd.Series(blake2b_64([*map(_words, (seed, source, population, version)), tail], 40).view(np.int64))

    @F.pandas_udf(LongType())
    def virtual_bits(seed: pd.Series, module: pd.Series, lineage: pd.Series, generation: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(blake2b_64([*map(_words, (seed, module, lineage, generation, place))], 40).view(np.int64))

    spark.udf.register("keyed_bits", keyed_bits)
    spark.udf.register("virtual_bits", virtual_bits)
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("fan_out", arrow_udtf(FanOut, returnType=FAN_OUT))
