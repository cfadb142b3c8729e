"""A remote table behind HTTP, fetched by ids or by pages into a table of the cluster, so that a fetch that was broken off goes on.

The table is made of rounds. A round is a set of ids, fetched by a few tasks at once and written to a folder that gets its place only when
it is whole; ids of whole rounds are done and not asked for again. A server that asks to wait is waited for; an id that fails
again and again is noted with its problem and tried anew by the next call.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshgrain.sources.byte_ranges import _asked
from meshgrain.sources.stored import move, unique

#: place counts an id's rows from 0; the row of place -1 says that the id is done (problem null) or what went wrong, and row how many rows it has.
FETCHED = "id long, place long, row string, problem string"


def get_json(url: str, tries: int, wait: float, timeout: float = 60.0) -> list:
    """The JSON array at a url. Asked to slow down, it waits as long as asked for, or else longer each time; after other errors it waits less."""
    for attempt in range(1, tries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return json.load(answer)
        except (OSError, ValueError) as e:
            if attempt == tries:
                raise OSError(f"{tries} tries: {e}") from e
            slow = isinstance(e, urllib.error.HTTPError) and e.code == 429
            time.sleep(_asked(e.headers.get("Retry-After"), 5 * wait * attempt) if slow else 2 * wait * attempt)
    return []


def rows_of(url: str, key: int, page: int, tries: int, wait: float) -> Iterator[str]:
    """All rows of an id as JSON, page after page until one is not full. The url has {id}, {limit}, {offset} and, for pages, {first} in it."""
    offset = 0
    while True:
        got = get_json(url.format(id=key, limit=page, offset=offset, first=key * page), tries, wait)
        yield from (json.dumps(r) for r in got)
        offset += len(got)
        if len(got) < page or "{offset}" not in url:
            return


def pull(ids: DataFrame, url: str, folder: str, workers: int = 4, round_ids: int = 10_000, page: int = 100_000, tries: int = 6, wait: float = 1.0, most_rounds: int | None = None) -> int:
    """Fetches all ids (id long) that are not done yet, at most `workers` at a time, in rounds of about round_ids ids; gives the number of rounds.

    Null and repeated ids are fetched once or not at all. An id without rows is done with none.
    """
    spark = ids.sparkSession

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch["id"].to_pylist():
                held: list[str] = []
                problem = None
                try:
                    held = list(rows_of(url, key, page, tries, wait))
                except OSError as e:
                    problem = str(e)
                n = 0 if problem else len(held)
                columns = [pa.array([key] * (n + 1)), pa.array([*range(n), -1]), pa.array([*held[:n], str(n)]), pa.array([None] * n + [problem], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "place", "row", "problem"])

    todo = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct().join(done(spark, folder), "id", "left_anti")
    rounds = -(-todo.count() // round_ids)
    todo = todo.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(max(rounds, 1))))
    if rounds:
        todo = todo.persist()  # what is done changes from round to round
    for k in range(rounds if most_rounds is None else min(rounds, most_rounds)):
        name = unique()
        todo.where(F.col("round") == k).select("id").repartition(workers).mapInArrow(fetch, FETCHED).write.parquet(f"{folder}/_{name}")
        move(spark, f"{folder}/_{name}", f"{folder}/round-{name}")
    todo.unpersist()
    return rounds


def pull_pages(spark: SparkSession, url: str, folder: str, page: int, workers: int = 4, round_pages: int = 100, **more) -> int:
    """Fetches pages 0, 1, ... of `page` rows until a round of them has an empty one; gives the number of pages that have rows. The url has {first} and {limit} in it."""
    end = 0
    while True:
        pull(spark.range(end, end + round_pages), url, folder, workers, round_pages, page, **more)
        held = fetched(spark, folder).where(f"place = -1 and problem is null and id >= {end} and id < {end + round_pages}")
        if held.where("row <> '0'").count() < round_pages:
            return fetched(spark, folder).where("place = -1 and problem is null and row <> '0'").count()
        end += round_pages


def fetched(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of whole rounds, with the marks of their ids."""
    try:
        return spark.read.schema(FETCHED).parquet(f"{folder}/round-*")
    except AnalysisException:
        return spark.createDataFrame([], FETCHED)


def done(spark: SparkSession, folder: str) -> DataFrame:
    return fetched(spark, folder).where("place = -1 and problem is null").select("id")


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """(id, problem): ids that are not done, with what went wrong."""
    marks = fetched(spark, folder).where("place = -1 and problem is not null")
    return marks.join(done(spark, folder), "id", "left_anti").groupBy("id").agg(F.max("problem").alias("problem"))


def table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows as columns, with their id and place."""
    return fetched(spark, folder).where("place >= 0").select("id", "place", F.from_json("row", schema).alias("r")).select("id", "place", "r.*")
