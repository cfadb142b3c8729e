"""Tables in the cluster's shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset, as in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders that this driver has made, with the session of each.
_MADE: dict[str, SparkSession] = {}


def unique() -> str:
    return uuid.uuid4().hex


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is there goes when the driver ends, or with `drop_stashes`."""
    path = f"{shared_folder(spark)}/{kind}-{unique()}"
    _MADE[path] = spark
    return path


def stash(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage is cut and lost executors lose nothing.

    Results read their stashes when they are used, so those go when the driver ends, with `drop_stashes`, or with `discard`.
    """
    path = own_folder(df.sparkSession, "stash")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*stashes: DataFrame) -> None:
    """Deletes the tables of stashes that nothing will read again."""
    for df in stashes:
        delete(df.sparkSession, df.stashed_at)
        _MADE.pop(df.stashed_at, None)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Gives a folder another name on its file system, in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    if not hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(hadoop(path), hadoop(to)):
        raise OSError(f"{path} could not be moved to {to}")


@atexit.register
def drop_stashes() -> None:
    """Deletes all folders of this driver; results that still read them are lost."""
    for path, spark in list(_MADE.items()):
        with contextlib.suppress(Exception):  # the session may be gone, and the cluster's folder with it
            delete(spark, path)
        del _MADE[path]
