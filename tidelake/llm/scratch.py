"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table and reading it again, so a lost executor costs a re-read, not a
re-computation, and random decisions of the scheduler never change rows that were seen once.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark then deletes an execution's shuffle files when it ends, instead of at some later garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary one if all executors are threads of this process, else one in the
    warehouse, which they share.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and re.match(r"local(\[|$)", spark.sparkContext.master):
        named = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="tidelake-")
        shared_dir.own = named
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/tidelake-scratch").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder that is removed when the application ends."""
    path = f"{shared_dir(spark)}/tidelake/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path.getParent())
    fs.deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    for made in _OPEN:
        made.append(out)
    return out


#: Rows of ids and hashes that may be sent to every executor as a hash table, some 30 MB.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialized table, marked to be sent to every executor if it has few rows; beyond, it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


_OPEN: list[list[DataFrame]] = []


@contextlib.contextmanager
def passing():
    """Removes the tables materialized inside when it ends, except those taken from the list that it gives."""
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.pop()
        for df in made:
            discard(df)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Executions inside leave no shuffle files; what they wrote is read from its table."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def discard(df: DataFrame) -> None:
    """Removes a materialized table that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for made in _OPEN:
        if df in made:
            made.remove(df)
