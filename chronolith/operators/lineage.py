"""Cutting a plan's lineage between the steps of an iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None

#: Rows of a frontier (an id each) that are sent to all tasks; a larger one is shuffled.
SMALL = 100_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session (``spark.checkpoint.dir``).

    A local master that names no folder gets one of its own; a cluster must name one that driver and executors share.
    """
    global _own_dir
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = _own_dir = _own_dir or tempfile.mkdtemp(prefix="chronolith-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go as soon as it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and whole if executors are lost."""
    path = shared_path(df.sparkSession, "cut")
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(ids: DataFrame, rows: int) -> DataFrame:
    """``ids``, known to have so many rows, to be broadcast if these are few."""
    return F.broadcast(ids) if rows <= SMALL else ids
