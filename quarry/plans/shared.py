"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[DataFrame]] = []


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder of this machine only where none is set and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not where and held.isDefined():
        return held.get()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir names no folder that all executors of {master} share")
        where = tempfile.mkdtemp(prefix="quarry-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder, without their lineage."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of the shared folder."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.written_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(table: DataFrame) -> None:
    """Delete what written() has made, once nothing reads it any more."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.written_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that are written inside go at the end."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            discard(table)
