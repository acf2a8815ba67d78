"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="lanecost-")


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which must name storage that every executor sees.

    Where it is not set, a local session gets a temporary folder; a cluster has none that would be safe.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own()
    path = f"{base.rstrip('/')}/lanecost-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Remove the folders that were made within the block when it ends. What it computes must be written by then, to a
    folder made before; a frame that still reads one of these folders fails afterwards."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _made[before:]


def stored(frame: DataFrame) -> DataFrame:
    """Write a frame as Parquet into a new shared folder and read it back: a finished step is not computed again."""
    path = folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
