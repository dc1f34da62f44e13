"""What the operators share: running module functions on executors, checkpoints, and safe column picking."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def remote(module: str, name: str, **params):
    """A function of one argument (batches, or a group's table) that calls ``module.name`` on an executor.

    Only the names and parameters travel; the module is imported by the worker, so tables that it
    builds once are kept for later tasks of the same worker.
    """
    root = ROOT

    def run(data):
        import importlib

        if root not in sys.path:
            sys.path.insert(0, root)
        return getattr(importlib.import_module(module), name)(data, **params)

    return run


def remote_stream(module: str, name: str, **params):
    """As ``remote``, for groups: the function gets a group's batches one by one and yields batches, so neither is ever held whole."""
    call = remote(module, name, **params)

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return call(data)

    return run


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``; a folder of our own only where that is unset and driver and executors are one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexiloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """A folder of our own in the shared file system, with all that it has."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder; its lineage ends there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Ask the JVM to notice that shuffles and checkpoints are no longer referred to, so their files go before the next search."""
    for _ in range(3):  # what is found unused in one round holds what can be found in the next; the last job's plan is held until another one runs
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
        spark.range(1).collect()


def slim(docs: DataFrame, *wanted: str) -> DataFrame:
    """Only the columns an operator reads; other columns, whatever their names, never meet its own."""
    return docs.select(*[F.col(f"`{c}`") for c in wanted])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
