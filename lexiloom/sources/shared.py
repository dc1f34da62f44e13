"""What all executors share: a folder for tables and checkpoints, so that a lost executor takes nothing with it."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and driver and executors are one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexiloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    return f"{folder(spark)}/{uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: several later steps read it, and none works it out again. For votes and spans, not for texts."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
