"""Intermediate tables that every executor can read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one is made only in a local session where that is not set."""
    context = spark.sparkContext
    if configured := context.getConf().get("spark.checkpoint.dir"):
        return configured
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below that of spark.checkpoint.dir."""
    return f"{_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir."""
    _folder(df.sparkSession)
    return df.checkpoint()
