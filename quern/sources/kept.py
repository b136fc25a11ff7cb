"""Tables that a session writes for itself, in the folder that its executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset on a local master, in a folder that goes with the driver."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"


def local_scratch(spark: SparkSession, name: str) -> str:
    """scratch() as file systems other than Spark's know it."""
    return scratch(spark, name).removeprefix("file://")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
