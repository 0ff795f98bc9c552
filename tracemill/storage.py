"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; only a local session without one (tests) gets a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{base or os.path.join(tempfile.gettempdir(), 'checkpoints')}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def keeper(spark: SparkSession, name: str):
    """A function that writes a table to the shared folder and reads it back."""

    def keep(df: DataFrame) -> DataFrame:
        df.write.parquet(path := shared(spark, name))
        return spark.read.schema(df.schema).parquet(path)

    return keep
