"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

#: The white space of the word and line contracts: space, tab, \n, \v, \f, \r.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without one (tests) gets a folder of this machine."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, files = _hadoop(spark, path)
    files.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tm_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table of a stored() DataFrame that nothing reads any more (for loops that replace their state)."""
    where, files = _hadoop(df.sparkSession, df._tm_path)
    files.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() is the fast path where a text is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash128(value: Column) -> Column:
    """Two 64-bit hashes with different seeds, as one struct."""
    return F.struct(F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(7), value).alias("h2"))


def word_count(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ words; null counts as empty."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def python_ready(spark: SparkSession, rows: int = 1024) -> None:
    """Before Python runs in tasks: they can import this package, and hold few (perhaps long) rows at a time."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
