"""The corpus pipeline: language ID, line dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined cases, for all stages: an empty table stays empty; further columns are passed through (but by the mix); texts are read whole, however
long; rows of one doc_id are one document to line and near dedup, and rows without a doc_id pass both; the mix alone draws lots, by a hash of
id and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from tracemill.llm.common import BLANKS, scratch_path
from tracemill.llm.queries import fold


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (a null or empty text, or no letter) go; a missing lang is filled in, a given one stays. Repeated rows are judged
    alike; of languages with equal scores the model takes the first. Without any labelled text everything is `und`, and goes."""
    model = language_id.train(docs.where(fold(3) != 1).select("text", "lang"))
    said = language_id.identified(docs, model)
    return said.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the smallest doc_id only; documents that had nothing else but white space go. Null texts have no line that counts and
    stay; repeated rows of a doc_id keep the same lines; n_chars follows a changed text."""
    dedup = line_dedup.LineDedup(spark)
    dedup.insert(docs)
    done = dedup.clean(docs).where((F.col("n_dropped") == 0) | (F.btrim("kept_text", F.lit(BLANKS)) != ""))
    done = done.withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near copies stays, with all its rows if it has several. Null texts and texts without words are classes of
    their own and stay."""
    gone = near_dedup.near_classes(docs).where("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of them that do. Null and empty texts hold none; an empty benchmark takes nothing out."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.with_leaks(docs, benchmark).where(F.size("leaks") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their copies (one or two); those with none go. Null texts have no words and are never taken; a null source is a
    source of its own; repeated rows are drawn each on its own."""
    taken = mixing.mixed(docs)
    return taken.where("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", decontaminated),
    ("mixing", mix),
]

#: SQL can express neither the classifier nor the rounding of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := scratch_path(spark, "pipeline"))
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
