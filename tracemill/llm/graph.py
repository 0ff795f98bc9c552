"""Connected components by alternating large-star and small-star steps, each a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, comp: the smallest node of each node's component; the smallest itself is left out."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "cc-edges")
    was = _state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "cc-large")
        forget(least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        old, e = e, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        for df in (old, large, least):
            forget(df)
        if (now := _state(e)) == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
