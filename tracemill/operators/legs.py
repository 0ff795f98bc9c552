"""Travel legs between consecutive stays, and chains of legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHAIN_PAUSE, LEG_MAX_GAP, LEG_MIN_DISTANCE
from ..functions.geo import metres, mode_of_speed
from . import scan
from .sequence import islands, overlap_join

#: Seconds of a bin of chained(): of a person a task holds a year's segments, and two runs of each year meet those of other years.
CHAIN_BIN = 365 * 86_400


def segments(visits: DataFrame, pings: DataFrame) -> DataFrame:
    """visits (tid, start_ts, end_ts), trusted pings. Returns tid, start_ts, end_ts, mode, distance_m, duration_s, start_visit, end_visit.

    Pings from the end of a visit to the start of the next are a leg, split where they are silent for too long. Only the
    first and the last part of a leg touch a visit. Pings of one second count once, the last one recorded.
    """
    gaps = scan.running(visits.select("tid", "start_ts", "end_ts"), ["tid"], "start_ts", ["end_ts"], {"leg_to": ("lag", F.col("start_ts"))}, back=True)
    gaps = gaps.select("tid", F.col("start_ts").alias("visit_ts"), F.col("end_ts").alias("leg_from"), "leg_to").where("leg_to is not null and leg_to >= leg_from")
    one = pings.groupBy("tid", "tst").agg(F.max_by("lat", "id").alias("lat"), F.max_by("lon", "id").alias("lon")).withColumn("tst_", F.col("tst"))
    on = overlap_join(gaps, one, ("leg_from", "leg_to"), ("tst", "tst_"), ["tid"])
    v = Window.partitionBy("tid", "visit_ts").orderBy("tst")
    on = on.withColumn("gap", F.col("tst") - F.lag("tst").over(v)).withColumn("hop", metres(F.lag("lat").over(v), F.lag("lon").over(v), F.col("lat"), F.col("lon")))
    on = islands(on, ["tid", "visit_ts"], ["tst"], F.col("gap") > LEG_MAX_GAP, "part")
    inside = F.when((F.col("gap") <= LEG_MAX_GAP), F.col("hop")).otherwise(0.0)
    parts = on.groupBy("tid", "visit_ts", "leg_to", "part").agg(F.min("tst").alias("start_ts"), F.max("tst").alias("end_ts"), F.sum(inside).alias("distance_m"), F.count("*").alias("n"))
    every = Window.partitionBy("tid", "visit_ts")
    parts = parts.withColumn("last", F.max("part").over(every)).withColumn("duration_s", (F.col("end_ts") - F.col("start_ts")).cast("double"))
    kept = parts.where((F.col("n") >= 2) & (F.col("distance_m") >= LEG_MIN_DISTANCE) & (F.col("duration_s") > 0))
    mode = mode_of_speed(F.col("distance_m") / 1000 / (F.col("duration_s") / 3600))
    return kept.select("tid", "start_ts", "end_ts", mode.alias("mode"), "distance_m", "duration_s", F.when(F.col("part") == 0, F.col("visit_ts")).alias("start_visit"), F.when(F.col("part") == F.col("last"), F.col("leg_to")).alias("end_visit"))


def chained(segments: DataFrame, keys: list[str], width: int = CHAIN_BIN) -> DataFrame:
    """Journeys of each tid: consecutive segments of one mode with short pauses; flights and segments without a mode never chain. keys order equal starts.

    Rows are shuffled once, by person and bin. A bin's runs but its first and its last one are journeys as they are; those two go on, few to a
    bin, to be joined over the borders of bins."""
    follows = lambda was, left: F.coalesce((was == F.col("mode")) & (F.col("mode") != "flying") & (F.col("start_ts") - left <= CHAIN_PAUSE), F.lit(False))
    w = Window.partitionBy("tid", "__bin").orderBy("start_ts", *keys)
    rows = segments.withColumn("__bin", F.floor(F.col("start_ts") / width)).withColumns({"__new": F.when(follows(F.lag("mode").over(w), F.lag("end_ts").over(w)), 0).otherwise(1), "__i": F.row_number().over(w), "__last": F.lead(F.lit(1)).over(w).isNull()})
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = {"distance_m": F.sum("distance_m"), "duration_s": F.sum("duration_s")}
    joined = lambda order, n: [F.first("mode").alias("mode"), F.min("start_ts").alias("start_ts"), F.max_by("end_ts", order).alias("end_ts"), *[v.alias(c) for c, v in sums.items()], n.alias("n_segments")]
    runs = rows.groupBy("tid", "__bin", "__run").agg(*joined(F.col("__i"), F.count("*")), F.max("__last").alias("__last"))
    border = (F.col("__run") == 1) | F.col("__last")
    one = Window.partitionBy("tid").orderBy("__bin", "__run")
    over = follows(F.lag("mode").over(one), F.lag("end_ts").over(one)) & (F.col("__run") == 1)
    ends = runs.where(border).withColumn("__starts", F.when(over, 0).otherwise(1)).withColumn("journey", F.sum("__starts").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.groupBy("tid", "journey").agg(*joined(F.struct("__bin", "__run"), F.sum("n_segments"))).drop("journey")
    return runs.where(~border).select(*ends.columns).unionByName(ends)
