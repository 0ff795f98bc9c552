"""Home periods, away runs and trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AWAY_GAP, BLANK_GAP, NEAR_HOME, TRIP_MIN
from ..functions.geo import metres
from . import scan
from .sequence import overlap_join


def with_home(visits: DataFrame, periods: DataFrame) -> DataFrame:
    """visits (id, tid, start_ts, end_ts, lat, lon) with home (id), home_m, away, near_home by the first of the person's periods that covers their start.

    Without a period a visit is neither away nor near home. periods carry tid; the join is on it, and a person has a handful.
    """
    p = periods.select("tid", F.col("id").alias("home"), F.col("start_ts").alias("p0"), F.col("end_ts").alias("p1"), F.col("lat").alias("hlat"), F.col("lon").alias("hlon"), "radius_m")
    covers = (F.col("p0").isNull() | (F.col("p0") <= F.col("start_ts"))) & (F.col("p1").isNull() | (F.col("start_ts") < F.col("p1")))
    first = F.min_by(F.struct("home", "hlat", "hlon", "radius_m"), "home")
    met = visits.select("id", "tid", "start_ts").join(p, "tid").where(covers).groupBy("id").agg(first.alias("h"))
    out = visits.join(met, "id", "left").withColumn("home_m", metres(F.col("lat"), F.col("lon"), F.col("h.hlat"), F.col("h.hlon")))
    return out.select(*visits.columns, F.col("h.home").alias("home"), "home_m", F.coalesce(F.col("home_m") > F.col("h.radius_m"), F.lit(False)).alias("away"), F.coalesce(F.col("home_m") <= NEAR_HOME, F.lit(False)).alias("near_home"))


def blank_seconds(gaps: DataFrame, segments: DataFrame) -> DataFrame:
    """gaps (tid, g0, g1 and more) with blank_s, the longest stretch of each that no segment covers."""
    s = segments.select("tid", F.col("start_ts").alias("s0"), F.col("end_ts").alias("s1"))
    met = overlap_join(gaps.select("tid", "g0", "g1").distinct(), s, ("g0", "g1"), ("s0", "s1"), ["tid"]).where("s0 < g1 and s1 > g0")
    order = Window.partitionBy("tid", "g0", "g1").orderBy("s0", "s1")
    covered = F.max(F.least("s1", "g1")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    hole = F.greatest("s0", "g0") - F.greatest(F.coalesce(covered, F.col("g0")), F.col("g0"))
    held = met.withColumn("hole", hole).groupBy("tid", "g0", "g1").agg(F.max("hole").alias("most"), F.max(F.least("s1", "g1")).alias("to"))
    return gaps.join(held, ["tid", "g0", "g1"], "left").withColumn("blank_s", F.when(F.col("most").isNull(), F.col("g1") - F.col("g0")).otherwise(F.greatest("most", F.col("g1") - F.col("to"), F.lit(0)))).drop("most", "to")


def trips(visits: DataFrame, segments: DataFrame, work: str = "Work") -> DataFrame:
    """visits as from with_home() with category, city, country, country_code, source. Returns tid, start_ts, end_ts, n_visits, primary_*.

    Visits at work are left out; a run of away visits ends at a visit that isn't away, at a long gap with either side near home, and
    at a gap whose longest uncovered stretch is over a day. Photo visits are trips of their own; visits of imported trips take no part (those trips come with them).
    """
    rows = visits.where((F.coalesce("category", F.lit("")) != work) & ~F.col("source").isin("kml_import", "photo_import"))
    lagged = {"g0": F.col("end_ts"), "was_away": F.col("away"), "was_near": F.col("near_home")}
    gap = F.col("start_ts") - F.col("g0")
    far = scan.running(rows.select("tid", "id", "start_ts", "end_ts", "away"), ["tid"], "start_ts", ["id"], {n: ("lag", lagged[n]) for n in ("g0", "was_away")})
    gaps = far.where(F.col("away") & F.col("was_away") & (gap > BLANK_GAP)).select("tid", "id", "g0", F.col("start_ts").alias("g1"))
    rows = rows.join(blank_seconds(gaps, segments).select("id", "blank_s"), "id", "left")
    new = F.col("away") & (~F.coalesce("was_away", F.lit(False)) | ((gap > AWAY_GAP) & (F.col("was_near") | F.col("near_home"))) | (F.coalesce("blank_s", F.lit(0)) > BLANK_GAP))
    cols = ["tid", "id", "start_ts", "end_ts", "city", "country", "country_code"]
    rows = rows.select(*cols, "away", "near_home", "blank_s")
    runs = scan.islands(rows, ["tid"], "start_ts", ["id"], lagged, new, "run").where("away").withColumn("own", F.lit(0).cast("long"))
    alone = visits.where(F.col("source") == "photo_import").withColumns({"run": F.lit(-1).cast("long"), "own": F.col("id")})
    every = runs.select("run", "own", *cols).unionByName(alone.select("run", "own", *cols))

    # first by run and name, then by run
    city, country = (F.nullif(c, F.lit("")) for c in ("city", "country"))
    named = F.coalesce(city, country)
    weight, at = F.greatest(F.col("end_ts") - F.col("start_ts"), F.lit(60)), F.struct("start_ts", "id")
    votes = every.withColumns({"kind": F.when(city.isNotNull(), 0).otherwise(1), "label": named}).groupBy("tid", "run", "own", "kind", "label").agg(
        F.sum(weight).alias("s"), F.min("start_ts").alias("seen"), F.max_by(F.struct("country", "country_code"), at).alias("c"), F.count("*").alias("n"), F.max(F.struct("start_ts", "id", "end_ts")).alias("last"))
    order = F.when(F.col("label").isNotNull(), F.struct("kind", -F.col("s"), "seen", "label"))
    spans = votes.groupBy("tid", "run", "own").agg(F.min("seen").alias("start_ts"), F.max("last").alias("last"), F.sum("n").alias("n_visits"), F.min_by(F.struct("kind", "label", "c"), order).alias("b"))
    out = spans.withColumn("end_ts", F.col("last.end_ts")).where(F.col("end_ts") - F.col("start_ts") >= TRIP_MIN)
    return out.select("tid", "start_ts", "end_ts", "n_visits", F.when(F.col("b.kind") == 0, F.col("b.label")).alias("primary_city"), F.col("b.c.country").alias("primary_country"), F.col("b.c.country_code").alias("primary_country_code"))
