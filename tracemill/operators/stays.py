"""Pings to stays: trusted pings, stay-point clustering, merging of neighbouring stays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ACCURACY_MAX, EARTH_RADIUS, ISLAND_HOP, MERGE_GAP, MERGE_RADIUS, STAY_MIN, STAY_RADIUS
from ..functions.geo import metres
from ..shipping import ship_package
from ..storage import keeper
from .scan import islands

STAY = "tid long, start_ts long, end_ts long, lat double, lon double, point_count int"


def trusted(pings: DataFrame) -> DataFrame:
    """Pings of the tracker whose accuracy is unknown or good enough."""
    return pings.where((F.col("source") == "owntracks") & (F.col("acc").isNull() | (F.col("acc") <= ACCURACY_MAX)))


def ping_islands(pings: DataFrame, keys: tuple[str, ...] = ("tid",)) -> DataFrame:
    """Tracks of the keys cut where a hop is so long that no stay can span it: islands can be clustered apart, with equal results. Adds island and
    was (tst, lat, lon of the ping before)."""
    hop = metres("was.lat", "was.lon", "lat", "lon")
    return islands(pings, [*keys], "tst", ["id"], {"was": F.struct("tst", "lat", "lon")}, hop > ISLAND_HOP, width=86_400)


def _apart(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(math.sqrt(min(1.0, a)))


def clustered(group: pd.DataFrame) -> pd.DataFrame:
    """Stays of some islands: a run grows while the next ping is near the mean of the run so far; runs that last long enough
    are stays, after any other run the scan restarts one ping on."""
    out = []
    group = group.sort_values(["island", "tst", "id"])
    tid = int(group["tid"].iloc[0])
    every = [group[c].to_numpy() for c in ("lat", "lon", "tst")]
    cuts = np.flatnonzero(np.diff(group["island"].to_numpy())) + 1
    for lat, lon, t in zip(*(np.split(c, cuts) for c in every), strict=True):
        at, n = 0, len(t)
        while at < n and t[-1] - t[at] >= STAY_MIN:
            end, la, lo = at + 1, lat[at], lon[at]
            while end < n and _apart(la / (end - at), lo / (end - at), lat[end], lon[end]) <= STAY_RADIUS:
                la, lo, end = la + lat[end], lo + lon[end], end + 1
            if t[end - 1] - t[at] >= STAY_MIN:
                out.append((tid, int(t[at]), int(t[end - 1]), la / (end - at), lo / (end - at), end - at))
                at = end
            else:
                at += 1
    return pd.DataFrame(out, columns=["tid", "start_ts", "end_ts", "lat", "lon", "point_count"]).astype({"tid": np.int64, "start_ts": np.int64, "end_ts": np.int64, "lat": float, "lon": float, "point_count": np.int32})


def stays(pings: DataFrame) -> DataFrame:
    return clustered_islands(ping_islands(trusted(pings)))


def clustered_islands(pings: DataFrame, keys: tuple[str, ...] = ("tid",)) -> DataFrame:
    """Stays of pings with their island. Islands too short to hold a stay are left out first; the others go to Python by the thousand."""
    ship_package(pings.sparkSession)
    every = Window.partitionBy(*keys, "island")
    rows = pings.select(*keys, "island", "id", "tst", "lat", "lon")
    rows = rows.withColumn("span", F.max("tst").over(every) - F.min("tst").over(every)).where(F.col("span") >= STAY_MIN).drop("span")
    return rows.groupBy(*keys, F.floor(F.col("island") / 1000).alias("bundle")).applyInPandas(clustered, STAY)


def merged(candidates: DataFrame) -> DataFrame:
    """Neighbouring stays that are close in time and space become one, with the mean of their points as its place.

    Long gaps never merge, so each run between them is folded by itself, in order, by a higher-order function. Candidates are written first, as
    islands() looks at them twice and each look would cluster all pings again.
    """
    candidates = keeper(candidates.sparkSession, "stays")(candidates)
    runs = islands(candidates, ["tid"], "start_ts", ["end_ts"], {"before": F.col("end_ts")}, F.col("start_ts") - F.col("before") > MERGE_GAP, "run")
    kind = "array<struct<start_ts:bigint,end_ts:bigint,lat:double,lon:double,n:bigint>>"
    rows = runs.groupBy("tid", "run").agg(F.array_sort(F.collect_list(F.struct("start_ts", "end_ts", "lat", "lon", F.col("point_count").cast("long").alias("n")))).alias("rows"))

    def fold(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        total = last["n"] + x["n"]
        one = F.struct(last["start_ts"].alias("start_ts"), x["end_ts"].alias("end_ts"), ((last["lat"] * last["n"] + x["lat"] * x["n"]) / total).alias("lat"), ((last["lon"] * last["n"] + x["lon"] * x["n"]) / total).alias("lon"), total.alias("n"))
        near = (F.size(acc) > 0) & (x["start_ts"] - last["end_ts"] <= MERGE_GAP) & (metres(last["lat"], last["lon"], x["lat"], x["lon"]) <= MERGE_RADIUS)
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(acc, F.array(x)))

    folded = rows.select("tid", F.explode(F.aggregate("rows", F.array().cast(kind), fold)).alias("v"))
    return folded.select("tid", "v.start_ts", "v.end_ts", "v.lat", "v.lon", F.col("v.n").cast("int").alias("point_count"))
