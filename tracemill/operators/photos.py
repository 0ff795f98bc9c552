"""Photos around places and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import radius_join

DAY = 86_400


def distinct_photos(photos: DataFrame) -> DataFrame:
    """One row for each uid (a photo's files share it), the first by file; a place of (0, 0) is none."""
    nowhere = (F.col("lat") == 0) & (F.col("lon") == 0)
    first = photos.groupBy("tid", "uid").agg(F.min_by(F.struct("taken_ts", "lat", "lon"), F.struct("file", "taken_ts")).alias("p")).select("tid", "uid", "p.*")
    return first.withColumns({"lat": F.when(~nowhere, F.col("lat")), "lon": F.when(~nowhere, F.col("lon"))})


def near(spots: DataFrame, photos: DataFrame, radius: float = 300.0, most: int = 24) -> DataFrame:
    """spots: id, tid, lat, lon, start_ts, end_ts; photos: tid, uid, file, taken_ts, lat, lon. Returns id, uid, metres, rank: each spot's photos of
    its person within the radius, taken from the first to the last of its days (whole days, as a library's date filter has them), nearest first.

    Space and time are one equi-join: person, day and grid cell; spots are copied to the days and cells that they touch."""
    days = F.explode(F.sequence(F.floor(F.col("start_ts") / DAY), F.floor(F.greatest("start_ts", "end_ts") / DAY)))
    taken = distinct_photos(photos).where("lat is not null").withColumn("__day", F.floor(F.col("taken_ts") / DAY))
    dated = spots.select("id", "tid", "lat", "lon", days.alias("__day"))
    met = radius_join(taken, dated, radius, {"id": "id", "lat": "__lat", "lon": "__lon"}, ("tid", "__day")).select("id", "uid", F.round("metres", 1).alias("metres"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("metres", "uid"))
    return met.withColumn("rank", rank).where(F.col("rank") <= most)


def taken_between(spans: DataFrame, photos: DataFrame, most: int = 60) -> DataFrame:
    """spans: id, tid, start_ts, end_ts. Returns id, uid, taken_ts, lat, lon, rank: the first photos of a span's days, wherever they were taken (or nowhere)."""
    days = F.explode(F.sequence(F.floor(F.col("start_ts") / DAY), F.floor(F.greatest("start_ts", "end_ts") / DAY)))
    taken = distinct_photos(photos).withColumn("__day", F.floor(F.col("taken_ts") / DAY))
    met = taken.join(spans.select("id", "tid", days.alias("__day")), ["tid", "__day"])
    rank = F.row_number().over(Window.partitionBy("id").orderBy("taken_ts", "uid"))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "uid", "taken_ts", "lat", "lon", "rank")
