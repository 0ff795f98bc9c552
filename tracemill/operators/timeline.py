"""A day's timeline and drawing helpers: flanks, closing visits, chunks, slices of a line by its length, calendar cells.

All rows carry tid, the person; sequences are numbered and searched inside one tid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import metres
from .sequence import islands


def merged_timeline(visits: DataFrame, segments: DataFrame) -> DataFrame:
    """Visits and segments (id, start_ts, end_ts and more) as one sequence by start; at equal starts visits come first. Adds kind and position."""
    both = visits.withColumns({"kind": F.lit("visit"), "rank": F.lit(0)}).unionByName(segments.withColumns({"kind": F.lit("segment"), "rank": F.lit(1)}), allowMissingColumns=True)
    return both.withColumn("position", F.row_number().over(Window.partitionBy("tid").orderBy("start_ts", "rank", "id")))


def flanks(timeline: DataFrame) -> DataFrame:
    """Each segment with the ids of the nearest visits before and after it by position."""
    w, back = (Window.partitionBy("tid").orderBy(c) for c in ("position", F.desc("position")))
    visit = F.when(F.col("kind") == "visit", F.col("id"))
    marked = timeline.withColumns({"before": F.last(visit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "after": F.last(visit, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))})
    return marked.where("kind = 'segment'").drop("kind", "rank")


def with_closing_visit(timeline: DataFrame, visits: DataFrame) -> DataFrame:
    """Where a person's last entry is a segment, the first visit with a place that covers its end (both ends included) is put after it, from there to the visit's end."""
    last = timeline.groupBy("tid").agg(F.max(F.struct("position", "kind", "end_ts")).alias("l")).where("l.kind = 'segment'").select("tid", F.col("l.end_ts").alias("__at"), (F.col("l.position") + 1).alias("position"))
    over = visits.where("place_id is not null").join(last, "tid").where((F.col("start_ts") <= F.col("__at")) & (F.col("end_ts") >= F.col("__at")))
    first = over.groupBy("tid").agg(F.min_by(F.struct(*[c for c in over.columns if c != "tid"]), F.struct("start_ts", "id")).alias("v")).select("tid", "v.*")
    closing = first.withColumns({"start_ts": F.col("__at"), "kind": F.lit("visit"), "rank": F.lit(0)}).drop("__at")
    return timeline.unionByName(closing, allowMissingColumns=True)


def chunks(points: DataFrame, keys: list[str], size: int = 10) -> DataFrame:
    """Points (with idx from 0) in chunks of `size` that overlap by one: adds chunk; a shared point has a row in both."""
    step = size - 1
    own = F.floor(F.col("idx") / step)
    points = points.withColumn("__n", F.max("idx").over(Window.partitionBy(*keys)))
    shared = (F.col("idx") % step == 0) & (F.col("idx") > 0)
    lists = F.when(shared & (F.col("idx") == F.col("__n")), F.array(own - 1)).when(shared, F.array(own - 1, own)).otherwise(F.array(own))
    return points.withColumn("chunk", F.explode(lists)).drop("__n")


def along(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points in order of idx with `upto`, the length of the line to them, and `total`."""
    w = Window.partitionBy(*keys).orderBy("idx")
    hop = F.coalesce(metres(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    rows = points.withColumn("hop", hop).withColumn("upto", F.sum("hop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("total", F.max("upto").over(Window.partitionBy(*keys))).drop("hop")


def at_share(points: DataFrame, keys: list[str], share: Column | float) -> DataFrame:
    """The point at a share of each line's length, by linear interpolation."""
    w = Window.partitionBy(*keys).orderBy("idx")
    rows = along(points, keys)
    want = F.col("total") * share
    rows = rows.withColumns({"n_upto": F.lead("upto").over(w), "n_lat": F.lead("lat").over(w), "n_lon": F.lead("lon").over(w), "want": want})
    hit = rows.where((F.col("upto") <= F.col("want")) & (F.col("n_upto").isNull() | (F.col("want") < F.col("n_upto"))))
    f = F.coalesce((F.col("want") - F.col("upto")) / F.nullif(F.col("n_upto") - F.col("upto"), F.lit(0.0)), F.lit(0.0))
    return hit.select(*keys, (F.col("lat") + f * (F.coalesce("n_lat", "lat") - F.col("lat"))).alias("lat"), (F.col("lon") + f * (F.coalesce("n_lon", "lon") - F.col("lon"))).alias("lon"))


def shares_of_span(segments: DataFrame) -> DataFrame:
    """Consecutive segments (tid, position, before, after, distance_m) with the same flanks share one line: from_share and to_share by distance."""
    w = Window.partitionBy("tid").orderBy("position")
    same = (F.col("before").eqNullSafe(F.lag("before").over(w))) & (F.col("after").eqNullSafe(F.lag("after").over(w)))
    rows = islands(segments.withColumn("__same", same), ["tid"], ["position"], ~F.col("__same"), "span").drop("__same")
    run = Window.partitionBy("tid", "span").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("distance_m").over(Window.partitionBy("tid", "span"))
    upto = F.sum("distance_m").over(run)
    return rows.withColumns({"from_share": F.coalesce((upto - F.col("distance_m")) / F.nullif(total, F.lit(0.0)), F.lit(0.0)), "to_share": F.coalesce(upto / F.nullif(total, F.lit(0.0)), F.lit(1.0))})


def calendar_cell(day: Column) -> tuple[Column, Column]:
    """(week, weekday) of a date in a Monday-first calendar of its year."""
    first = F.trunc(day, "year")
    offset = F.weekday(first)
    n = F.date_diff(day, first)
    return F.floor((n + offset) / 7).cast("int"), F.weekday(day)


def tracked(spans: DataFrame, pings: DataFrame) -> DataFrame:
    """spans (tid, start_ts, end_ts) in which the tid has a ping, both ends included; matched through the day bins a span touches."""
    days = F.explode(F.sequence(F.floor(F.col("start_ts") / 86400), F.floor(F.greatest("start_ts", "end_ts") / 86400)))
    seen = pings.select("tid", F.col("tst").alias("__t"), F.floor(F.col("tst") / 86400).alias("__day"))
    seen = seen.groupBy("tid", "__day").agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"), F.sort_array(F.collect_set(F.col("__t"))).alias("__all"))
    dated = spans.select("tid", "start_ts", "end_ts").distinct().withColumn("__day", days).join(seen, ["tid", "__day"])
    inside = F.exists("__all", lambda t: (t >= F.col("start_ts")) & (t <= F.col("end_ts")))
    hit = dated.where((F.col("__first") <= F.col("end_ts")) & (F.col("__last") >= F.col("start_ts"))).where(inside).select("tid", "start_ts", "end_ts").distinct()
    return spans.join(hit, ["tid", "start_ts", "end_ts"], "left_semi").select(*spans.columns)
