"""Deriving again only what an edit touches: legs and trips between the nearest marks on either side of a change; the rest is kept.

A change is a span of time of one person (tid, a, b) inside which visits, segments, pings or home periods are not what they were. A mark is
a time that no derived row crosses, before the change as after it; what lies between the last mark before a change and the first one after
it is its zone. Old rows that start in a zone go, rows derived from the zone's input come in their place. The result equals a full rebuild.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import away, legs, scan
from .sequence import asof, overlap_join

#: Before and after all times (seconds).
START, END = -(1 << 40), 1 << 40


def changes_of(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """tid, a, b: the spans (start_ts, end_ts) of rows of which one of two versions of a table lacks the keys. Keys must tell versions of a row apart."""
    one = lambda x, y: x.join(y.select(*keys), keys, "left_anti").select("tid", F.col("start_ts").alias("a"), F.col("end_ts").alias("b"))
    return one(before, after).unionByName(one(after, before))


def period_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """tid, a, b: the spans of home periods (tid, start_ts, end_ts, lat, lon, radius_m) that are in one version only; open ends reach as far as time does."""
    cols = ["tid", "start_ts", "end_ts", "lat", "lon", "radius_m"]
    x, y = before.select(*cols), after.select(*cols)
    both = x.exceptAll(y).unionByName(y.exceptAll(x))
    return both.select("tid", F.coalesce("start_ts", F.lit(START)).alias("a"), F.coalesce("end_ts", F.lit(END)).alias("b"))


def zones(changes: DataFrame, marks: DataFrame, stored) -> DataFrame:
    """tid, lo, hi: from the last mark (tid, at) before each change to the first one after it, both included; zones that meet are one."""
    asked = changes.select("tid", (F.least("a", "b") - 1).alias("__a"), (F.greatest("a", "b") + 1).alias("__b")).distinct()
    low = asof(stored(asked), marks, "__a", "at", [], ["tid"]).withColumnRenamed("asof", "__low")
    both = asof(low, marks, "__b", "at", [], ["tid"], forward=True)
    spans = stored(both.select("tid", F.coalesce("__low.at", F.lit(START)).alias("lo"), F.coalesce("asof.at", F.lit(END)).alias("hi")).distinct())
    spans = scan.running(spans, ["tid"], "lo", ["hi"], {"__upto": ("max_before", F.col("hi"))})
    spans = scan.islands(spans, ["tid"], "lo", ["hi"], {}, F.col("lo") > F.coalesce("__upto", F.lit(START - 1)), "zone")
    return spans.groupBy("tid", "zone").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("zone")


def in_zones(rows: DataFrame, ts: str, spans: DataFrame, closed: bool = True) -> DataFrame:
    """rows (tid, ts) with the zone (its lo) they are in, null outside; closed: a zone's last moment belongs to it. Zones of a tid don't meet."""
    out = asof(rows, spans, ts, "lo", ["hi"], ["tid"])
    inside = F.col(ts) <= F.col("asof.hi") if closed else F.col(ts) < F.col("asof.hi")
    return out.withColumn("zone", F.when(inside, F.col("asof.at"))).drop("asof")


def trips(old: DataFrame, visits: DataFrame, segments: DataFrame, periods: DataFrame, changes: DataFrame, stored, work: str = "Work") -> DataFrame:
    """Trips after an edit, as away.trips() gives them for all visits. old: the trips before; visits (with category, city, country, country_code,
    source), segments and periods as they are now; changes: all spans where they differ from before.

    Marks are times at which nothing but visits at home stands, whichever run comes before or after. `stored` writes a table and reads it back."""
    changes = stored(changes)
    people = changes.select("tid").distinct()
    mine = visits.join(people, "tid", "left_semi")
    homed = stored(away.with_home(mine, periods.join(people, "tid", "left_semi")))
    kept = homed.where((F.coalesce("category", F.lit("")) != work) & ~F.col("source").isin("kml_import", "photo_import"))
    marks = kept.groupBy("tid", F.col("start_ts").alias("at")).agg(F.max("away").alias("__away")).where("not __away").drop("__away")
    spans = stored(zones(changes, stored(marks), stored))
    again = stored(in_zones(homed, "start_ts", spans).where("zone is not null").drop("zone"))
    fresh = away.trips(again, segments.join(people, "tid", "left_semi"), work)
    stays = in_zones(old, "start_ts", spans).where("zone is null").drop("zone")
    return stays.unionByName(fresh.select(*old.columns))


def segments(old: DataFrame, visits: DataFrame, pings: DataFrame, changes: DataFrame, stored) -> DataFrame:
    """Legs after an edit, as legs.segments() gives them for all visits and pings. old: the legs before; changes: spans where visits or pings differ.

    Marks are the starts of visits: a leg reaches from one visit to the next. Zones are derived apart, so no leg spans two of them."""
    changes = stored(changes)
    people = changes.select("tid").distinct()
    mine = visits.join(people, "tid", "left_semi")
    spans = stored(zones(changes, stored(mine.select("tid", F.col("start_ts").alias("at")).distinct()), stored))
    apart = F.struct("tid", "zone").alias("tid")
    again = stored(in_zones(mine, "start_ts", spans).where("zone is not null").select(apart, "start_ts", "end_ts"))
    rest = [c for c in pings.columns if c != "tid"]
    heard = stored(in_zones(pings.join(people, "tid", "left_semi"), "tst", spans).where("zone is not null").select(apart, *rest))
    fresh = legs.segments(again, heard).withColumn("tid", F.col("tid.tid"))
    stays = in_zones(old, "start_ts", spans, closed=False).where("zone is null").drop("zone")
    return stays.unionByName(fresh.select(*old.columns))


def accepted(visits: DataFrame, segments: DataFrame, added: DataFrame) -> DataFrame:
    """tid, a, b: the spans that manual visits (added: tid, start_ts, end_ts, those that overlays.manual_visit() took) change: their own, and
    those of the tracked and manual rows that they overlap."""
    v = added.select("tid", F.col("start_ts").alias("__s"), F.col("end_ts").alias("__e"))
    spans = [added.select("tid", F.col("start_ts").alias("a"), F.col("end_ts").alias("b"))]
    for rows in (visits, segments):
        met = overlap_join(rows.where(F.col("source").isin("owntracks", "manual")).select("tid", "start_ts", "end_ts"), v, ("start_ts", "end_ts"), ("__s", "__e"), ["tid"])
        spans.append(met.select("tid", F.col("start_ts").alias("a"), F.col("end_ts").alias("b")))
    return reduce(DataFrame.unionByName, spans)
