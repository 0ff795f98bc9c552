"""Reports as nested documents: a day, a trip or a year of a person as one JSON text, and a sink for them.

Documents hold whole numbers and texts: seconds, metres rounded to whole ones, degrees in millionths. Lists are ordered, nulls are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import photos as photo_ops
from . import reports
from .reports import DAY_S

#: Seconds of the parts of a person's time that trips are dealt by: few trips lie in one part, and few reach over its border.
TRIP_PART = 16 * 7 * DAY_S


def listed(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str) -> DataFrame:
    """keys and `name`: the rows of each key as a list of structs of the columns, in order."""
    every = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v"))))
    return rows.groupBy(*keys).agg(every.alias("l")).select(*keys, F.col("l.v").alias(name))


def text_of(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("document")


def whole(column: str, times: int = 1) -> Column:
    return F.bround(F.col(column) * times, 0).cast("long")


def _empty(out: DataFrame, parts: list[DataFrame], keys: list[str], names: list[str]) -> DataFrame:
    for part, name in zip(parts, names, strict=True):
        out = out.join(part, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def _first_day(ts: Column) -> Column:
    return F.floor(ts / DAY_S) * DAY_S


def _days_end(ts: Column) -> Column:
    return (F.floor(ts / DAY_S) + 1) * DAY_S


def _happened(visits: DataFrame, places: DataFrame, segments: DataFrame, photos: DataFrame) -> DataFrame:
    """Visits with their places, legs and photos in one table, dealt by person and part: tid, __part, at, until and, each null in rows of the others,
    the structs visit, leg and photo (what has no struct takes next to no room)."""
    p = places.select(F.col("id").alias("place_id"), F.col("name").alias("place_name"), "category", "city", whole("lat", 1_000_000).alias("lat_e6"), whole("lon", 1_000_000).alias("lon_e6"))
    seen = visits.select("tid", "place_id", F.col("id").alias("vid"), F.col("start_ts").alias("at"), F.col("end_ts").alias("until")).join(p, "place_id", "left")
    kinds = [
        seen.select("tid", "at", "until", F.struct("vid", "place_name", "category", "city", "lat_e6", "lon_e6").alias("visit")),
        segments.select("tid", F.col("start_ts").alias("at"), F.col("end_ts").alias("until"), F.struct("k1", "k2", whole("distance_m").alias("metres"), "mode").alias("leg")),
        photo_ops.distinct_photos(photos.withColumn("file", F.lit(""))).select("tid", F.col("taken_ts").alias("at"), F.struct("uid").alias("photo")),
    ]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), kinds).where("tid is not null and at is not null")
    return every.withColumn("__part", F.floor(F.col("at") / TRIP_PART)).repartition("tid", "__part")


def _listed(trips: DataFrame, happened: DataFrame) -> DataFrame:
    """trips: tid, __part, id, trip (start_ts, end_ts and what else is shown). For each the visits that start in it, the legs that lie in it and
    the photos of its days, as lists, out of what happened in its __part. Both sides are dealt alike, so nothing more is shuffled; what
    happened is listed once for all trips of a part, since pairs with trips are more and wider rows to sort."""
    of = lambda kind, *columns: F.collect_list(F.when(F.col(kind).isNotNull(), F.struct(*columns)))
    lists = {
        "visits": of("visit", "at", "visit.vid", "until", "visit.place_name", "visit.category", "visit.city", "visit.lat_e6", "visit.lon_e6"),
        "legs": of("leg", "at", "leg.k1", "leg.k2", "leg.metres", "until", "leg.mode"),
        "photos": of("photo", "at", "photo.uid"),
    }
    start, end = F.col("trip.start_ts"), F.col("trip.end_ts")
    mine = {
        "visits": lambda v: (v["at"] >= start) & (v["at"] < end),
        "legs": lambda g: (g["at"] >= start) & (g["at"] <= end) & (g["until"] <= end),
        "photos": lambda p: (p["at"] >= _first_day(start)) & (p["at"] < _days_end(end)),
    }
    rows = trips.join(happened.groupBy("tid", "__part").agg(*[v.alias(c) for c, v in lists.items()]), ["tid", "__part"], "left")
    kept = {c: F.coalesce(F.when(F.col("id").isNotNull(), F.filter(c, w)), F.array().cast(rows.schema[c].dataType)) for c, w in mine.items()}
    return rows.withColumns(kept)


def _told(lists: DataFrame) -> DataFrame:
    """The documents of trips with their lists of visits, legs and photos; a photo goes to the first visit that it falls into."""
    first = lambda p: F.get(F.filter("visits", lambda v: (p["at"] >= v["at"]) & (p["at"] <= v["until"])), F.lit(0))
    held = lists.withColumns({c: F.sort_array(c) for c in ("visits", "legs", "photos")})
    held = held.withColumn("photos", F.transform("photos", lambda p: F.struct(p["uid"].alias("uid"), p["at"].alias("taken_ts"), first(p)["vid"].alias("vid"))))
    shots = lambda which: F.transform(F.filter("photos", which), lambda p: F.struct(p["uid"].alias("uid"), p["taken_ts"].alias("taken_ts")))
    place = lambda v: [v[c].alias(c) for c in ("place_name", "category", "city", "lat_e6", "lon_e6")]
    visits = F.transform("visits", lambda v: F.struct(v["vid"].alias("vid"), v["at"].alias("from_ts"), v["until"].alias("to_ts"), *place(v), shots(lambda p: p["vid"] == v["vid"]).alias("photos")))
    legs = F.transform("legs", lambda g: F.struct(g["k1"].alias("k1"), g["at"].alias("from_ts"), g["until"].alias("to_ts"), g["mode"].alias("mode"), g["metres"].alias("metres")))
    days = F.greatest(F.lit(1), F.floor((F.col("trip.end_ts") - F.col("trip.start_ts")) / DAY_S) + 1).cast("long").alias("days")
    head = ["id", "trip.name", "trip.start_ts", "trip.end_ts", days, "trip.primary_city", "trip.primary_country", "trip.primary_country_code"]
    return held.select("tid", "id", text_of(*head, visits.alias("visits"), legs.alias("legs"), shots(lambda p: p["vid"].isNull()).alias("photos")))


def trip_documents(trips: DataFrame, visits: DataFrame, places: DataFrame, segments: DataFrame, photos: DataFrame) -> DataFrame:
    """tid, id, document of each trip: what it is, its visits with their places, its legs, and the photos of its days that fall into no visit;
    those that do are with the first visit they fall into.

    Trips and what happens on them are shuffled once, by person and sixteen weeks, and become documents where they lie. Only trips that
    reach over such a border are listed on each side of it, and these lists shuffled by trip to be joined."""
    first, last = (F.floor(x / TRIP_PART) for x in (_first_day(F.col("start_ts")), _days_end(F.col("end_ts")) - 1))
    crosses = F.coalesce(first < last, F.lit(False))
    shown = F.struct("start_ts", "end_ts", "name", "primary_city", "primary_country", "primary_country_code").alias("trip")
    dealt = lambda rows, part: rows.select("tid", part.alias("__part"), "id", shown).repartition("tid", "__part")
    happened = _happened(visits, places, segments, photos)
    one = _listed(dealt(trips.where(~crosses), first), happened)
    more = _listed(dealt(trips.where(crosses), F.explode(F.sequence(first, last))), happened)
    more = more.groupBy("tid", "id", "trip").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("visits", "legs", "photos")])
    return _told(one).unionByName(_told(more))


def day_documents(visits: DataFrame, segments: DataFrame, places: DataFrame, photos: DataFrame, at: int = reports.A_DAY) -> DataFrame:
    """tid, document of the day that starts at `at`, for each person with a visit, a segment or a photo on it: its timeline, totals by mode, the
    places before and after it, and its photos."""
    line = reports.day_timeline(visits, segments, places, at).select("tid", "type", "id", "start_ts", "end_ts", "place_name", "category", "city", "mode", whole("distance_m").alias("metres"))
    modes = reports.day_modes(segments, at).select("tid", "mode", whole("distance_m").alias("metres"), whole("duration_s").alias("seconds"))
    around = reports.context_visits(visits, at).join(visits.select("id", "place_id"), "id")
    around = around.join(places.select(F.col("id").alias("place_id"), "name", "city", whole("lat", 1_000_000).alias("lat_e6"), whole("lon", 1_000_000).alias("lon_e6")), "place_id", "left")
    day = visits.select("tid").union(segments.select("tid")).union(photos.select("tid")).distinct().select("tid", F.col("tid").alias("id"), F.lit(at).alias("start_ts"), F.lit(at + DAY_S - 1).alias("end_ts"))
    shots = photo_ops.taken_between(day, photos.withColumn("file", F.lit(""))).select(F.col("id").alias("tid"), "uid", "taken_ts", whole("lat", 1_000_000).alias("lat_e6"), whole("lon", 1_000_000).alias("lon_e6"))
    columns = [c for c in line.columns if c != "tid"]
    parts = [
        listed(line, ["tid"], ["start_ts", "type", "id", "end_ts", "metres"], columns, "timeline"),
        listed(modes, ["tid"], ["mode"], ["mode", "metres", "seconds"], "modes"),
        listed(around, ["tid"], ["at_ts", "id"], ["side", "id", "at_ts", "name", "city", "lat_e6", "lon_e6"], "around"),
        listed(shots, ["tid"], ["taken_ts", "uid"], ["uid", "taken_ts", "lat_e6", "lon_e6"], "photos"),
    ]
    who = line.select("tid").union(shots.select("tid")).distinct()
    whole_day = _empty(who, parts, ["tid"], ["timeline", "modes", "around", "photos"])
    return whole_day.select("tid", text_of("timeline", "modes", "around", "photos"))


def year_documents(trips: DataFrame, visits: DataFrame, places: DataFrame, segments: DataFrame) -> DataFrame:
    """tid, year, document: a person's review of each year, with the names of the countries that were new in it."""
    rows = reports.wrapped_years(trips, visits, places, segments)
    coded = reports.placed(visits, places).where("country_code is not null").groupBy("tid", "country_code").agg(F.min("start_ts").alias("t"), F.max("country").alias("country"))
    new = listed(coded.withColumn("year", reports.year("t")), ["tid", "year"], ["t", "country_code"], ["country_code", "country"], "new_countries")
    out = _empty(rows, [new], ["tid", "year"], ["new_countries"])
    picks = [whole("distance_m").alias("metres"), whole("prev_distance_m").alias("prev_metres"), "trip_days", "period_days", "city", whole("city_days").alias("city_days"), "longest_trip", whole("longest_days").alias("longest_days"), "n_countries", whole("percent_of_world").alias("percent_of_world"), "new_countries", "mode", whole("mode_m").alias("mode_metres"), "moon_trips"]
    return out.select("tid", "year", F.to_json(F.struct(*picks), {"ignoreNullFields": "false"}).alias("document"))


def written(documents: DataFrame, path: str, parts: int = 64) -> None:
    """Writes documents as lines of JSON, in a folder for each of `parts` shares of the people (part=hash of tid), a person's in one file."""
    share = F.pmod(F.xxhash64("tid"), F.lit(parts)).cast("int")
    line = F.concat(F.lit('{"tid":'), F.col("tid").cast("string"), F.lit(',"document":'), F.col("document"), F.lit("}"))
    documents.select(line.alias("value"), share.alias("part"), "tid").repartition("part").sortWithinPartitions("part", "tid").select("value", "part").write.partitionBy("part").text(path)
