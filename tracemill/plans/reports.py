"""The reports: DataFrame expressions over visits, places, segments, trips, photos, home periods and pings of many people.

Every table carries tid, the person, and every report has rows for each person: totals are aggregations by tid, records are
min_by over explicit tie keys, sequences are windows inside one tid, intervals meet through time bins. `now` (unix seconds) is the
latest visit's end unless given. Rounding is half-even.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MERGE_GAP, MOON_DISTANCE, PHOTO_DISTANCE, PHOTO_GAP, SPEED_CEILINGS, WORLD_COUNTRIES, YEAR_DAYS
from ..functions.geo import metres
from ..operators import legs, places as place_ops, scan, sequence
from ..storage import keeper
from .fixtures import MODES

BIRTH = -315619200  # 1960-01-01, the fixtures' date of birth
DAY_S, WEEK_S = 86400, 7 * 86400
DECADE_S = int(10 * YEAR_DAYS * DAY_S)
A_DAY = 883785600  # 1998-01-03, the day that the day reports show
SEGMENT_KEYS = ["k1", "k2", "k3", "k4", "distance_m"]
SIX = 6  # months in a trend
TRIP_BIN = 365 * DAY_S  # trips of a person are dealt by year
MIN_METRES, MIN_SECONDS = 160.9344, 60  # fixed values: what shows as more than zero
STORY_EXCLUDES = ("Home", "Streets and roads", "Other places")
FAST_FLIGHTS = 30  # fixed value: flights whose ends are looked up

REPORTS: dict[str, Callable[..., DataFrame]] = {}
INPUTS: dict[str, tuple[str, ...]] = {}


def report(*inputs: str):
    """Registers a report; inputs are the frames that it takes, in order."""

    def keep(f):
        REPORTS[f.__name__], INPUTS[f.__name__] = f, inputs
        return f

    return keep


# -- helpers ---------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date(ts) -> Column:
    return F.date_from_unix_date(F.floor(_col(ts) / DAY_S).cast("int"))


def day(ts) -> Column:
    return date(ts).cast("string")


def month(ts) -> Column:
    return F.date_format(date(ts), "yyyy-MM")


def year(ts) -> Column:
    return F.year(date(ts))


def midnight(y: Column) -> Column:
    """Unix seconds of the start of a year."""
    return F.unix_date(F.make_date(y, F.lit(1), F.lit(1))).cast("long") * DAY_S


def ceil_days(seconds: Column) -> Column:
    return F.floor((seconds + (DAY_S - 1)) / DAY_S)


def dwell(end: str = "end_ts", start: str = "start_ts") -> Column:
    return F.greatest(F.col(end) - F.col(start), F.lit(0))


def top(rows: DataFrame, keys: list[str], order: list[Column], *cols: str) -> DataFrame:
    """The first row of each key by order (ascending)."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in cols])


def now_of(visits: DataFrame) -> int:
    return visits.agg(F.max("end_ts")).first()[0] or 0


def placed(visits: DataFrame, places: DataFrame) -> DataFrame:
    """Visits with their place's columns; visits without a place go."""
    p = places.select(F.col("id").alias("place_id"), "name", "category", "city", "country", "country_code", "raw_json", "lat", "lon")
    return visits.join(p, "place_id")


def during(events: DataFrame, at: str, spans: DataFrame) -> DataFrame:
    """Pairs of an event and a span (start_ts, end_ts) of the same tid with start_ts <= at < end_ts, through bins of two weeks:
    trips last days, and in bins of a day each would be shuffled once for each of them."""
    width = 2 * WEEK_S
    binned = spans.where("end_ts > start_ts").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start_ts") / width), F.floor((F.col("end_ts") - 1) / width))))
    met = events.withColumn("__bin", F.floor(F.col(at) / width)).join(binned, ["tid", "__bin"])
    return met.where((F.col(at) >= F.col("start_ts")) & (F.col(at) < F.col("end_ts"))).drop("__bin")


def in_month(rows: DataFrame, y: int, m: int | None = None, ts: str = "start_ts") -> DataFrame:
    """Rows whose ts lies in a year, or in a month of it, as a plain range on ts that reaches the scan."""
    from calendar import timegm

    low, high = ((y, m or 1), (y + 1, 1) if m is None or m == 12 else (y, m + 1))
    low, high = (timegm((a, b, 1, 0, 0, 0)) for a, b in (low, high))
    return rows.where((F.col(ts) >= low) & (F.col(ts) < high))


def mode_rank(mode: str = "mode") -> Column:
    known = F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col(mode))
    return F.when(known > 0, known - 1).otherwise(len(MODES))


def people(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select("tid") for f in frames]).distinct()


# -- visits by time --------------------------------------------------------------------------------


@report("visits")
def visit_month_density(visits: DataFrame) -> DataFrame:
    """Every month from the first to the last one with visits."""
    seen = visits.groupBy("tid", F.trunc(date("start_ts"), "month").alias("first_day")).agg(F.count("*").alias("n"), F.min("start_ts").alias("min_ts"), F.max("start_ts").alias("max_ts"))
    spine = seen.groupBy("tid").agg(F.sequence(F.min("first_day"), F.max("first_day"), F.expr("interval 1 month")).alias("m")).select("tid", F.explode("m").alias("first_day"))
    return spine.join(seen, ["tid", "first_day"], "left").select("tid", F.date_format("first_day", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n_visits"), "min_ts", "max_ts")


def _busiest(rows: DataFrame, unit: Column, name: str, count: str) -> DataFrame:
    counts = rows.groupBy("tid", unit.alias(name)).agg(F.count("*").alias(count))
    return top(counts, ["tid"], [-F.col(count), F.col(name)], name, count)


@report("visits")
def busiest_day(visits: DataFrame) -> DataFrame:
    return _busiest(visits, day("start_ts"), "day", "n_visits")


@report("visits")
def busiest_month(visits: DataFrame) -> DataFrame:
    return _busiest(visits, month("start_ts"), "month", "n_visits")


@report("visits")
def peak_month(visits: DataFrame) -> DataFrame:
    """The chart's peak and range: months without visits in between count as inactive."""
    months = visit_month_density(visits)
    best = top(months, ["tid"], [-F.col("n_visits"), F.col("month")], "month", "n_visits").withColumnsRenamed({"month": "peak_month", "n_visits": "peak_visits"})
    return months.groupBy("tid").agg(F.sum("n_visits").alias("n_visits"), F.count_if(F.col("n_visits") > 0).alias("active_months"), F.min("month").alias("first_month"), F.max("month").alias("last_month")).join(best, "tid")


@report("trips")
def busiest_trip_year(trips: DataFrame) -> DataFrame:
    return _busiest(trips, year("start_ts"), "year", "n_trips")


def _spread(who: DataFrame, low: int, high: int, name: str) -> DataFrame:
    return who.select("tid", F.explode(F.sequence(F.lit(low), F.lit(high))).alias(name))


@report("segments", "visits")
def seasonality(segments: DataFrame, visits: DataFrame) -> DataFrame:
    d = segments.groupBy("tid", F.month(date("start_ts")).alias("month_of_year")).agg(F.sum("distance_m").alias("d"))
    v = visits.groupBy("tid", F.month(date("start_ts")).alias("month_of_year")).agg(F.count("*").alias("n"))
    rows = _spread(people(segments, visits), 1, 12, "month_of_year").join(d, ["tid", "month_of_year"], "left").join(v, ["tid", "month_of_year"], "left")
    return rows.select("tid", "month_of_year", F.round(F.coalesce("d", F.lit(0.0)), 2).alias("distance_m"), F.coalesce("n", F.lit(0)).alias("n_visits"))


@report("trips")
def weekday_pattern(trips: DataFrame) -> DataFrame:
    ends = trips.select("tid", F.explode(F.array(*[F.struct((F.dayofweek(date(c)) - 1).alias("weekday"), F.lit(c == "start_ts").alias("leaves")) for c in ("start_ts", "end_ts")])).alias("e")).select("tid", "e.*")
    n = ends.groupBy("tid", "weekday").agg(F.count_if("leaves").alias("departures"), F.count_if(~F.col("leaves")).alias("returns"))
    return _spread(people(trips), 0, 6, "weekday").join(n, ["tid", "weekday"], "left").fillna(0, ["departures", "returns"])


@report("segments", "visits")
def yearly_trend(segments: DataFrame, visits: DataFrame) -> DataFrame:
    both = segments.select("tid", year("start_ts").alias("year"), "distance_m", F.lit(0).alias("v")).unionByName(visits.select("tid", year("start_ts").alias("year"), F.lit(0.0).alias("distance_m"), F.lit(1).alias("v")))
    n = both.groupBy("tid", "year").agg(F.sum("distance_m").alias("d"), F.sum("v").alias("n"))
    spine = n.groupBy("tid").agg(F.sequence(F.min("year"), F.max("year")).alias("y")).select("tid", F.explode("y").alias("year"))
    return spine.join(n, ["tid", "year"], "left").select("tid", "year", F.round(F.coalesce("d", F.lit(0.0)), 2).alias("distance_m"), F.coalesce("n", F.lit(0)).alias("n_visits"))


@report("visits", "places")
def night_owl(visits: DataFrame, places: DataFrame) -> DataFrame:
    """The visit that starts latest in a night, noon to noon, by the minute; of equal ones the first."""
    minute = F.floor(F.pmod("start_ts", F.lit(DAY_S)) / 60)
    rows = visits.withColumn("minute", minute).withColumn("late", F.when(minute >= 720, minute).otherwise(minute + 1440))
    best = top(rows, ["tid"], [-F.col("late"), F.col("id")], "id", "minute", "start_ts", "place_id")
    named = best.join(places.select(F.col("id").alias("place_id"), F.col("name").alias("place_name"), "city"), "place_id", "left")
    return named.select("tid", "id", F.format_string("%02d:%02d", F.floor(F.col("minute") / 60), F.col("minute") % 60).alias("time"), day("start_ts").alias("day"), "place_name", "city")


@report("visits")
def longest_day_out(visits: DataFrame) -> DataFrame:
    days = visits.groupBy("tid", day("start_ts").alias("day")).agg((F.max("start_ts") - F.min("start_ts")).alias("seconds"), F.count("*").alias("n")).where("n > 1")
    return top(days, ["tid"], [-F.col("seconds"), F.col("day")], "day", "seconds")


# -- places ----------------------------------------------------------------------------------------


def _most_visited(visits: DataFrame, places: DataFrame, *where: Column) -> DataFrame:
    rows = placed(visits, places).where(F.col("name").isNotNull())
    n = reduce(lambda r, w: r.where(w), where, rows).groupBy("tid", "place_id", "name", "city", "category").agg(F.count("*").alias("n_visits"))
    return top(n, ["tid"], [-F.col("n_visits"), F.col("place_id")], "place_id", "name", "city", "category", "n_visits")


@report("visits", "places")
def most_visited_place(visits: DataFrame, places: DataFrame) -> DataFrame:
    return _most_visited(visits, places)


@report("visits", "places")
def most_visited_airport(visits: DataFrame, places: DataFrame) -> DataFrame:
    return _most_visited(visits, places, F.col("category") == "Airports")


@report("visits", "places")
def most_visited_station(visits: DataFrame, places: DataFrame) -> DataFrame:
    return _most_visited(visits, places, F.col("category") == "Transport")


@report("visits", "places")
def most_visited_country(visits: DataFrame, places: DataFrame) -> DataFrame:
    n = placed(visits, places).where("country_code is not null").groupBy("tid", "country_code").agg(F.max("country").alias("country"), F.count("*").alias("n_visits"))
    return top(n, ["tid"], [-F.col("n_visits"), F.col("country_code")], "country_code", "country", "n_visits")


@report("visits", "places")
def most_visited_city(visits: DataFrame, places: DataFrame) -> DataFrame:
    n = placed(visits, places).where("city is not null").groupBy("tid", "city").agg(F.count("*").alias("n_visits"))
    return top(n, ["tid"], [-F.col("n_visits"), F.col("city")], "city", "n_visits")


@report("visits", "places", "segments")
def totals(visits: DataFrame, places: DataFrame, segments: DataFrame) -> DataFrame:
    """Countries and cities are those of all places, visited or not."""
    p = places.groupBy("tid").agg(F.count_distinct("country_code").alias("n_countries"), F.count_distinct("city").alias("n_cities"))
    rows = people(visits, places, segments).join(visits.groupBy("tid").agg(F.count("*").alias("n_visits")), "tid", "left").join(p, "tid", "left")
    rows = rows.join(segments.groupBy("tid").agg(F.round(F.sum("distance_m"), 2).alias("distance_m")), "tid", "left").fillna(0)
    return rows.withColumn("percent_of_world", F.bround(F.col("n_countries") * 100.0 / WORLD_COUNTRIES, 1))


@report("visits", "places", "home_periods")
def farthest_place(visits: DataFrame, places: DataFrame, home_periods: DataFrame) -> DataFrame:
    """Of the named places with visits, from the home of today (the open period)."""
    home = top(home_periods.where("end_ts is null").withColumnsRenamed({"lat": "hlat", "lon": "hlon"}), ["tid"], [F.col("id")], "hlat", "hlon")
    seen = visits.select("tid", "place_id").distinct()
    p = places.where("name is not null").select(F.col("id").alias("place_id"), "name", "city", "country", "category", "lat", "lon")
    rows = seen.join(p, "place_id").join(home, "tid").withColumn("metres", metres("hlat", "hlon", "lat", "lon"))
    best = top(rows, ["tid"], [-F.col("metres"), F.col("place_id")], "place_id", "name", "city", "country", "category", "metres")
    return best.withColumn("metres", F.round("metres", 1))


@report("visits", "places")
def newest_place(visits: DataFrame, places: DataFrame) -> DataFrame:
    n = placed(visits, places).where("name is not null").groupBy("tid", "place_id", "name", "city", "category").agg(F.min("start_ts").alias("first_ts"))
    return top(n, ["tid"], [-F.col("first_ts"), F.col("place_id")], "place_id", "name", "city", "category", "first_ts").withColumn("day", day("first_ts")).drop("first_ts")


@report("visits", "places")
def county_coverage(visits: DataFrame, places: DataFrame) -> DataFrame:
    """Counties of British places that were visited: how many, and the one visited least."""
    rows = placed(visits, places).where("country_code = 'GB'").withColumn("county", F.get_json_object("raw_json", "$.address.county")).where(F.coalesce("county", F.lit("")) != "")
    n = rows.groupBy("tid", "county").agg(F.count("*").alias("n_visits"))
    return n.groupBy("tid").agg(F.count("*").alias("n_counties")).join(top(n, ["tid"], [F.col("n_visits"), F.col("county")], "county", "n_visits"), "tid")


@report("visits", "places")
def chain_tour(visits: DataFrame, places: DataFrame, chain: str = "7") -> DataFrame:
    """Branches are places whose name holds the chain's, visited or not."""
    branches = places.where(F.contains(F.lower("name"), F.lit(chain.lower()))).select("tid", F.col("id").alias("place_id"))
    n = branches.groupBy("tid").agg(F.count_distinct("place_id").alias("n_branches"))
    v = visits.join(branches.select("place_id"), "place_id", "left_semi").groupBy("tid").agg(F.count("*").alias("n_visits"))
    return n.join(v, "tid", "left").fillna(0, ["n_visits"])


@report("visits", "places")
def longest_stay_away(visits: DataFrame, places: DataFrame) -> DataFrame:
    rows = placed(visits, places).where(~F.col("category").isin("Home", "Work")).withColumn("seconds", F.col("end_ts") - F.col("start_ts"))
    best = top(rows, ["tid"], [-F.col("seconds"), F.col("start_ts"), F.col("id")], "id", "name", "city", "seconds", "start_ts")
    return best.select("tid", "id", F.col("name").alias("place_name"), "city", "seconds", day("start_ts").alias("day"))


@report("visits", "places")
def category_totals(visits: DataFrame, places: DataFrame) -> DataFrame:
    return placed(visits, places).groupBy("tid", "category").agg(F.sum(dwell()).alias("seconds"), F.count("*").alias("n_visits"))


@report("visits", "places")
def favourite_category(visits: DataFrame, places: DataFrame) -> DataFrame:
    return top(category_totals(visits, places), ["tid"], [-F.col("seconds"), F.col("category")], "category", "seconds")


@report("visits", "places")
def airport_time(visits: DataFrame, places: DataFrame) -> DataFrame:
    return category_totals(visits, places).where("category = 'Airports' and seconds > 0").select("tid", "seconds")


@report("places")
def place_categories(places: DataFrame) -> DataFrame:
    return places.groupBy("tid", "category").agg(F.count("*").alias("n_places"))


@report("visits", "places")
def places_in_category(visits: DataFrame, places: DataFrame, category: str = "Shopping") -> DataFrame:
    rows = placed(visits, places).where(F.col("category") == category)
    return rows.groupBy("tid", F.col("place_id").alias("id"), "name", "city").agg(F.count("*").alias("n_visits"), F.max("end_ts").alias("last_ts"))


@report("visits")
def place_visits(visits: DataFrame, place_id: int = 7) -> DataFrame:
    return visits.where(F.col("place_id") == place_id).select("tid", "id", "start_ts", "end_ts")


@report("visits", "places")
def first_visit_per_country(visits: DataFrame, places: DataFrame) -> DataFrame:
    rows = placed(visits, places).where("country_code is not null")
    return top(rows, ["tid", "country_code"], [F.col("start_ts"), F.col("id")], "country", "start_ts", "place_id")


@report("visits", "places")
def cities(visits: DataFrame, places: DataFrame) -> DataFrame:
    rows = placed(visits, places).where("city is not null")
    return rows.groupBy("tid", "city").agg(F.max("country").alias("country"), F.max("country_code").alias("country_code"), F.count_distinct("place_id").alias("n_places"), F.max("end_ts").alias("last_ts"))


@report("visits", "places")
def cities_page(visits: DataFrame, places: DataFrame, page: int = 2, page_size: int = 8) -> DataFrame:
    """Latest first; `position` counts from 1 over all pages, n_cities is the total."""
    one = Window.partitionBy("tid")
    rows = cities(visits, places).withColumns({"position": F.row_number().over(one.orderBy(F.desc("last_ts"), "city")), "n_cities": F.count("*").over(one)})
    return rows.where(F.col("position").between((page - 1) * page_size + 1, page * page_size))


@report("visits", "places")
def city_detail(visits: DataFrame, places: DataFrame, city: str = "CITY_5") -> DataFrame:
    rows = placed(visits, places).where(F.col("city") == city)
    return rows.groupBy("tid", F.col("place_id").alias("id"), "name", "category", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).agg(F.count("*").alias("n_visits"), F.max("end_ts").alias("last_ts"))


@report("visits", "places")
def world(visits: DataFrame, places: DataFrame) -> DataFrame:
    rows = placed(visits, places).where("country is not null").withColumn("code", F.coalesce("country_code", "country"))
    return rows.groupBy("tid", "code").agg(F.max("country").alias("country"), F.max("country_code").alias("country_code"), F.count_distinct("city").alias("n_cities"), F.max("end_ts").alias("last_ts"))


@report("visits", "places")
def country_detail(visits: DataFrame, places: DataFrame, code: str = "GB") -> DataFrame:
    rows = placed(visits, places).where((F.col("country_code") == code.upper()) & F.col("city").isNotNull())
    return rows.groupBy("tid", "city").agg(F.count_distinct("place_id").alias("n_places"), F.max("end_ts").alias("last_ts"))


@report("places")
def country_pins(places: DataFrame, code: str = "GB") -> DataFrame:
    return places.where(F.col("country_code") == code.upper()).select("tid", "id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "name", "category", "city")


@report("places")
def world_share(places: DataFrame) -> DataFrame:
    n = places.groupBy("tid").agg(F.count_distinct("country_code").alias("n_countries"))
    return n.withColumn("share", F.bround(F.col("n_countries") * 100.0 / WORLD_COUNTRIES, 1))


@report("photos")
def photo_groups(photos: DataFrame) -> DataFrame:
    """Photos of one spot, to four decimals; those without a position are left out."""
    rows = photos.where("lat is not null and lon is not null and not (lat = 0 and lon = 0)")
    return rows.groupBy("tid", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")).agg(F.count("*").alias("n_photos"))


# -- distances and modes ---------------------------------------------------------------------------


def _two(c) -> Column:
    return F.round(_col(c), 2)


@report("segments")
def mode_totals(segments: DataFrame) -> DataFrame:
    return segments.groupBy("tid", "mode").agg(_two(F.sum("distance_m")).alias("distance_m"), _two(F.sum("duration_s")).alias("duration_s"))


@report("segments")
def mode_share(segments: DataFrame) -> DataFrame:
    """Every year from the first to the last and every mode that the person has; shares of the year's distance in percent."""
    n = segments.groupBy("tid", year("start_ts").alias("year"), "mode").agg(F.sum("distance_m").alias("d"))
    had = n.groupBy("tid").agg(F.sequence(F.min("year"), F.max("year")).alias("y"), F.collect_set("mode").alias("m"))
    spine = had.select("tid", F.explode("y").alias("year"), "m").select("tid", "year", F.explode("m").alias("mode"))
    rows = spine.join(n, ["tid", "year", "mode"], "left").fillna(0.0, ["d"]).withColumn("total", F.sum("d").over(Window.partitionBy("tid", "year")))
    share = F.when(F.col("total") > 0, F.bround(F.col("d") / F.col("total") * 100, 2)).otherwise(0.0)
    return rows.select("tid", "year", "mode", share.alias("share"), _two("total").alias("total_m"), mode_rank().alias("position"))


@report("segments")
def stacked_share(segments: DataFrame) -> DataFrame:
    w = Window.partitionBy("tid", "year").orderBy("position", "mode").rowsBetween(Window.unboundedPreceding, 0)
    return mode_share(segments).select("tid", "year", "mode", _two(F.sum("share").over(w)).alias("upto"))


@report("segments", "visits")
def odometer(segments: DataFrame, visits: DataFrame) -> DataFrame:
    w = Window.partitionBy("tid").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    rows = yearly_trend(segments, visits).withColumn("upto", F.sum("distance_m").over(w))
    return rows.select("tid", "year", _two("upto").alias("distance_m"), F.round(F.col("upto") / MOON_DISTANCE * 100, 4).alias("to_moon"))


def _delta(now: str, was: Column) -> Column:
    """Change in whole percent, halves up; null after nothing."""
    return F.floor((F.col(now) - was) * 100.0 / F.nullif(was, F.lit(0)) + 0.5).cast("int")


@report("visits")
def trend_delta(visits: DataFrame) -> DataFrame:
    w = Window.partitionBy("tid").orderBy("month")
    return visit_month_density(visits).select("tid", "month", F.col("n_visits").alias("n"), _delta("n_visits", F.lag("n_visits").over(w)).alias("delta"))


@report("trips")
def year_over_year(trips: DataFrame) -> DataFrame:
    n = trips.groupBy("tid", year("start_ts").alias("year")).agg(F.count("*").alias("n"))
    return n.select("tid", "year", "n", _delta("n", F.lag("n").over(Window.partitionBy("tid").orderBy("year"))).alias("delta"))


def _trends(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows (tid, m, key, value) with trend_0 ... trend_5: value of the six months up to m, zeros where there is none. m numbers months."""
    months = Window.partitionBy("tid", key).orderBy("m")
    then = lambda k: F.sum(value).over(months.rangeBetween(-k, -k))
    known = F.col(key).isNotNull()
    return rows.withColumns({f"trend_{i}": F.coalesce(F.when(known, then(SIX - 1 - i)), F.lit(0)) for i in range(SIX)})


def _month_number(ts: str) -> Column:
    return F.year(date(ts)) * 12 + F.month(date(ts)) - 1


def _named_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.format_string("%04d-%02d", F.floor(F.col("m") / 12), F.col("m") % 12 + 1)).drop("m")


@report("segments")
def monthly_insights(segments: DataFrame) -> DataFrame:
    """Each month's modes of a tenth of a mile or more, with the distances of the six months up to it."""
    n = segments.groupBy("tid", "mode", _month_number("start_ts").alias("m")).agg(F.sum("distance_m").alias("distance_m"), F.sum("duration_s").alias("duration_s"))
    rows = _named_month(_trends(n, "mode", "distance_m").where(F.col("distance_m") >= MIN_METRES))
    return rows.select("tid", "month", "mode", *[_two(c).alias(c) for c in ("distance_m", "duration_s", *(f"trend_{i}" for i in range(SIX)))])


@report("visits", "places")
def monthly_categories(visits: DataFrame, places: DataFrame) -> DataFrame:
    n = placed(visits, places).groupBy("tid", "category", _month_number("start_ts").alias("m")).agg(F.sum(dwell()).alias("seconds"))
    return _named_month(_trends(n, "category", "seconds").where(F.col("seconds") >= MIN_SECONDS))


def _with_ends(journeys: DataFrame, visits: DataFrame, places: DataFrame) -> DataFrame:
    """journeys (a few of each tid: tid, start_ts, end_ts) with start_name, end_name and ends_m (null where an end is missing). They are
    written first, as both as-of joins look at them twice."""
    journeys = keeper(journeys.sparkSession, "journeys")(journeys)
    label = F.coalesce("name", "city", "country").alias("label")
    rows = place_ops.with_ends(journeys, placed(visits, places).select("tid", "id", "start_ts", "end_ts", "place_id", "lat", "lon", label), ["tid"], ["label"])
    return rows.withColumnsRenamed({"from_label": "start_name", "to_label": "end_name"})


@report("segments", "visits", "places")
def fastest_journey(segments: DataFrame, visits: DataFrame, places: DataFrame) -> DataFrame:
    """The fastest segment of a minute or more under its mode's ceiling. Of flights the fastest few by stored distance count, at the speed between their ends."""
    limit = F.coalesce(*[F.when(F.col("mode") == m, F.lit(v)) for m, v in SPEED_CEILINGS.items()])
    rows = segments.where("duration_s >= 60").withColumns({"ceiling": limit, "speed": F.col("distance_m") / F.col("duration_s")}).where("ceiling is not null")
    ground = rows.where((F.col("mode") != "flying") & (F.col("speed") <= F.col("ceiling") / 3.6)).select("tid", "mode", "start_ts", (F.col("distance_m") / 1000 / (F.col("duration_s") / 3600)).alias("kmh"))
    rank = F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("speed"), "start_ts", *SEGMENT_KEYS))
    flights = rows.where("mode = 'flying'").withColumn("r", rank).where(F.col("r") <= FAST_FLIGHTS)
    air = _with_ends(flights.select("tid", "mode", "start_ts", "end_ts", "duration_s", "ceiling"), visits, places).withColumn("kmh", F.col("ends_m") / 1000 / (F.col("duration_s") / 3600)).where("kmh <= ceiling and kmh > 0")
    best = top(ground.unionByName(air.select("tid", "mode", "start_ts", "kmh")), ["tid"], [-F.col("kmh"), mode_rank(), F.col("start_ts")], "mode", "kmh", "start_ts")
    return best.select("tid", "mode", F.bround("kmh", 0).alias("kmh"), day("start_ts").alias("day"))


@report("segments", "visits", "places")
def longest_by_mode(segments: DataFrame, visits: DataFrame, places: DataFrame) -> DataFrame:
    """Of each mode the longest journey; flights, every one of them, are ranked by the distance between their ends."""
    runs = legs.chained(segments, SEGMENT_KEYS).withColumn("distance_m", _two("distance_m"))
    flying = F.col("mode") == "flying"
    keys = {"tid": F.col("tid"), "mode": F.col("mode"), "of_start": F.when(flying, F.col("start_ts")), "of_end": F.when(flying, F.col("end_ts"))}
    longest = F.max_by(F.struct("start_ts", "end_ts", "distance_m"), F.struct("distance_m", -F.col("start_ts"), -F.col("end_ts")))
    some = runs.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(longest.alias("b")).select("tid", "mode", "b.*")
    rows = _with_ends(some, visits, places).where(~flying | F.col("ends_m").isNotNull()).withColumn("far", F.when(flying, F.round("ends_m", 1)).otherwise(F.col("distance_m")))
    best = top(rows, ["tid", "mode"], [-F.col("far"), F.col("distance_m").isNull(), -F.col("distance_m"), F.col("start_ts"), F.col("end_ts")], "far", "start_name", "end_name", "start_ts")
    return best.withColumnRenamed("far", "distance_m").withColumn("day", day("start_ts")).drop("start_ts")


# -- trips -----------------------------------------------------------------------------------------


def _next(trips: DataFrame) -> DataFrame:
    """trips with nxt, the start of the person's next one."""
    return scan.running(trips, ["tid"], "start_ts", ["id"], {"nxt": ("lag", F.col("start_ts"))}, width=TRIP_BIN, back=True)


def _trip_days() -> Column:
    return ceil_days(F.col("end_ts") - F.col("start_ts"))


@report("trips", "visits")
def trip_totals(trips: DataFrame, visits: DataFrame, now: int | None = None, birth: int = BIRTH) -> DataFrame:
    now = now_of(visits) if now is None else now
    n = trips.groupBy("tid").agg(F.count("*").alias("n_trips"), F.sum(_trip_days()).alias("trip_days"), F.max_by("end_ts", F.struct("start_ts", "id")).alias("last_end"))
    alive = (now - birth) / DAY_S
    return n.select("tid", "n_trips", "trip_days", F.bround(F.col("trip_days") / F.col("n_trips"), 1).alias("avg_days"), F.floor((F.lit(now) - F.col("last_end")) / DAY_S).alias("days_since"), F.bround(F.col("trip_days") / F.lit(alive) * 100, 2).alias("life_percent"))


@report("trips")
def longest_gap(trips: DataFrame) -> DataFrame:
    return _next(trips).where("nxt is not null").groupBy("tid").agg(F.max(F.floor((F.col("nxt") - F.col("end_ts")) / DAY_S)).alias("days"))


@report("trips", "visits")
def trip_records(trips: DataFrame, visits: DataFrame, now: int | None = None) -> DataFrame:
    now = now_of(visits) if now is None else now
    rows = trips.withColumn("s", F.col("end_ts") - F.col("start_ts"))
    cols = ("id", "name", "primary_city", "primary_country", "s", "start_ts")
    by = {"longest": (rows, [-F.col("s"), F.col("start_ts"), F.col("id")]), "shortest": (rows.where(F.col("s") >= DAY_S), [F.col("s"), F.col("start_ts"), F.col("id")]), "first": (rows, [F.col("start_ts"), F.col("id")])}
    found = [top(r, ["tid"], order, *cols).withColumn("record", F.lit(name)) for name, (r, order) in by.items()]
    years = F.when(F.col("record") == "first", F.bround((F.lit(now) - F.col("start_ts")) / DAY_S / YEAR_DAYS, 1))
    return reduce(DataFrame.unionByName, found).select("tid", "record", "id", "name", "primary_city", "primary_country", F.bround(F.col("s") / DAY_S, 0).alias("days"), years.alias("years_ago"))


@report("visits", "trips")
def away_heatmap(visits: DataFrame, trips: DataFrame, only: int | None = None) -> DataFrame:
    """Every day of each year with visits (or of one year), with its visits and hours away."""
    v = visits.groupBy("tid", F.floor(F.col("start_ts") / DAY_S).alias("d")).agg(F.count("*").alias("n"))
    years = visits.groupBy("tid").agg(F.min(year("start_ts")).alias("lo"), F.max(year("start_ts")).alias("hi"))
    years = years.select("tid", F.explode(F.sequence("lo", "hi") if only is None else F.array(F.lit(only))).alias("y"))
    days = years.select("tid", F.explode(F.sequence(F.unix_date(F.make_date("y", F.lit(1), F.lit(1))), F.unix_date(F.make_date("y", F.lit(12), F.lit(31))))).alias("d")).withColumn("d", F.col("d").cast("long"))
    away = sequence.clipped_per_bin(trips, "start_ts", "end_ts", DAY_S, "d").groupBy("tid", "d").agg(F.sum("seconds").alias("s"))
    rows = days.join(v, ["tid", "d"], "left").join(away, ["tid", "d"], "left").fillna(0, ["n", "s"])
    return rows.select("tid", F.date_from_unix_date(F.col("d").cast("int")).cast("string").alias("day"), F.col("n").alias("n_visits"), F.col("s").alias("away_s"), F.bround(F.col("s") / 3600, 1).alias("away_hours"))


@report("trips", "visits", "home_periods")
def life_calendar(trips: DataFrame, visits: DataFrame, home_periods: DataFrame, now: int | None = None, birth: int = BIRTH) -> DataFrame:
    """Every week since birth: the share away, zero before anything was recorded."""
    now = now_of(visits) if now is None else now
    known = visits.groupBy("tid").agg(F.min("start_ts").alias("v")).join(home_periods.groupBy("tid").agg(F.min("start_ts").alias("h")), "tid", "full").select("tid", F.coalesce("h", "v").alias("seen"))
    weeks = known.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(max(0, -((birth - now) // WEEK_S) - 1))))).withColumn("has_data", F.coalesce((F.col("week") + 1) * WEEK_S + birth > F.col("seen"), F.lit(False)))
    shifted = trips.select("tid", (F.col("start_ts") - birth).alias("a"), (F.col("end_ts") - birth).alias("b"))
    away = sequence.clipped_per_bin(shifted, "a", "b", WEEK_S, "week").groupBy("tid", "week").agg(F.sum("seconds").alias("s"))
    share = F.when(F.col("has_data"), F.bround(F.coalesce("s", F.lit(0)) / WEEK_S, 3)).otherwise(0.0)
    return weeks.join(away, ["tid", "week"], "left").select("tid", "week", day(F.col("week") * WEEK_S + birth).alias("start_date"), "has_data", share.alias("away_share"))


@report("trips", "segments", "visits")
def decade_of_life(trips: DataFrame, segments: DataFrame, visits: DataFrame, now: int | None = None, birth: int = BIRTH) -> DataFrame:
    now = now_of(visits) if now is None else now
    shifted = trips.select("tid", (F.col("start_ts") - birth).alias("a"), (F.col("end_ts") - birth).alias("b"))
    days = sequence.clipped_per_bin(shifted, "a", "b", DECADE_S, "decade").groupBy("tid", "decade").agg(F.sum(ceil_days(F.col("seconds"))).alias("trip_days"))
    far = segments.where(F.col("start_ts") >= birth).groupBy("tid", F.floor((F.col("start_ts") - birth) / DECADE_S).alias("decade")).agg(_two(F.sum("distance_m")).alias("distance_m"))
    spine = _spread(people(trips, segments), 0, (now - birth) // DECADE_S, "decade")
    rows = spine.join(days, ["tid", "decade"], "left").join(far, ["tid", "decade"], "left").fillna(0, ["trip_days", "distance_m"])
    return rows.select("tid", (F.col("decade") * 10).cast("int").alias("age_start"), (F.col("decade") * 10 + 9).cast("int").alias("age_end"), "distance_m", "trip_days")


@report("trips", "visits")
def streaks(trips: DataFrame, visits: DataFrame, now: int | None = None) -> DataFrame:
    now = now_of(visits) if now is None else now
    n = _next(trips).groupBy("tid").agg(F.max(F.col("end_ts") - F.col("start_ts")).alias("away"), F.max(F.col("nxt") - F.col("end_ts")).alias("home"), F.max_by(F.struct("start_ts", "end_ts"), F.struct("start_ts", "id")).alias("last"))
    gone = F.col("last.end_ts") >= now
    whole = lambda c: F.bround(c / DAY_S, 0)
    return n.select("tid", whole(F.col("away")).alias("longest_away_days"), whole(F.col("home")).alias("longest_home_days"), F.when(gone, "away").otherwise("home").alias("current"), whole(now - F.when(gone, F.col("last.start_ts")).otherwise(F.col("last.end_ts"))).alias("current_days"))


@report("trips")
def destination_concentration(trips: DataFrame) -> DataFrame:
    """The five cities with most trips, and their share of all trips."""
    n = trips.where("primary_city is not null").groupBy("tid", F.col("primary_city").alias("city")).agg(F.count("*").alias("n_trips"))
    five = n.withColumn("rank", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("n_trips"), "city"))).where("rank <= 5")
    five = five.withColumn("top5_trips", F.sum("n_trips").over(Window.partitionBy("tid")))
    rows = five.join(trips.groupBy("tid").agg(F.count("*").alias("total_trips")), "tid")
    return rows.withColumn("top5_percent", F.bround(F.col("top5_trips") * 100 / F.col("total_trips"), 1))


DESTINATION = ["name", "primary_city", "primary_country_code", "own"]


def _destined(trips: DataFrame) -> DataFrame:
    """Trips with own (the trip's id where nothing names a destination) and days as a calendar shows them."""
    nothing = F.col("name").isNull() & F.col("primary_city").isNull() & F.col("primary_country_code").isNull()
    return trips.withColumn("own", F.when(nothing, F.col("id"))).withColumn("days", F.greatest(F.lit(1), F.floor((F.col("end_ts") - F.col("start_ts")) / DAY_S) + 1))


@report("trips")
def trip_destinations(trips: DataFrame) -> DataFrame:
    """Destinations, the latest first, with each person's totals."""
    n = _destined(trips).groupBy("tid", *DESTINATION).agg(F.count("*").alias("n_trips"), F.sum("days").alias("days"), F.max("end_ts").alias("last_ts"), F.max(F.struct("start_ts", "id")).alias("latest"))
    one = Window.partitionBy("tid")
    rows = n.withColumns({"position": F.row_number().over(one.orderBy(F.desc("latest"))), "n_destinations": F.count("*").over(one), "all_trips": F.sum("n_trips").over(one), "all_days": F.sum("days").over(one)})
    return rows.drop("latest")


@report("trips", "visits")
def trips_page(trips: DataFrame, visits: DataFrame, page: int = 1, page_size: int = 24) -> DataFrame:
    """The trips of one page of destinations, with how many visits each has."""
    some = trip_destinations(trips).where(F.col("position").between((page - 1) * page_size + 1, page * page_size)).select("tid", *DESTINATION, "position")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"d.{c}")) for c in DESTINATION]
    mine = _destined(trips).alias("t").join(some.alias("d"), reduce(lambda a, b: a & b, same, F.col("t.tid") == F.col("d.tid"))).select("t.*", "d.position")
    n = trip_visits_of(trips, visits).groupBy("id").agg(F.count("*").alias("n_visits"))
    return mine.join(n, "id", "left").select("tid", "position", "id", "name", "start_ts", "end_ts", "days", F.coalesce("n_visits", F.lit(0)).alias("n_visits"))


def trip_visits_of(trips: DataFrame, visits: DataFrame) -> DataFrame:
    """Pairs of a trip and a visit that starts in it: the trip's tid, id, start_ts, end_ts with vid, at, place_id."""
    v = visits.select("tid", F.col("id").alias("vid"), F.col("start_ts").alias("at"), F.col("end_ts").alias("until"), "place_id")
    return during(v, "at", trips.select("tid", "id", "start_ts", "end_ts"))


@report("trips", "segments")
def trip_scatter(trips: DataFrame, segments: DataFrame) -> DataFrame:
    """Days and distance of the trips that cover any."""
    s = segments.select("tid", F.col("start_ts").alias("at"), "distance_m")
    far = during(s, "at", trips.select("tid", "id", "start_ts", "end_ts")).groupBy("id").agg(F.sum("distance_m").alias("d")).where("d > 0")
    days = F.bround((F.col("end_ts") - F.col("start_ts")) / DAY_S, 1)
    label = F.coalesce("name", "primary_city", "primary_country")
    return trips.join(far, "id").select("tid", "id", days.alias("days"), _two("d").alias("distance_m"), label.alias("label")).where("days > 0")


@report("trips", "visits", "places")
def trip_visits(trips: DataFrame, visits: DataFrame, places: DataFrame) -> DataFrame:
    p = places.select(F.col("id").alias("place_id"), "country_code")
    return trip_visits_of(trips, visits).join(p, "place_id").groupBy("tid", "id").agg(F.count("*").alias("n_visits"), F.size(F.collect_set("country_code")).cast("long").alias("n_countries"))


@report("trips", "visits", "places")
def most_countries_in_a_trip(trips: DataFrame, visits: DataFrame, places: DataFrame) -> DataFrame:
    return top(trip_visits(trips, visits, places).where("n_countries > 1"), ["tid"], [-F.col("n_countries"), F.col("id")], "id", "n_countries")


@report("trips", "visits", "places", "segments")
def wrapped_years(trips: DataFrame, visits: DataFrame, places: DataFrame, segments: DataFrame) -> DataFrame:
    """A person's review of each year with segments, visits or trips: one row a year, a column (or two) for each slide."""
    far = segments.groupBy("tid", year("start_ts").alias("year")).agg(F.sum("distance_m").alias("d"))
    by_mode = segments.groupBy("tid", year("start_ts").alias("year"), "mode").agg(F.round(F.sum("distance_m"), 2).alias("mode_m"))
    mode = top(by_mode, ["tid", "year"], [-F.col("mode_m"), F.col("mode")], "mode", "mode_m")
    touched = trips.select("tid", "id", "start_ts", "end_ts", "primary_city", F.explode(F.sequence(year("start_ts"), year("end_ts"))).alias("year"))
    touched = touched.withColumn("s", F.least("end_ts", midnight(F.col("year") + 1)) - F.greatest("start_ts", midnight(F.col("year"))))
    gone = touched.where("s > 0")
    days = gone.groupBy("tid", "year").agg(F.sum(ceil_days(F.col("s"))).alias("trip_days"))
    where = gone.where(F.coalesce("primary_city", F.lit("")) != "").groupBy("tid", "year", F.col("primary_city").alias("city")).agg(F.sum("s").alias("s"))
    city = top(where, ["tid", "year"], [-F.col("s"), F.col("city")], "city", "s").select("tid", "year", "city", F.bround(F.col("s") / DAY_S, 0).alias("city_days"))
    longest = top(touched.withColumn("l", F.col("end_ts") - F.col("start_ts")), ["tid", "year"], [-F.col("l"), F.col("id")], "id", "l").select("tid", "year", F.col("id").alias("longest_trip"), F.bround(F.col("l") / DAY_S, 0).alias("longest_days"))
    coded = placed(visits, places).where("country_code is not null")
    seen = coded.groupBy("tid", year("start_ts").alias("year")).agg(F.count_distinct("country_code").alias("n_countries"))
    new = coded.groupBy("tid", "country_code").agg(F.min("start_ts").alias("t")).groupBy("tid", year("t").alias("year")).agg(F.count("*").alias("n_new"))
    parts = [far, mode, days, city, longest, seen, new, far.select("tid", (F.col("year") + 1).alias("year"), F.col("d").alias("prev"))]
    years = reduce(DataFrame.unionByName, [p.select("tid", "year") for p in parts[:6]]).distinct()
    rows = reduce(lambda a, b: a.join(b, ["tid", "year"], "left"), parts, years)
    zero = lambda c: F.coalesce(c, F.lit(0))
    period = (midnight(F.col("year") + 1) - midnight(F.col("year"))) / DAY_S
    return rows.select("tid", "year", _two(zero("d")).alias("distance_m"), _two(zero("prev")).alias("prev_distance_m"), zero("trip_days").alias("trip_days"), period.cast("long").alias("period_days"), "city", "city_days", "longest_trip", "longest_days",
                       zero("n_countries").alias("n_countries"), F.bround(zero("n_countries") * 100.0 / WORLD_COUNTRIES, 0).alias("percent_of_world"), zero("n_new").alias("n_new"), "mode", "mode_m", (zero("d") > MOON_DISTANCE).alias("moon_trips"))


@report("trips", "visits", "places", "segments")
def wrapped_all_time(trips: DataFrame, visits: DataFrame, places: DataFrame, segments: DataFrame, now: int | None = None) -> DataFrame:
    now = now_of(visits) if now is None else now
    t = trips.groupBy("tid").agg(F.sum(_trip_days()).alias("trip_days"), F.bround((F.lit(now) - F.min("start_ts")) / DAY_S / YEAR_DAYS, 1).alias("years_tracked"))
    c = placed(visits, places).where("country_code is not null").groupBy("tid").agg(F.count_distinct("country_code").alias("n_countries"))
    s = segments.groupBy("tid").agg(_two(F.sum("distance_m")).alias("distance_m"))
    return people(trips, visits, segments).join(t, "tid", "left").join(c, "tid", "left").join(s, "tid", "left").fillna(0, ["trip_days", "n_countries", "distance_m"])


@report("trips", "visits", "places")
def destination_pins(trips: DataFrame, visits: DataFrame, places: DataFrame) -> DataFrame:
    """Of all visits of a destination's trips the one farthest from the first: trips latest first, their visits in order; of equal ones (to a decimetre) the first."""
    p = places.select(F.col("id").alias("place_id"), "lat", "lon")
    named = _destined(trips).select("id", *DESTINATION)
    met = trip_visits_of(trips, visits).join(p, "place_id").join(named, "id").withColumn("o", F.struct(-F.col("start_ts"), -F.col("id"), F.col("at"), F.col("vid")))
    keys = ["tid", *DESTINATION]
    first = F.min_by(F.struct("lat", "lon"), "o").over(Window.partitionBy(*keys))
    far = met.withColumn("f", first).withColumn("metres", F.round(metres("f.lat", "f.lon", "lat", "lon"), 1))
    return top(far, keys, [-F.col("metres"), F.col("o")], "vid", "metres")


@report("home_periods")
def home_periods(periods: DataFrame) -> DataFrame:
    return periods.select("tid", "id", "start_ts", "end_ts", "radius_m")


# -- a day, runs of visits, photos -----------------------------------------------------------------


def _on_day(rows: DataFrame, at: int) -> DataFrame:
    return rows.where((F.col("start_ts") < at + DAY_S) & (F.col("end_ts") >= at))


def coalesced(visits: DataFrame) -> DataFrame:
    """Consecutive visits of one place with short gaps as one: tid, id (of the first), place_id, start_ts, end_ts, n_visits. Visits without a place stay alone.

    Runs of one place come from the scan over time bins; inside a run (no other place between its visits) a window of its own looks for gaps."""
    new = F.col("__was").isNull() | F.col("place_id").isNull() | (F.col("__was") != F.col("place_id"))
    rows = scan.islands(visits, ["tid"], "start_ts", ["id"], {"__was": F.col("place_id")}, new, "__run")
    upto = F.max("end_ts").over(Window.partitionBy("tid", "__run").orderBy("start_ts", "id").rowsBetween(Window.unboundedPreceding, -1))
    rows = sequence.islands(rows.withColumn("__upto", upto), ["tid", "__run"], ["start_ts", "id"], F.col("start_ts") - F.col("__upto") > MERGE_GAP, "__part")
    return rows.groupBy("tid", "__run", "__part").agg(F.min_by("id", F.struct("start_ts", "id")).alias("id"), F.first("place_id").alias("place_id"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n_visits")).drop("__run", "__part")


@report("visits")
def coalesced_visits(visits: DataFrame) -> DataFrame:
    return coalesced(visits)


@report("visits", "segments", "places")
def day_timeline(visits: DataFrame, segments: DataFrame, places: DataFrame, at: int = A_DAY) -> DataFrame:
    """A day's coalesced visits with their places and its segments; after a last segment the visit that it ends in comes again, as `return`."""
    on = _on_day(visits, at)
    moves = _on_day(segments, at)
    none = F.lit(None)
    v = coalesced(on).select("tid", F.lit("visit").alias("type"), "id", "start_ts", "end_ts", "place_id", none.cast("string").alias("mode"), none.cast("double").alias("distance_m"))
    s = moves.select("tid", F.lit("segment").alias("type"), F.col("k1").alias("id"), "start_ts", "end_ts", none.cast("long").alias("place_id"), "mode", "distance_m")
    last = v.select("tid", "start_ts", F.lit(0).alias("moving"), "end_ts").unionByName(moves.select("tid", "start_ts", F.lit(1).alias("moving"), "end_ts"))
    last = last.groupBy("tid").agg(F.max(F.struct("start_ts", "moving", "end_ts")).alias("l")).where("l.moving = 1").select("tid", F.col("l.end_ts").alias("moved"))
    back = on.where("place_id is not null").join(last, "tid").where((F.col("start_ts") <= F.col("moved")) & (F.col("end_ts") >= F.col("moved")))
    back = top(back, ["tid"], [F.col("start_ts"), F.col("id")], "id", "moved", "end_ts", "place_id").select("tid", F.lit("return").alias("type"), "id", F.col("moved").alias("start_ts"), "end_ts", "place_id", none.cast("string").alias("mode"), none.cast("double").alias("distance_m"))
    p = places.select(F.col("id").alias("place_id"), F.col("name").alias("place_name"), "category", "city")
    return v.unionByName(s).unionByName(back).join(p, "place_id", "left")


@report("segments")
def day_modes(segments: DataFrame, at: int = A_DAY) -> DataFrame:
    return mode_totals(_on_day(segments, at))


@report("pings")
def day_points(pings: DataFrame, at: int = 1704844800) -> DataFrame:
    """The day's trusted points."""
    return pings.where((F.col("tst") >= at) & (F.col("tst") < at + DAY_S) & (F.col("acc").isNull() | (F.col("acc") <= 100))).select("tid", "id", "tst", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@report("visits")
def context_visits(visits: DataFrame, at: int = A_DAY) -> DataFrame:
    """The last visit that ended before a day, and the first after it."""
    before = top(visits.where(F.col("end_ts") <= at), ["tid"], [-F.col("end_ts"), -F.col("id")], "id", "end_ts").select("tid", F.lit("before").alias("side"), "id", F.col("end_ts").alias("at_ts"))
    after = top(visits.where(F.col("start_ts") >= at + DAY_S), ["tid"], [F.col("start_ts"), F.col("id")], "id", "start_ts").select("tid", F.lit("after").alias("side"), "id", F.col("start_ts").alias("at_ts"))
    return before.unionByName(after)


@report("photos")
def photo_clusters(photos: DataFrame) -> DataFrame:
    """Runs of photos with hops of at most six hours and a kilometre."""
    near = (F.col("taken_ts") - F.col("was.taken_ts") <= PHOTO_GAP) & (metres("was.lat", "was.lon", "lat", "lon") <= PHOTO_DISTANCE)
    some = photos.where("not (lat = 0 and lon = 0)")
    runs = scan.islands(some, ["tid"], "taken_ts", ["uid"], {"was": F.struct("taken_ts", "lat", "lon")}, ~F.coalesce(near, F.lit(False)), "g")
    return runs.groupBy("tid", "g").agg(F.min("taken_ts").alias("start_ts"), F.max("taken_ts").alias("end_ts"), F.count("*").alias("n_photos"), F.round(F.avg("lat"), 5).alias("lat"), F.round(F.avg("lon"), 5).alias("lon"))


@report("photos", "visits")
def photos_in_visits(photos: DataFrame, visits: DataFrame) -> DataFrame:
    """Each photo with the first visit that it falls into, both ends included."""
    v = visits.select("tid", F.col("id").alias("visit_id"), "start_ts", (F.col("end_ts") + 1).alias("end_ts"))
    return top(during(photos.select("tid", "uid", "taken_ts"), "taken_ts", v), ["tid", "uid"], [F.col("start_ts"), F.col("visit_id")], "visit_id")


@report("trips", "visits", "segments")
def trip_timeline(trips: DataFrame, visits: DataFrame, segments: DataFrame) -> DataFrame:
    """Of each person's longest trip: its visits, and the segments that lie inside."""
    t = top(trips.withColumn("l", F.col("end_ts") - F.col("start_ts")), ["tid"], [-F.col("l"), F.col("id")], "id", "start_ts", "end_ts")
    v = trip_visits_of(t, visits).select("tid", F.lit("visit").alias("kind"), F.col("vid").alias("k1"), F.col("at").alias("start_ts"), F.col("until").alias("end_ts"))
    s = during(segments.select("tid", "mode", "k1", F.col("start_ts").alias("at"), F.col("end_ts").alias("until")), "at", t.withColumn("end_ts", F.col("end_ts") + 1)).where(F.col("until") < F.col("end_ts"))
    return v.unionByName(s.select("tid", F.col("mode").alias("kind"), "k1", F.col("at").alias("start_ts"), F.col("until").alias("end_ts")))


# -- stories and status ----------------------------------------------------------------------------


@report("visits", "places", "segments", "trips")
def stories(visits: DataFrame, places: DataFrame, segments: DataFrame, trips: DataFrame) -> DataFrame:
    """Up to twelve stories a person, each with a number and a label; those that would say nothing are left out."""
    def told(rows: DataFrame, story: str, number, label=None) -> DataFrame:
        return rows.select("tid", F.lit(story).alias("story"), _col(number).cast("double").alias("number_"), (F.lit(None) if label is None else _col(label)).cast("string").alias("label"))

    sums, all_years, season = totals(visits, places, segments), yearly_trend(segments, visits), seasonality(segments, visits)
    record = trip_records(trips, visits).where("record = 'longest'")
    peak = top(all_years, ["tid"], [-F.col("distance_m"), F.col("year")], "year", "distance_m").where("distance_m > 0")
    warm = top(season, ["tid"], [-F.col("distance_m"), F.col("month_of_year")], "month_of_year", "distance_m").where("distance_m > 0")
    newest = top(first_visit_per_country(visits, places), ["tid"], [-F.col("start_ts"), F.col("country_code")], "country_code", "start_ts")
    category = top(category_totals(visits, places).where(~F.col("category").isin(*STORY_EXCLUDES)), ["tid"], [-F.col("seconds"), F.col("category")], "category", "seconds").where("seconds > 0")
    trip = trip_totals(trips, visits)
    return reduce(DataFrame.unionByName, [
        told(sums.where("distance_m > 0"), "circumference", "distance_m"),
        told(most_visited_place(visits, places), "most_visited", "n_visits", "name"),
        told(record, "longest_trip", "days", "id"),
        told(busiest_day(visits), "busiest_day", "n_visits", "day"),
        told(peak, "peak_year", "distance_m", "year"),
        told(warm, "peak_month", "month_of_year"),
        told(longest_gap(trips).where("days > 0"), "longest_gap", "days"),
        told(sums.where("n_countries > 0").withColumn("p", F.bround(F.col("n_countries") * 100.0 / WORLD_COUNTRIES, 0).cast("int")), "country_count", "n_countries", "p"),
        told(newest, "newest_country", year("start_ts"), "country_code"),
        told(category, "top_category", "seconds", "category"),
        told(mode_totals(segments).where((F.col("mode") == "flying") & (F.col("distance_m") > MOON_DISTANCE)), "moon_trips", "distance_m"),
        told(trip.where("avg_days > 0"), "trip_frequency", "n_trips", "avg_days"),
    ])


@report("pings")
def tracking_status(pings: DataFrame, now: int | None = None, run: DataFrame | None = None) -> DataFrame:
    """Whether a device still reports: its last point and the points of the last hour and day before `now` (the latest point of all). run: one
    row (ok) of the last run of the ingest; if that has failed, all are in error."""
    now = (pings.agg(F.max("tst")).first()[0] or 0) if now is None else now
    last = top(pings, ["tid"], [-F.col("tst"), -F.col("id")], "id", "tst", "acc", "source")
    n = pings.groupBy("tid").agg(F.count_if(F.col("tst") >= now - 3600).alias("last_hour"), F.count_if(F.col("tst") >= now - DAY_S).alias("last_day"), F.count("*").alias("n_points"))
    age = now - F.col("tst")
    level = F.when(age > 14400, "error").when(age > 3600, "warn").otherwise("ok")
    if run is not None and run.where("not ok").limit(1).count():
        level = F.lit("error")
    return last.join(n, "tid").withColumns({"age_s": age, "level": level})


@report("visits", "segments", "trips", "places", "pings")
def diagnostics_counts(visits: DataFrame, segments: DataFrame, trips: DataFrame, places: DataFrame, pings: DataFrame) -> DataFrame:
    named = {"visits": visits, "segments": segments, "trips": trips, "places": places, "pings": pings}
    return reduce(DataFrame.unionByName, [f.groupBy().agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("table_name"), "n_rows") for k, f in named.items()])


@report("pings")
def ping_days(pings: DataFrame) -> DataFrame:
    return pings.where("acc is null or acc <= 100").groupBy("tid", day("tst").alias("day")).agg(F.count("*").alias("n_pings"), F.min("tst").alias("first_ts"), F.max("tst").alias("last_ts"))
