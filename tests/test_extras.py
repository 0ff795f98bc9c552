"""Folder names, addresses, aliases, made-up pings, coverage, world shapes and the cache of rail legs on literal rows."""

from datetime import date

from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import places, routing, timeline
from tracemill.plans import reports
from tracemill.sources import importers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    for said, want in (("New Zealand 2004 ", "New Zealand"), ("2004", None), ("Route 66 trip", "Route 66 trip"), (None, None)):
        assert one(spark, text.trip_name(F.lit(said).cast("string"))) == want
    assert one(spark, text.without_parentheses(F.lit("Party (09-12-2004) (Ann)"))) == "Party"
    d = one(spark, text.dates_of_folder(F.lit("A (B) (18-10-2002 - 20-10-2002)")))
    assert (d["first"], d["last"]) == (date(2002, 10, 18), date(2002, 10, 20))
    assert one(spark, text.dates_of_folder(F.lit("A (45-10-2002)")))["first"] is None
    assert one(spark, text.locality(F.lit(""), F.lit(None).cast("string"), F.lit("Ham"), F.lit("Big"))) == "Ham"


def test_countries(spark):
    for said, country, want in (("City in Scotland", "United Kingdom", True), ("City in France", "France", True), ("City in Spain", "France", False), (None, "France", False), ("Town, UK", "united kingdom", True)):
        assert one(spark, text.names_country(F.lit(said).cast("string"), F.lit(country))) is want
    assert one(spark, text.about_a_country(F.lit("Island Country in the Atlantic"))) and not one(spark, text.about_a_country(F.lit("Countryside")))


def test_folders_to_review(spark):
    folders = spark.createDataFrame([("Rome (01-02-2003)",), ("Kittens (01-02-2003)",), ("Road (01-02-2003)",), ("Paris (01-02-2003)",), ("No date",)], "folder string")
    shots = spark.createDataFrame([("Paris (01-02-2003)", 48.0), ("Rome (01-02-2003)", None)], "folder string, lat double")
    found = spark.createDataFrame([("Rome", "Culture"), ("Road", "Other places")], "query string, category string")
    assert {(r.query, r.verdict) for r in importers.folders_to_review(folders, shots, found).collect()} == {("Rome", "confident"), ("Kittens", "none"), ("Road", "uncertain")}


def test_replaced_and_made_up(spark):
    table = spark.createDataFrame([(1, "google_raw"), (2, "owntracks"), (3, None)], "id int, source string")
    new = spark.createDataFrame([(9, "google_raw")], "id int, source string")
    assert {r.id for r in importers.replaced(table, new, "google_raw").collect()} == {2, 3, 9}
    stays = spark.createDataFrame([(1, 50.0, 1.0, 0, 1200)], "tid int, lat double, lon double, start_ts long, duration_s long")
    moves = spark.createDataFrame([(1, 50.0, 1.0, 52.0, 1.0, 2000, 100, 4)], "tid int, lat double, lon double, lat2 double, lon2 double, start_ts long, duration_s long, n int")
    got = [(r.tst, round(r.lat, 6)) for r in importers.made_up(stays, moves).orderBy("tst").collect()]
    assert got == [(0, 50.0), (600, 50.0), (1200, 50.0), (2000, 50.0), (2025, 50.5), (2050, 51.0), (2075, 51.5), (2100, 52.0)]


def test_tracked_against_a_loop(spark):
    pings = [(1, t) for t in (10, 86_399, 86_400, 300_000)] + [(2, 500)]
    spans = [(tid, a, a + w) for tid in (1, 2, 3) for a in (0, 11, 86_398, 86_401, 200_000, 299_999) for w in (0, 1, 1000, 250_000)]
    want = sorted(s for s in spans if any(p[0] == s[0] and s[1] <= p[1] <= s[2] for p in pings))
    got = timeline.tracked(spark.createDataFrame(spans, "tid int, start_ts long, end_ts long"), spark.createDataFrame(pings, "tid int, tst long"))
    assert sorted(map(tuple, got.collect())) == want


def test_world(spark):
    shapes, codes = spark.createDataFrame([("FRA",), ("DEU",), ("XXX",)], "iso3 string"), spark.createDataFrame([("FRA", "FR"), ("DEU", "DE")], "iso3 string, iso2 string")
    seen = spark.createDataFrame([("fr",), (None,), ("FR",)], "country_code string")
    assert sorted(map(tuple, places.on_world(shapes, codes, seen).collect())) == [("DEU", "DE", False), ("FRA", "FR", True), ("XXX", None, False)]


def test_ways_near(spark):
    ways = spark.createDataFrame([(1, [(50.0, 0.05)]), (2, [(50.0, 0.5)]), (3, [(49.9, -0.1), (60.0, 0.0)])], "way_id int, geometry array<struct<lat:double,lon:double>>")
    legs = spark.createDataFrame([(50.0, 0.0, 50.0, 0.1)], "lat1 double, lon1 double, lat2 double, lon2 double")
    assert {r.way_id for r in routing.ways_near(ways, legs).collect()} == {1, 3}
    wide = legs.select(routing.margin("lat1", "lon1", "lat2", "lon2").alias("m")).first().m
    assert wide == 0.15


def test_cache_of_legs(spark):
    ends = "leg string, lat1 double, lon1 double, lat2 double, lon2 double"
    legs = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0), ("b", 3.0, 4.0, 1.0, 2.0), ("c", 5.0, 5.0, 6.0, 6.0), ("d", 7.0, 7.0, 8.0, 8.0), ("e", 1.000001, 2.0, 3.0, 4.0)], ends)
    empty = spark.createDataFrame([], "key string, found boolean, metres double, path array<string>")
    asked = []

    def route(open_):
        asked.append(sorted(r.lat1 for r in open_.collect()))
        known = open_.where("lat1 <> 7.0")  # the leg from 7 fails, that from 5 has no route
        return known.select("leg", (F.col("lat1") != 5.0).alias("found"), F.lit(9.0).alias("metres"), F.array(F.lit("n")).alias("path"))

    answers, cache = routing.through_cache(legs, empty, route)
    assert sorted(r.leg for r in answers.collect()) == ["a", "b", "e"] and cache.count() == 3
    answers, cache = routing.through_cache(legs, spark.createDataFrame(cache.collect(), cache.schema), route)
    assert sorted(r.leg for r in answers.collect()) == ["a", "b", "e"] and asked[-1] == [7.0] and cache.count() == 3


def test_every_flight_is_ranked_by_its_ends(spark):
    """The farthest flight is the shortest of thirty as stored; equal ends: the longest as stored, then the first. Other modes count as stored."""
    hour = 3600
    flights = [(1, "flying", i, 1, 1, 1, (2 * i + 1) * hour, (2 * i + 2) * hour, 1000.0 - i, 60.0) for i in range(30)]
    buses = [(1, "bus", 90 + i, 1, 1, 1, (100 + 9 * i) * hour, (101 + 9 * i) * hour, d, 60.0) for i, d in enumerate((5.0, 7.0, 7.0))]
    segments = spark.createDataFrame([*flights, *buses], "tid long, mode string, k1 long, k2 long, k3 long, k4 long, start_ts long, end_ts long, distance_m double, duration_s double")
    visits = spark.createDataFrame([(1, i, 2 * i * hour + 1, 2 * i * hour + 2, 2 if i == 30 else 1) for i in range(31)], "tid long, id long, start_ts long, end_ts long, place_id long")
    places = spark.createDataFrame([(1, 1, "Near", None, None, None, None, None, 50.0, 0.0), (2, 1, "Far", None, None, None, None, None, 52.0, 0.0)], "id long, tid long, name string, category string, city string, country string, country_code string, raw_json string, lat double, lon double")
    got = {r["mode"]: (r["distance_m"], r["start_name"], r["end_name"], r["day"]) for r in reports.longest_by_mode(segments, visits, places).collect()}
    assert set(got) == {"flying", "bus"}
    assert got["flying"][0] > 200_000 and got["flying"][1:] == ("Near", "Far", "1970-01-03")
    assert got["bus"] == (7.0, "Far", None, "1970-01-05")
    near = visits.withColumn("place_id", F.lit(1).cast("long"))
    flight = {r["mode"]: (r["distance_m"], r["day"]) for r in reports.longest_by_mode(segments, near, places).collect()}["flying"]
    assert flight == (0.0, "1970-01-01")
