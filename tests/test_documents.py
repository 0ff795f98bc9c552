"""Nested documents and imports of planned and confirmed trips on literal rows."""

import json

from pyspark.sql import functions as F

from tracemill.plans import documents
from tracemill.sources import importers

DAY = 86_400


def test_day_document(spark, tmp_path):
    """Timeline, totals, places around and photos of a day in one (app/api/day.py:69-250)."""
    at = 10 * DAY
    visits = spark.createDataFrame([(1, 1, at - 9000, at - 100, 5), (1, 2, at + 100, at + 200, 5), (1, 3, at + 300, at + 900, None), (1, 4, at + DAY + 5, at + DAY + 9, 6), (2, 9, at - 50, at - 40, 5)], "tid long, id long, start_ts long, end_ts long, place_id long")
    segments = spark.createDataFrame([(1, "bus", 7, 1, at + 200, at + 300, 1234.6, 100.0)], "tid long, mode string, k1 long, k2 int, start_ts long, end_ts long, distance_m double, duration_s double")
    places = spark.createDataFrame([(5, 1, "Inn", "Hotels", "C", 50.0, 1.25), (6, 1, None, None, None, 51.0, 2.0)], "id long, tid long, name string, category string, city string, lat double, lon double")
    shot = spark.createDataFrame([(1, "a", at + 150, 0.0, 0.0), (1, "b", at - 1, 1.0, 1.0)], "tid long, uid string, taken_ts long, lat double, lon double")
    rows = documents.day_documents(visits, segments, places, shot, at)
    got = {r["tid"]: json.loads(r["document"]) for r in rows.collect()}
    assert list(got) == [1]
    assert [(x["type"], x["id"], x["place_name"], x["metres"]) for x in got[1]["timeline"]] == [("visit", 2, "Inn", None), ("segment", 7, None, 1235), ("visit", 3, None, None)]
    assert got[1]["modes"] == [{"mode": "bus", "metres": 1235, "seconds": 100}]
    assert [(x["side"], x["id"], x["name"], x["lon_e6"]) for x in got[1]["around"]] == [("before", 1, "Inn", 1_250_000), ("after", 4, None, 2_000_000)]
    assert got[1]["photos"] == [{"uid": "a", "taken_ts": at + 150, "lat_e6": None, "lon_e6": None}]
    documents.written(rows, str(tmp_path / "out"), 4)
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == [{"tid": 1, "document": got[1]}]


def test_planned_trips(spark):
    """Stops of a minute, legs of a kilometre or more, whole folders refused (scripts/import_travellerspoint_kml.py:168-255)."""
    stops = spark.createDataFrame(
        [(1, "Rome 2020", 0, "Home", 50.0, 0.0, 10), (1, "Rome 2020", 1, "Some Airport", 50.005, 0.0, 10), (1, "Rome 2020", 2, "Rome", 42.0, 12.0, 11), (1, "Rome 2020", 3, "Home", 50.0, 0.0, 12), (1, "Refused", 0, "a", 1.0, 1.0, 20), (1, "Refused", 1, "b", 2.0, 1.0, 21), (2, "Refused", 0, "a", 1.0, 1.0, 20), (2, "Refused", 1, "b", 1.5, 1.0, 21)],
        "tid long, folder string, position int, name string, lat double, lon double, d int",
    ).withColumn("day", F.date_from_unix_date("d"))
    have = spark.createDataFrame([(1, 22 * DAY - 10, 22 * DAY + 10), (1, 13 * DAY, 14 * DAY)], "tid long, start_ts long, end_ts long")
    visits, legs, trips = importers.planned_trips(stops, have)
    assert sorted((r["tid"], r["start_ts"], r["end_ts"]) for r in visits.collect()) == [(1, 10 * DAY, 10 * DAY + 60), (1, 10 * DAY + 1, 10 * DAY + 61), (1, 11 * DAY + 2, 11 * DAY + 62), (1, 12 * DAY + 3, 12 * DAY + 63), (2, 20 * DAY, 20 * DAY + 60), (2, 21 * DAY + 1, 21 * DAY + 61)]
    assert sorted((r["tid"], r["start_ts"], r["end_ts"], r["mode"]) for r in legs.collect()) == [(1, 10 * DAY + 1, 11 * DAY + 2, "flying"), (1, 11 * DAY + 2, 12 * DAY + 3, "flying"), (2, 20 * DAY, 21 * DAY + 1, "driving")]
    assert sorted((r["tid"], r["name"], r["start_ts"], r["end_ts"], r["far_name"]) for r in trips.collect()) == [(1, "Rome", 10 * DAY, 12 * DAY + 63, "Rome"), (2, "Refused", 20 * DAY, 21 * DAY + 61, "b")]


def test_confirmed_photo_trips(spark):
    """To the last second of the last day, not over any trip of the person (scripts/import_confirmed_photo_trips.py:94-155)."""
    found = spark.createDataFrame([(1, 3, 4, 1.0, 2.0), (2, 3, 4, 1.0, 2.0)], "tid long, a int, b int, lat double, lon double").select("tid", F.date_from_unix_date("a").alias("first_day"), F.date_from_unix_date("b").alias("last_day"), "lat", "lon")
    trips = spark.createDataFrame([(1, 5 * DAY - 2, 9 * DAY), (2, 5 * DAY - 1, 9 * DAY)], "tid long, start_ts long, end_ts long")
    got = [(r["tid"], r["start_ts"], r["end_ts"], r["source"]) for r in importers.confirmed_photo_trips(found, trips).collect()]
    assert got == [(2, 3 * DAY, 5 * DAY - 1, "photo_import")]


def test_stops_take_dates_from_their_neighbours(spark, tmp_path):
    """One dated stop dates the whole folder; folders without any, or of one stop, are left out (scripts/import_travellerspoint_kml.py:84-98, 168-182)."""
    mark = lambda d, p=True: f"<Placemark><name>n</name><description>{d}</description>{'<Point><coordinates>1.0,2.0,0</coordinates></Point>' if p else ''}</Placemark>"
    (tmp_path / "t.kml").write_text(f"<kml><Folder><name>A</name>{mark('')}{mark('', False)}{mark('on 02Jan2020')}</Folder><Folder><name>B</name>{mark('')}{mark('')}</Folder><Folder><name>C</name>{mark('02Jan2020')}</Folder></kml>")
    got = [(r["folder"], r["position"], str(r["day"])) for r in importers.planned_stops(spark, str(tmp_path / "t.kml")).orderBy("folder", "position").collect()]
    assert got == [("A", 0, "2020-01-02"), ("A", 1, "2020-01-02")]


def _trip_frames(spark, trips, visits=(), segments=(), photos=()):
    shown = [(t, i, a, b, None, "C", None, None) for t, i, a, b in trips]
    return (
        spark.createDataFrame(shown, "tid long, id long, start_ts long, end_ts long, name string, primary_city string, primary_country string, primary_country_code string"),
        spark.createDataFrame(list(visits), "tid long, id long, start_ts long, end_ts long, place_id long"),
        spark.createDataFrame([(5, "Inn", "Hotels", "C", 50.0, 1.25)], "id long, name string, category string, city string, lat double, lon double"),
        spark.createDataFrame(list(segments), "tid long, mode string, k1 long, k2 int, start_ts long, end_ts long, distance_m double"),
        spark.createDataFrame([(*p, None, None) for p in photos], "tid long, uid string, taken_ts long, lat double, lon double"),
    )


def test_trip_documents_are_dealt_once(spark):
    """Trips and what happens on them are dealt by person and part and stay there; only lists of trips over a border are shuffled by trip."""
    rows = documents.trip_documents(*_trip_frames(spark, [(1, 1, 0, DAY)]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    by_trip = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and " id#" in line]
    assert len(by_trip) == 1, by_trip


def test_trip_document_over_the_border_of_parts(spark):
    """Visits, legs and photos on both sides of it, in order; empty and odd trips keep their documents."""
    part = 16 * 7 * DAY
    at = 3 * part - DAY
    trips = [(1, 7, at, at + 2 * DAY), (1, 8, at + 5 * DAY, at + 6 * DAY), (2, 9, at, at + 2 * DAY), (1, 10, None, at), (1, None, at, at + DAY), (None, 11, at, at + DAY), (1, 12, at - part, at + 3 * part)]
    visits = [(1, 2, at + DAY + 50, at + DAY + 90, 5), (1, 1, at, at + DAY + 60, None), (1, 3, at + 2 * DAY, at + 2 * DAY + 5, 5)]
    segments = [(1, "bus", 2, 1, at + DAY - 10, at + DAY + 10, 1.5), (1, "bus", 1, 1, at + 2 * DAY, at + 2 * DAY, 2.5), (1, "bus", 3, 1, at + 9, at + 2 * DAY + 1, 1.0)]
    photos = [(1, "b", at + DAY + 55), (1, "a", at + DAY + 80), (1, "c", at + 2 * DAY + 100)]
    rows = documents.trip_documents(*_trip_frames(spark, trips, visits, segments, photos)).collect()
    got = {(r["tid"], r["id"]): json.loads(r["document"]) for r in rows}
    assert len(rows) == len(got) == 7
    over = got[1, 7]
    assert [(v["vid"], v["place_name"], v["lon_e6"], v["photos"]) for v in over["visits"]] == [(1, None, None, [{"uid": "b", "taken_ts": at + DAY + 55}]), (2, "Inn", 1_250_000, [{"uid": "a", "taken_ts": at + DAY + 80}])]
    assert over["legs"] == [{"k1": 2, "from_ts": at + DAY - 10, "to_ts": at + DAY + 10, "mode": "bus", "metres": 2}, {"k1": 1, "from_ts": at + 2 * DAY, "to_ts": at + 2 * DAY, "mode": "bus", "metres": 2}]
    assert over["photos"] == [{"uid": "c", "taken_ts": at + 2 * DAY + 100}]
    assert list(over) == ["id", "name", "start_ts", "end_ts", "days", "primary_city", "primary_country", "primary_country_code", "visits", "legs", "photos"]
    assert [len(got[1, 12][c]) for c in ("visits", "legs", "photos")] == [3, 3, 1]
    for key in ((1, 8), (2, 9), (1, 10), (1, None), (None, 11)):
        assert [got[key][c] for c in ("visits", "legs", "photos")] == [[], [], []]


def test_trip_document_holds_every_photo_of_its_days(spark):
    """As its SQL has them: 150 photos, of which the last is in a visit."""
    photos = [(1, f"p{i:03}", 40 * DAY + i) for i in range(150)]
    rows = documents.trip_documents(*_trip_frames(spark, [(1, 1, 40 * DAY, 41 * DAY)], [(1, 4, 40 * DAY + 149, 40 * DAY + 200, 5)], photos=photos)).collect()
    got = json.loads(rows[0]["document"])
    assert [p["uid"] for p in got["photos"]] == [f"p{i:03}" for i in range(149)]
    assert [p["uid"] for p in got["visits"][0]["photos"]] == ["p149"]
