"""Rules that hold within one person, and sources that take no part: literal rows of two people."""

from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import away, overlays, places

TRIP = "tid long, id long, start_ts long, end_ts long, name string, primary_city string, primary_country string, primary_country_code string, manually_corrected boolean"


def test_corrections_stay_with_their_person(spark):
    """Corrections are found by start and end, within the person (app/processing.py:424-427)."""
    fresh = spark.createDataFrame([(1, 1, 0, 9, None, "A", "X", "XX", False), (2, 2, 0, 9, None, "B", "Y", "YY", False)], TRIP)
    corrected = spark.createDataFrame([(1, 7, 0, 9, "one", "C", None, None, True), (1, 8, 0, 9, "later", "D", None, None, True), (2, 9, 0, 9, "raw", "E", None, None, False)], TRIP)
    got = {r["tid"]: (r["name"], r["primary_city"], r["primary_country"], r["manually_corrected"]) for r in overlays.carried_over(fresh, corrected).collect()}
    assert got == {1: ("later", "D", None, True), 2: (None, "B", "Y", False)}
    assert overlays.carried_over(fresh, corrected).count() == 2


def test_home_tags_stay_with_their_person(spark):
    """Generic, uncorrected places within any of the person's periods (app/geocoding.py:346-363)."""
    rows = spark.createDataFrame(
        [(1, 1, "Other places", 50.0, 1.0, False), (1, 2, "Other places", 50.02, 1.0, None), (1, 3, "Shopping", 50.0, 1.0, False), (1, 4, "Other places", None, None, False), (2, 5, "Other places", 50.0, 1.0, False), (1, 6, "Other places", 50.0, 1.0, True), (2, 7, "Streets and roads", 60.0, 1.0, False)],
        "tid long, id long, category string, lat double, lon double, manually_corrected boolean",
    )
    periods = spark.createDataFrame([(1, 50.0, 1.001, 200.0), (1, 50.0, 1.002, 300.0), (1, 50.02, 1.01, 100.0), (2, 60.0, 1.0, 10.0)], "tid long, lat double, lon double, radius_m double")
    got = {r["id"]: r["category"] for r in places.home_tagged(rows, periods).collect()}
    assert got == {1: "Home", 2: "Other places", 3: "Shopping", 4: "Other places", 5: "Other places", 6: "Other places", 7: "Home"}


def test_imported_trips_stay_out_of_the_runs(spark):
    """Neither kml_import nor photo_import visits join a run; only the latter are trips of their own (app/processing.py:464-469)."""
    kind = "tid long, id long, start_ts long, end_ts long, category string, city string, country string, country_code string, source string, away boolean, near_home boolean"
    rows = [(1, 1, 0, 30_000, "Hotels", "A", "X", "XX", "kml_import", True, False), (1, 2, 40_000, 70_000, "Hotels", "B", "X", "XX", "photo_import", True, False), (2, 3, 0, 30_000, "Hotels", "C", "X", "XX", "owntracks", True, False)]
    segments = spark.createDataFrame([], "tid long, start_ts long, end_ts long")
    got = sorted((r["tid"], r["start_ts"], r["primary_city"]) for r in away.trips(spark.createDataFrame(rows, kind), segments).collect())
    assert got == [(1, 40_000, "B"), (2, 0, "C")]


def test_stop_words(spark):
    """Words of three letters and more, without the stop words (app/images.py:28)."""
    words = lambda x: spark.range(1).select(text.significant_words(F.lit(x)).alias("w")).first()["w"]
    assert words("Die Burg an der Saale") == ["die", "burg", "der", "saale"]
    assert words("The castle of the hill and Les Arcs") == ["castle", "hill", "les", "arcs"]
