"""Timeline and drawing helpers on literal cases."""

import math

from pyspark.sql import functions as F

from tracemill.operators import timeline

V = "tid long, id long, start_ts long, end_ts long, place_id long"
S = "tid long, id long, start_ts long, end_ts long, distance_m double"


def test_flanks_and_closing_visit(spark):
    visits = spark.createDataFrame([(1, 1, 0, 10, 5), (1, 2, 20, 30, None), (2, 11, 0, 5, 5)], V)
    segs = spark.createDataFrame([(1, 7, 10, 20, 1.0), (1, 8, 20, 25, 3.0), (1, 9, 40, 50, 2.0)], S)
    line = timeline.merged_timeline(visits, segs)
    assert [(r["kind"], r["id"]) for r in line.where("tid = 1").orderBy("position").collect()] == [("visit", 1), ("segment", 7), ("visit", 2), ("segment", 8), ("segment", 9)]
    flanked = timeline.flanks(line)
    assert {r["id"]: (r["before"], r["after"]) for r in flanked.collect()} == {7: (1, 2), 8: (2, None), 9: (2, None)}
    shared = {r["id"]: (r["from_share"], r["to_share"]) for r in timeline.shares_of_span(flanked).collect()}
    assert shared == {7: (0.0, 1.0), 8: (0.0, 0.6), 9: (0.6, 1.0)}
    more = visits.union(spark.createDataFrame([(1, 3, 45, 500, 6), (1, 4, 45, 500, None), (2, 5, 45, 500, 6)], V))
    closed = timeline.with_closing_visit(line, more).where("tid = 1").orderBy("position").collect()
    assert timeline.with_closing_visit(line, more).where("tid = 2").count() == 1
    assert (closed[-1]["id"], closed[-1]["start_ts"], closed[-1]["end_ts"], len(closed)) == (3, 50, 500, 6)
    ends_there = visits.union(spark.createDataFrame([(1, 6, 40, 50, 7)], V))
    closed = timeline.with_closing_visit(line, ends_there).where("tid = 1").orderBy("position").collect()
    assert (closed[-1]["id"], closed[-1]["start_ts"], closed[-1]["end_ts"]) == (6, 50, 50)


def test_chunks_and_slices(spark):
    pts = spark.createDataFrame([(1, i, 50.0, i * 0.001) for i in range(20)], "k long, idx long, lat double, lon double")
    got = {}
    for r in timeline.chunks(pts, ["k"]).collect():
        got.setdefault(r["chunk"], []).append(r["idx"])
    assert {c: sorted(v) for c, v in got.items()} == {0: list(range(10)), 1: list(range(9, 19)), 2: [18, 19]}
    half = timeline.at_share(pts, ["k"], 0.5).first()
    assert math.isclose(half["lon"], 0.0095, rel_tol=1e-6) and half["lat"] == 50.0
    end = timeline.at_share(pts, ["k"], 1.0).first()
    assert math.isclose(end["lon"], 0.019)


def test_calendar_cell(spark):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-07",), ("2024-01-08",), ("2023-01-01",), ("2023-01-02",)], "d string").select(F.to_date("d").alias("d"))
    week, weekday = timeline.calendar_cell(F.col("d"))
    assert [tuple(r) for r in days.select(week, weekday).collect()] == [(0, 0), (0, 6), (1, 0), (0, 6), (1, 0)]
