"""Deriving again by interval equals a full rebuild after random edits, and leaves what no edit touches."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import away, legs, rederive

V = "tid long, id long, start_ts long, end_ts long, lat double, lon double, category string, city string, country string, country_code string, source string"


def keeping(spark, tmp_path):
    n = iter(range(10_000))
    return lambda df: (df.write.parquet(p := str(tmp_path / f"t{next(n)}")), spark.read.schema(df.schema).parquet(p))[1]


def visits_of(rng, n):
    out, t = [], 0
    for i in range(n):
        t += rng.choice([0, 600, 30_000, 90_000, 200_000])
        kind = rng.choice(["home", "home", "near", "far", "far", "far"])
        lat = {"home": 50.0, "near": 50.1, "far": 51.0}[kind]
        source = rng.choice(["owntracks"] * 5 + ["google_import", "photo_import", "kml_import"])
        out.append((rng.choice([1, 2, 3]), i, t, t + rng.randrange(300, 40_000), lat, 0.0, rng.choice(["Work", "Hotels", None]), rng.choice("ABC"), "X", "XX", source))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trips_equal_a_full_rebuild(spark, tmp_path, seed):
    rng, keep = random.Random(seed), keeping(spark, tmp_path)
    before = visits_of(rng, 150)
    gone = set(rng.sample(range(150), 4))
    after = [r for r in before if r[1] not in gone] + [(*r[:1], 1000 + r[1], *r[2:]) for r in rng.sample(visits_of(rng, 150), 4)]
    segs = spark.createDataFrame([(rng.choice([1, 2, 3]), t, t + rng.randrange(100_000)) for t in range(0, 6_000_000, 70_000)], "tid long, start_ts long, end_ts long")
    p0 = [(t, t, None, None, 50.0, 0.0, 500.0) for t in (1, 2, 3)]
    p1 = [p0[0], (2, 2, None, 3_000_000, 50.0, 0.0, 500.0), (2, 4, 3_000_000, None, 51.0, 0.0, 500.0), p0[2]]
    kind = "tid long, id long, start_ts long, end_ts long, lat double, lon double, radius_m double"
    v0, v1 = (keep(spark.createDataFrame(x, V)) for x in (before, after))
    h0, h1 = (spark.createDataFrame(x, kind) for x in (p0, p1 if seed > 1 else p0))
    old = keep(away.trips(away.with_home(v0, h0), segs))
    changes = rederive.changes_of(v0, v1, ["id"]).unionByName(rederive.period_changes(h0, h1))
    got = rederive.trips(old, v1, segs, h1, changes, keep)
    full = away.trips(away.with_home(v1, h1), segs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect())) != []


def test_what_no_edit_touches_is_kept(spark, tmp_path):
    """Old rows outside the zones stay as they are, even if they couldn't be derived any more."""
    keep = keeping(spark, tmp_path)
    rows = [(1, i, i * 100_000, i * 100_000 + 50_000, 50.0 if i % 3 == 0 else 51.0, 0.0, None, "A", "X", "XX", "owntracks") for i in range(12)]
    h = spark.createDataFrame([(1, 1, None, None, 50.0, 0.0, 500.0)], "tid long, id long, start_ts long, end_ts long, lat double, lon double, radius_m double")
    segs = spark.createDataFrame([], "tid long, start_ts long, end_ts long")
    v = spark.createDataFrame(rows, V)
    old = away.trips(away.with_home(v, h), segs).withColumn("primary_city", F.lit("kept"))
    some = spark.createDataFrame([(1, 420_000, 430_000)], "tid long, a long, b long")
    spans = rederive.zones(some, spark.createDataFrame([(1, i * 300_000) for i in range(4)], "tid long, at long"), keep)
    assert [tuple(r) for r in spans.collect()] == [(1, 300_000, 600_000)]
    got = {r["start_ts"]: r["primary_city"] for r in rederive.trips(old, v, segs, h, some, keep).collect()}
    assert got == {100_000: "kept", 400_000: "A", 700_000: "kept", 1_000_000: "kept"}
    assert rederive.zones(some.limit(0), spark.createDataFrame([(1, 0)], "tid long, at long"), keep).count() == 0


@pytest.mark.parametrize("seed", [4])
def test_legs_equal_a_full_rebuild(spark, tmp_path, seed):
    rng, keep = random.Random(seed), keeping(spark, tmp_path)
    pings, i = [], 0
    for tid in (1, 2):
        for t in range(0, 400_000, 600):
            if rng.random() < 0.8:
                pings.append((tid, i := i + 1, t, 50.0 + t * 1e-6 + rng.random() * 1e-3, 0.0))
    every = [(tid, s, s + rng.randrange(600, 9000)) for tid in (1, 2) for s in range(rng.randrange(5000), 390_000, 20_000)]
    left = [x for x in every if rng.random() > 0.15] + [(1, 77_777, 79_000)]
    p = keep(spark.createDataFrame(pings, "tid long, id long, tst long, lat double, lon double"))
    v0, v1 = (keep(spark.createDataFrame(x, "tid long, start_ts long, end_ts long")) for x in (every, left))
    old = keep(legs.segments(v0, p))
    got = rederive.segments(old, v1, p, rederive.changes_of(v0, v1, ["tid", "start_ts"]), keep)
    key = lambda df: sorted((r["tid"], r["start_ts"], r["end_ts"], round(r["distance_m"], 3), str(r["start_visit"]), str(r["end_visit"])) for r in df.collect())
    assert key(got) == key(legs.segments(v1, p)) != []


def test_zones_that_meet_are_one_across_bins(spark, tmp_path):
    """The second zone begins in a later time bin than the first, inside it."""
    some = spark.createDataFrame([(1, 100, 5_000_000), (1, 3_000_000, 3_000_100), (1, 9_000_000, 9_000_100)], "tid long, a long, b long")
    marks = spark.createDataFrame([(1, t) for t in (0, 2_900_000, 3_100_000, 5_100_000, 8_900_000, 9_100_000)], "tid long, at long")
    got = rederive.zones(some, marks, keeping(spark, tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 5_100_000), (1, 8_900_000, 9_100_000)]
