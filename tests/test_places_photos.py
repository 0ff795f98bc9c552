"""Chains of merged places, and photos around a place and a time."""

import random

from tracemill.operators import overlays, photos, places, routing
from tracemill.operators.stays import _apart
from tracemill.plans import reports


def test_chains_and_circles_of_merges(spark, tmp_path):
    """Merges are followed to the last keeper (app/geocoding.py:302-318, applied again and again)."""
    n = iter(range(10_000))
    keep = lambda df: (df.write.parquet(p := str(tmp_path / f"t{next(n)}")), spark.read.schema(df.schema).parquet(p))[1]
    chain = [(i, i + 1) for i in range(10, 20)]
    circle = [(30, 32), (32, 31), (31, 30), (35, 32), (34, 35)]
    rest = [(40, 40), (50, 52), (50, 51), (51, 53)]
    alias = spark.createDataFrame(chain + circle + rest, "old_id long, new_id long")
    got = {r["old_id"]: r["new_id"] for r in overlays.final_aliases(alias, keep).collect()}
    assert got == {i: 20 for i in range(10, 20)} | {31: 30, 32: 30, 34: 30, 35: 30} | {50: 53, 51: 53}
    assert overlays.final_aliases(alias.limit(0), keep).count() == 0
    places = spark.createDataFrame([(i,) for i in (10, 15, 20, 30, 31, 40, 60)], "id long")
    visits = spark.createDataFrame([(1, 10), (2, 20), (3, 34), (4, 60), (5, None)], "id long, place_id long")
    left, moved = overlays.merged_places(places, visits, alias, keep)
    assert sorted(r["id"] for r in left.collect()) == [20, 30, 40, 60]
    assert {r["id"]: r["place_id"] for r in moved.collect()} == {1: 20, 2: 20, 3: 30, 4: 60, 5: None}


def test_photos_near_a_place_and_a_time(spark):
    """Whole days from first to last, one row a uid, no place at (0, 0) (app/photoprism.py:89-184)."""
    rows = [(1, "a", "1", 86_400, 50.0, 1.0), (1, "a", "0", 86_400, 50.001, 1.0), (1, "b", "0", 3 * 86_400 - 1, 50.0, 1.0), (1, "c", "0", 3 * 86_400, 50.0, 1.0), (1, "d", "0", 90_000, 0.0, 0.0), (2, "e", "0", 90_000, 50.0, 1.0), (1, "f", "0", 90_000, 50.0, 1.0), (1, "g", "0", 90_000, 50.01, 1.0)]
    shot = spark.createDataFrame(rows, "tid long, uid string, file string, taken_ts long, lat double, lon double")
    spots = spark.createDataFrame([(7, 1, 50.0, 1.0, 100_000, 180_000), (8, 2, 51.0, 1.0, 0, 0)], "id long, tid long, lat double, lon double, start_ts long, end_ts long")
    got = [(r["id"], r["uid"], round(r["metres"])) for r in photos.near(spots, shot).orderBy("rank").collect()]
    assert got == [(7, "b", 0), (7, "f", 0), (7, "a", 111)]
    assert [r["uid"] for r in photos.near(spots, shot, most=1).collect()] == ["b"]
    spans = spots.select("id", "tid", "start_ts", "end_ts")
    assert [(r["uid"], r["lat"]) for r in photos.taken_between(spans, shot).where("id = 7").orderBy("rank").collect()] == [("a", 50.001), ("d", None), ("f", 50.0), ("g", 50.01), ("b", 50.0)]
    assert photos.near(spots, shot.limit(0)).count() == 0


def test_nearby_meets_by_spot(spark, monkeypatch):
    """Many points and features on a few spots: spots are paired, not rows, and the result is that of all pairs."""
    rng, met, was = random.Random(3), [], places.radius_join
    spot = lambda: (50.0 + rng.randrange(3) * 0.001, 0.001 * rng.randrange(2))
    points = [(i, *spot()) for i in range(60)]
    features = [(f"n{rng.randrange(12)}" if rng.random() > 0.1 else None, rng.choice(["a", "b", None]), *spot()) for _ in range(300)]
    monkeypatch.setattr(places, "radius_join", lambda *a, **k: (met.append(was(*a, **k)), met[-1])[1])
    got = places.nearby(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(features, "name string, category string, lat double, lon double"), 200.0, most=4)
    want = []
    for i, lat, lon in points:
        near = {}
        for name, category, la, lo in features:
            if name is not None and (m := _apart(lat, lon, la, lo)) <= 200:
                near[name] = min(near.get(name, (1e9,)), (round(m, 2), category is not None, category or ""))
        want += [(i, n, m, c or None, r + 1) for r, (m, n, c) in enumerate(sorted((m, n, c) for n, (m, _, c) in near.items())[:4])]
    assert sorted((r["id"], r["name"], r["metres"], r["category"], r["rank"]) for r in got.collect()) == sorted(want)
    assert met[0].count() <= 36


def test_clusters_are_streamed(spark):
    """Groups that reach over several batches, many groups to a task, cities and people that lack; no call of Python for each group."""
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, None]), rng.choice("AB"), rng.choice(["x", None]), 50.0 + rng.randrange(8) * 0.001, 0.0) for i in range(80)]
    visits = [(rng.randrange(80),) for _ in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = places.greedy_clusters(spark.createDataFrame(rows, "id long, tid long, name string, city string, lat double, lon double"), spark.createDataFrame(visits, "place_id long"))
        got = {r["id"]: r["keeper"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key in {r[1:4] for r in rows}:
        found = []
        for r in sorted(r for r in rows if r[1:4] == key):
            c = next((c for c in found if _apart(sum(x[4] for x in c) / len(c), 0.0, r[4], 0.0) <= 300), None)
            found.append([r]) if c is None else c.append(r)
        for c in found:
            best = min(c, key=lambda r: (-visits.count((r[0],)), r[0]))[0]
            want |= {r[0]: best for r in c}
    assert got == want
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()


def test_requests_of_the_same_ends_are_answered_once(spark, tmp_path):
    """Tables of a round go with the pairs of ends, not with the requests."""
    n, sizes = iter(range(10_000)), []

    def keep(df):
        df.write.parquet(p := str(tmp_path / f"t{next(n)}"))
        out = spark.read.schema(df.schema).parquet(p)
        sizes.append(out.count())
        return out

    edges = [(a, b, 1.0) for i in range(6) for a, b in ((f"n{i}", f"n{i + 1}"), (f"n{i + 1}", f"n{i}"))]
    asked = [(i, "n0", "n6") for i in range(100)] + [(100 + i, "n5", "n2") for i in range(100)] + [(200, "n1", "nowhere")]
    got = routing.shortest_paths(spark.createDataFrame(asked, "id long, src string, dst string"), spark.createDataFrame(edges, "src string, dst string, metres double"), keep).collect()
    assert sorted((r["id"], r["metres"], r["path"][0], len(r["path"])) for r in got) == [(i, 6.0, "n0", 7) for i in range(100)] + [(100 + i, 3.0, "n5", 4) for i in range(100)]
    assert max(sizes) < 50


def test_points_of_one_spot_are_snapped_once(spark, monkeypatch):
    met, was = [], routing.radius_join
    monkeypatch.setattr(routing, "radius_join", lambda *a, **k: (met.append(was(*a, **k)), met[-1])[1])
    points = spark.createDataFrame([(i, 50.0 + i % 2 * 0.01, 1.0) for i in range(40)] + [(99, 60.0, 1.0)], "id long, lat double, lon double")
    nodes = spark.createDataFrame([("a", 50.0, 1.001), ("b", 50.01, 1.0)], "node string, lat double, lon double")
    assert {r["id"]: r["node"] for r in routing.snapped(points, nodes).collect()} == {i: "ab"[i % 2] for i in range(40)}
    assert met[0].count() <= 4


def test_merges_do_not_go_through_the_driver(spark, tmp_path):
    """Small files of ids may hold millions of rows, so no join of them is a broadcast."""
    n = iter(range(10_000))
    keep = lambda df: (df.write.parquet(p := str(tmp_path / f"t{next(n)}")), spark.read.schema(df.schema).parquet(p))[1]
    alias = keep(spark.range(1, 200).selectExpr("id AS old_id", "id - 1 AS new_id"))
    for df in (overlays.final_aliases(alias, keep), *overlays.merged_places(keep(spark.range(200)), keep(spark.range(400).selectExpr("id", "id % 200 AS place_id")), alias, keep)):
        assert df.count() > 0 and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_events_of_spans_through_wide_bins(spark):
    """All pairs, wherever the bins cut; a span of ten days is in two bins at most."""
    rng = random.Random(7)
    spans = [(rng.choice([1, 2]), i, a := rng.randrange(-5_000_000, 5_000_000), a + rng.choice([-5, 0, 1, 864_000, 3_000_000])) for i in range(60)]
    events = [(rng.choice([1, 2]), 1000 + i, rng.choice([rng.randrange(-5_000_000, 5_000_000), rng.choice(spans)[2], rng.choice(spans)[3]])) for i in range(200)]
    s = spark.createDataFrame(spans, "tid long, id long, start_ts long, end_ts long")
    df = reports.during(spark.createDataFrame(events, "tid long, event long, at long"), "at", s)
    want = sorted((e[1], x[1]) for e in events for x in spans if e[0] == x[0] and x[2] <= e[2] < x[3])
    assert sorted((r["event"], r["id"]) for r in df.collect()) == want != []
    assert "1209600" in df._jdf.queryExecution().optimizedPlan().toString()
