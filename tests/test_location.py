"""Location-history operators on small literal cases."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import categories, geo, text
from tracemill.operators import away, legs, overlays, places, routing, sequence, stays
from tracemill.sources import importers
from tracemill.streaming import ingest

PING = "id long, tid long, lat double, lon double, acc double, tst long, source string"
M = 1 / 111_194.926645  # degrees of latitude a metre


def pings(spark, rows):
    """rows of (tst, metres north)"""
    return spark.createDataFrame([(i, 1, 50 + m * M, 0.0, None, t, "owntracks") for i, (t, m) in enumerate(rows)], PING)


def by_hand(points):
    out, i = [], 0
    while i < len(points):
        j, la, n = i, points[i][1], 1
        while j + 1 < len(points) and abs(la / n - points[j + 1][1]) <= 150:
            j += 1
            la, n = la + points[j][1], n + 1
        if points[j][0] - points[i][0] >= 480:
            out.append((points[i][0], points[j][0], n))
            i = j + 1
        else:
            i += 1
    return out


@pytest.mark.parametrize("rows, want", [
    ([], []),
    ([(0, 0)], []),
    ([(0, 0), (864_000, 0)], [(0, 864_000, 2)]),
    ([(0, 0), (300, 140), (600, 0)], [(0, 600, 3)]),
    ([(0, 0), (600, 0), (700, 400), (800, 800), (1500, 810)], [(0, 600, 2), (800, 1500, 2)]),
])
def test_stays_literal(spark, rows, want):
    assert [tuple(r) for r in stays.stays(pings(spark, rows)).select("start_ts", "end_ts", "point_count").orderBy("start_ts").collect()] == want


def test_stays_like_one_scan(spark):
    rng, rows, at = random.Random(1), [], 0.0
    for k in range(600):
        at += rng.choice([0, 5, -5, 40, -60, 120, 320, -350, 1000])
        rows.append((k * 170 + rng.randrange(90), at))
    assert [tuple(r) for r in stays.stays(pings(spark, rows)).select("start_ts", "end_ts", "point_count").orderBy("start_ts").collect()] == by_hand(rows)


def test_trusted(spark):
    rows = [(1, None, "owntracks"), (2, 100.0, "owntracks"), (3, 100.01, "owntracks"), (4, 5.0, "google_raw")]
    df = spark.createDataFrame([(i, 1, 0.0, 0.0, a, i, s) for i, a, s in rows], PING)
    assert sorted(r["id"] for r in stays.trusted(df).collect()) == [1, 2]


def test_merge_at_its_limits(spark):
    rows = [(1, 0, 600, 50.0, 0.0, 3), (1, 600 + 10_800, 20_000, 50 + 249 * M, 0.0, 1), (1, 40_000, 41_000, 50.0, 0.0, 2), (1, 41_100, 42_000, 50 + 600 * M, 0.0, 2)]
    got = stays.merged(spark.createDataFrame(rows, stays.STAY)).orderBy("start_ts").collect()
    assert [(r["start_ts"], r["end_ts"], r["point_count"]) for r in got] == [(0, 20_000, 4), (40_000, 41_000, 2), (41_100, 42_000, 2)]
    assert math.isclose(got[0]["lat"], 50 + 249 * M / 4)


def test_legs_split_at_silence(spark):
    visits = spark.createDataFrame([(1, 0, 1000), (1, 9000, 10_000)], "tid long, start_ts long, end_ts long")
    track = pings(spark, [(1000, 0), (2000, 1000), (3800, 2000), (5601, 3000), (6000, 4000), (6000, 4000), (9000, 4000)])
    got = legs.segments(visits, track).orderBy("start_ts").collect()
    assert [(r["start_ts"], r["end_ts"], round(r["distance_m"]), r["start_visit"], r["end_visit"]) for r in got] == [(1000, 3800, 2000, 0, None), (5601, 6000, 1000, None, None)]
    assert [r["mode"] for r in got] == ["walking", "cycling"]


def test_modes_at_their_limits(spark):
    got = spark.createDataFrame([(7.0,), (7.01,), (25.0,), (25.01,), (140.0,), (140.01,)], "k double").select(geo.mode_of_speed(F.col("k"))).collect()
    assert [r[0] for r in got] == ["walking", "cycling", "cycling", "driving", "driving", "flying"]


def test_chaining(spark):
    rows = [(0, 100, "train"), (100 + 7200, 8000, "train"), (8000 + 7201, 16_000, "train"), (16_001, 16_100, "flying"), (16_101, 16_200, "flying")]
    df = spark.createDataFrame([(a, b, m, 1.0, 1.0, i) for i, (a, b, m) in enumerate(rows)], "start_ts long, end_ts long, mode string, distance_m double, duration_s double, k long").withColumn("tid", F.lit(1))
    df = df.union(spark.createDataFrame([(7000, 7100, "train", 1.0, 1.0, 9, 2)], df.schema))
    every = legs.chained(df, ["k"])
    assert every.where("tid = 2").count() == 1
    got = every.where("tid = 1").orderBy("start_ts").collect()
    assert [(r["mode"], r["n_segments"], r["end_ts"]) for r in got] == [("train", 2, 8000), ("train", 1, 16_000), ("flying", 1, 16_100), ("flying", 1, 16_200)]


HOMED = "id long, tid long, start_ts long, end_ts long, source string, category string, city string, country string, country_code string, away boolean, near_home boolean"
SEG = "tid long, start_ts long, end_ts long"
H = 3600


def trip_spans(spark, rows, segs=()):
    df = spark.createDataFrame([(i, 1, int(a * H), int(b * H), s, c, "X", "Y", "YY", aw, near) for i, (a, b, s, c, aw, near) in enumerate(rows)], HOMED)
    got = away.trips(df, spark.createDataFrame([(1, int(a * H), int(b * H)) for a, b in segs], SEG)).orderBy("start_ts").collect()
    return [(r["start_ts"] / H, r["end_ts"] / H) for r in got]


@pytest.mark.parametrize("rows, segs, want", [
    ([(0, 1, "owntracks", "Home", False, True), (2, 6, "owntracks", "Work", True, True), (7, 8, "owntracks", "Home", False, True)], [], []),
    ([(0, 3, "owntracks", "Hotels", True, False), (4, 5, "owntracks", "Work", True, False), (6, 9, "owntracks", "Hotels", True, False)], [], [(0, 9)]),
    ([(0, 6, "owntracks", "Hotels", True, False), (7, 8, "owntracks", "Home", False, True), (9, 10, "owntracks", "Shopping", True, True)], [], [(0, 6)]),
    ([(0, 6, "owntracks", "Shopping", True, True), (14, 20, "owntracks", "Shopping", True, True)], [], [(0, 20)]),
    ([(0, 6, "owntracks", "Shopping", True, True), (14.1, 21, "owntracks", "Shopping", True, False)], [], [(0, 6), (14.1, 21)]),
    ([(0, 7, "owntracks", "Hotels", True, False), (54, 62, "owntracks", "Airports", True, False)], [(7, 8), (53, 54)], [(0, 7), (54, 62)]),
    ([(0, 7, "owntracks", "Hotels", True, False), (54, 62, "owntracks", "Airports", True, False)], [(7, 8), (20, 40), (45, 54)], [(0, 62)]),
    ([(0, 7, "photo_import", "Hotels", False, False), (8, 9, "photo_import", "Hotels", True, False)], [], [(0, 7)]),
])
def test_trips(spark, rows, segs, want):
    assert trip_spans(spark, rows, segs) == want


def test_home_by_period(spark):
    periods = spark.createDataFrame([(1, 1, None, 100, 50.0, 0.0, 500.0), (2, 1, 100, 200, 51.0, 0.0, 500.0), (0, 2, None, None, 10.0, 0.0, 500.0)], "id long, tid long, start_ts long, end_ts long, lat double, lon double, radius_m double")
    visits = spark.createDataFrame([(1, 1, 50, 60, 50.0, 0.0), (2, 1, 150, 160, 50.0, 0.0), (3, 1, 250, 260, 10.0, 0.0)], "id long, tid long, start_ts long, end_ts long, lat double, lon double")
    got = {r["id"]: (r["home"], r["away"], r["near_home"]) for r in away.with_home(visits, periods).collect()}
    assert got == {1: (1, False, True), 2: (2, True, False), 3: (None, False, False)}


def test_asof_both_ways(spark):
    left = spark.createDataFrame([(1, 5), (2, 10), (3, 0)], "id long, t long")
    right = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (9, "c", 3)], "at_ts long, v string, k long")
    back = {r["id"]: r["asof"]["v"] if r["asof"] else None for r in sequence.asof(left, right, "t", "at_ts", ["v"], tie=["k"]).collect()}
    ahead = {r["id"]: r["asof"]["v"] if r["asof"] else None for r in sequence.asof(left, right, "t", "at_ts", ["v"], forward=True, tie=["k"]).collect()}
    assert back == {1: "b", 2: "c", 3: None} and ahead == {1: "a", 2: None, 3: "a"}


def test_overlap_join_equals_nested_loop(spark):
    rng = random.Random(3)
    a = [(i, s := rng.randrange(900_000), s + rng.randrange(400_000)) for i in range(60)]
    b = [(i, s := rng.randrange(900_000), s + rng.randrange(100_000)) for i in range(60)]
    left = spark.createDataFrame([(0, *x) for x in a], "k long, a long, a0 long, a1 long")
    right = spark.createDataFrame([(0, *x) for x in b], "k long, b long, b0 long, b1 long")
    got = sorted((r["a"], r["b"]) for r in sequence.overlap_join(left, right, ("a0", "a1"), ("b0", "b1"), ["k"]).collect())
    assert got == sorted((x[0], y[0]) for x, y in itertools.product(a, b) if x[1] <= y[2] and x[2] >= y[1])


def test_radius_join_equals_nested_loop(spark):
    rng = random.Random(4)
    pts = [(i, 60 + rng.random() * 0.1, rng.random() * 0.2) for i in range(80)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = sorted((r["id"], r["other"]) for r in geo.radius_join(df, df, 1500, {"id": "other", "lat": "la", "lon": "lo"}).collect())
    assert got == sorted((p[0], q[0]) for p, q in itertools.product(pts, pts) if stays._apart(p[1], p[2], q[1], q[2]) <= 1500)


def test_overlays(spark):
    seg = spark.createDataFrame([(1, "walking", 0, 10, "owntracks"), (2, "bus", 20, 30, "owntracks")], "id long, mode string, start_ts long, end_ts long, source string").withColumn("tid", F.lit(1))
    edits = spark.createDataFrame([(1, "train", 1), (1, "tram", 2)], "id long, mode string, edited_at long")
    assert {r["id"]: r["mode"] for r in overlays.patched(seg, edits, ["id"], ["mode"]).collect()} == {1: "tram", 2: "bus"}
    visits = spark.createDataFrame([(1, 0, 10, "owntracks", 5), (2, 50, 60, "google_import", 6), (3, 70, 80, "manual", 5)], "id long, start_ts long, end_ts long, source string, place_id long").withColumn("tid", F.lit(1))
    merged, kept = overlays.merged_into_previous(visits, seg, spark.createDataFrame([(2,)], "id long"))
    assert sorted((r["id"], r["end_ts"]) for r in merged.collect()) == [(1, 60), (3, 80)] and kept.count() == 0
    new = spark.createDataFrame([(9, 5, 25, "manual", 7, 1)], visits.schema)
    v, s = overlays.manual_visit(visits, seg, new)
    assert sorted(r["id"] for r in v.collect()) == [2, 3, 9] and s.count() == 0
    v, s = overlays.manual_visit(visits, seg, new.withColumn("end_ts", F.lit(55).cast("long")))
    assert sorted(r["id"] for r in v.collect()) == [1, 2, 3] and s.count() == 2
    alias = spark.createDataFrame([(5, 6)], "old_id long, new_id long")
    assert {r["place_id"] for r in overlays.repointed(visits, alias).collect()} == {6}
    phantom = spark.createDataFrame([(1, 7200, 14400, "google_import", 1), (2, 7201, 14401, "google_import", 1), (3, 7200, 14400, "manual", 1)], visits.drop("tid").schema)
    assert sorted(r["id"] for r in overlays.without_phantoms(phantom).collect()) == [2, 3]


def test_edits_of_one_person_leave_others(spark):
    seg = spark.createDataFrame([(t, 10 * t + 1, 0, 10, "owntracks") for t in (1, 2)], "tid long, id long, start_ts long, end_ts long, source string")
    visits = spark.createDataFrame([(t, 10 * t + i, 20 * i, 20 * i + 10, "owntracks", 5) for t in (1, 2) for i in (0, 1, 2)], "tid long, id long, start_ts long, end_ts long, source string, place_id long")
    merged, kept = overlays.merged_into_previous(visits, seg, spark.createDataFrame([(11,), (20,)], "id long"))
    assert sorted((r["id"], r["end_ts"]) for r in merged.collect()) == [(10, 30), (12, 50), (20, 10), (21, 30), (22, 50)] and [r["tid"] for r in kept.collect()] == [2]
    v, s = overlays.manual_visit(visits, seg, spark.createDataFrame([(1, 99, 5, 25, "manual", 6)], visits.schema))
    assert sorted(r["id"] for r in v.collect()) == [12, 20, 21, 22, 99] and [r["tid"] for r in s.collect()] == [2]
    stops = spark.createDataFrame([(11, 77, 50.0, 0.0, 8)], "sid long, new_id long, lat double, lon double, place_id long")
    v, s = overlays.converted_to_visits(visits, seg.withColumnRenamed("id", "sid"), stops.withColumnRenamed("new_id", "id"), ["sid"])
    made = v.where("id = 77").first()
    assert (made["tid"], made["start_ts"], made["end_ts"], made["source"], made["place_id"], v.count(), s.count()) == (1, 0, 10, "owntracks", 8, 7, 1)


def test_names_from_answers(spark):
    p = spark.createDataFrame(
        [(1, "g1", "Wirtshaus", "München", None, None, "Other places", False), (2, "g2", "Rynek", "Kraków", None, None, "Streets and roads", False), (3, "g3", "X", None, None, None, "Hotels", False), (4, "g1", "Y", "Z", None, None, "Other places", True), (5, None, None, None, None, None, "Other places", None)],
        "id long, google_place_id string, name string, city string, name_local string, city_local string, category string, manually_corrected boolean",
    )
    english = overlays.renamed(p, spark.createDataFrame([(1, "Wirtshaus", "Munich"), (2, None, "Kraków"), (5, "New", "New")], "id long, name string, city string"))
    assert {r["id"]: (r["name"], r["city"], r["name_local"], r["city_local"]) for r in english.collect()} == {1: ("Wirtshaus", "Munich", None, "München"), 2: ("Rynek", "Kraków", None, None), 3: ("X", None, None, None), 4: ("Y", "Z", None, None), 5: (None, None, None, None)}
    details = spark.createDataFrame([("g1", "Zum Bären", "Food and drink"), ("g2", " kraków", None), ("g3", "Inn", "Hotels")], "google_place_id string, vendor_name string, vendor_category string")
    assert {r["id"]: (r["name"], r["category"]) for r in overlays.vendor_named(p, details).collect()} == {1: ("Zum Bären", "Food and drink"), 2: ("Rynek", "Streets and roads"), 3: ("X", "Hotels"), 4: ("Y", "Other places"), 5: (None, "Other places")}
    trips = spark.createDataFrame([(1, 1, 86400 * 10 + 5, 86400 * 12 + 7, None), (1, 2, 86400 * 10, 86400 * 13, "old"), (2, 3, 86400 * 10, 86400 * 12, "other")], "tid long, id long, start_ts long, end_ts long, name string")
    folders = spark.sql("SELECT 1 AS tid, 'B' AS folder, DATE'1970-01-11' AS first_day, DATE'1970-01-13' AS last_day UNION ALL SELECT 1, 'A', DATE'1970-01-11', DATE'1970-01-13'")
    assert {r["id"]: r["name"] for r in overlays.relabelled(trips, folders).collect()} == {1: "A", 2: "old", 3: "other"}


def test_place_resolution(spark):
    known = spark.createDataFrame([(0, 1, "k1", "Inn", "C", "Hotels", 50.0, 0.0), (0, 2, None, "Home", None, "Home", 51.0, 0.0), (9, 3, "k1", "Inn", "C", "Home", 50.0, 0.0)], "tid long, id long, google_place_id string, name string, city string, category string, lat_round double, lon_round double").withColumns({"lat": F.col("lat_round"), "lon": F.col("lon_round")})
    periods = spark.createDataFrame([(0, 1, 51.0, 0.0, 500.0), (9, 2, 53.0, 0.0, 900.0)], "tid long, id long, lat double, lon double, radius_m double")
    at = [("k1", 10.0, 0.0), (None, 50.00001, 0.0), (None, 51 + 300 * M, 0.0), (None, 50 + 200 * M, 0.0), (None, 52.0, 0.0), (None, 52.00001, 0.0), (None, 53.0, 0.0), ("k9", 54.0, 0.0)]
    visits = spark.createDataFrame([(0, i, k, a, b) for i, (k, a, b) in enumerate(at)], "tid long, id long, place_key string, lat double, lon double")
    answers = spark.createDataFrame([(round(50 + 200 * M, 4), 0.0, "Inn", "C", "Hotels"), (52.0, 0.0, "Inn", "C", "Hotels")], "lat_round double, lon_round double, name string, city string, category string")
    done, made = places.resolved_or_made(visits, known, periods, answers)
    got = {r["id"]: r["place_id"] for r in done.collect()}
    new = {r["id"]: r for r in made.collect()}
    assert [got[i] for i in range(4)] == [1, 1, 2, 1] and got[4] == got[5] and len(new) == 3
    assert (new[got[4]]["name"], new[got[6]]["category"], new[got[7]]["google_place_id"]) == ("Inn", "Other places", "k9")


def test_places(spark):
    rows = [(1, 0, "Inn", "C", 50.0, 0.0), (2, 0, "Inn", "C", 50 + 250 * M, 0.0), (3, 0, "Inn", "C", 50 + 500 * M, 0.0), (4, 0, "Inn", "D", 50.0, 0.0), (5, 0, None, "C", 50.0, 0.0), (6, 1, "Inn", "C", 50.0, 0.0), (7, 0, "Inn", None, 50.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, tid long, name string, city string, lat double, lon double")
    assert {r["id"]: r["keeper"] for r in places.greedy_clusters(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 6: 6, 7: 7}
    visits = spark.createDataFrame([(2,), (2,), (1,)], "place_id long")
    assert {r["id"]: r["keeper"] for r in places.greedy_clusters(df, visits).collect()} == {1: 2, 2: 2, 3: 3, 4: 4, 6: 6, 7: 7}
    assert [tuple(r) for r in places.similar(df).select("id", "other").orderBy("id", "other").collect()] == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


def test_shortest_paths(spark, tmp_path):
    rng, n = random.Random(5), iter(range(10_000))
    keep = lambda df: (df.write.parquet(p := str(tmp_path / f"t{next(n)}")), spark.read.schema(df.schema).parquet(p))[1]
    edges = {(a, b): rng.randrange(1, 50) for a in range(14) for b in range(14) if a < b and rng.random() < 0.25}
    both = [(str(a), str(b), float(w)) for (a, b), w in edges.items()] + [(str(b), str(a), float(w)) for (a, b), w in edges.items()]
    dist = {(a, b): 0 if a == b else min((w for x, y, w in both if (x, y) == (str(a), str(b))), default=math.inf) for a in range(14) for b in range(14)}
    for k, a, b in itertools.product(range(14), repeat=3):
        dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
    asked = spark.createDataFrame([(i, "0", str(i)) for i in range(14)], "id long, src string, dst string")
    got = {r["id"]: r["metres"] for r in routing.shortest_paths(asked, spark.createDataFrame(both, "src string, dst string, metres double"), keep).collect()}
    assert got == {i: dist[0, i] for i in range(14) if dist[0, i] < math.inf}


def test_paths_over_lines_and_circles(spark, tmp_path):
    """A ring of lines between junctions, a spur, parallel lines and a circle apart: every path is a walk of its length, and the shortest."""
    n = iter(range(10_000))
    keep = lambda df: (df.write.parquet(p := str(tmp_path / f"t{next(n)}")), spark.read.schema(df.schema).parquet(p))[1]
    walk = lambda names, w: [(a, b, w) for a, b in zip(names, names[1:], strict=False)]
    one = walk(["A", *[f"p{i}" for i in range(30)], "B"], 1.0) + walk(["A", "q0", "q1", "B"], 20.0) + walk(["B", *[f"r{i}" for i in range(9)], "C"], 2.0) + walk(["C", "s0", "A"], 30.0) + walk(["C", "t0", "t1"], 1.0) + walk(["u0", "u1", "u2", "u0"], 1.0) + [("A", "C", 80.0)]
    both = {(a, b): w for x, y, w in one for a, b in ((x, y), (y, x))}
    nodes = sorted({a for a, _ in both})
    dist = {(a, b): 0.0 if a == b else both.get((a, b), math.inf) for a in nodes for b in nodes}
    for k, a, b in itertools.product(nodes, repeat=3):
        dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
    ends = [("A", "B"), ("p3", "q1"), ("p29", "s0"), ("t1", "p10"), ("p5", "p9"), ("r4", "r4"), ("u1", "A"), ("u0", "u2"), ("s0", "A")]
    asked = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ends)], "id long, src string, dst string")
    got = {r["id"]: r for r in routing.shortest_paths(asked, spark.createDataFrame([(a, b, w) for (a, b), w in both.items()], "src string, dst string, metres double"), keep).collect()}
    for i, (a, b) in enumerate(ends):
        if dist[a, b] == math.inf:
            assert i not in got
            continue
        path = got[i]["path"]
        assert (path[0], path[-1]) == (a, b) and sum(both[x, y] for x, y in zip(path, path[1:], strict=False)) == got[i]["metres"] == dist[a, b]


def test_categories_and_text(spark):
    df = spark.createDataFrame([({"shop": "bakery", "name": "x"}, "amenity", "cafe"), ({"amenity": "bench", "leisure": "park"}, "shop", None), ({}, None, None)], "tags map<string,string>, k string, v string")
    got = df.select(categories.category_of_tags(F.col("tags")), categories.category_of(F.col("k"), F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("Shopping", "Food and drink"), ("Parks and nature", "Shopping"), ("Other places", "Other places")]
    names = spark.createDataFrame([("gb", "x"), ("QQ", "Else"), (None, "Z")], "c string, f string").select(categories.country_name(F.col("c"), F.col("f"))).collect()
    assert [r[0] for r in names] == ["United Kingdom", "Else", "Z"]
    row = spark.createDataFrame([("Café de l'Été!", "The Ete", "!!")], "a string, b string, c string").select(text.slug(F.col("a")), text.slug(F.col("c")), text.plausible_match(F.col("a"), F.col("b")), text.unix_of_iso(F.lit("2024-01-01T01:00:00+01:00")), text.unix_of_iso(F.lit("bad"))).first()
    assert tuple(row) == ("caf-de-l-t", "unknown", True, 1704067200, None)


def test_importers(spark, tmp_path):
    segs = [
        {"startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-01T01:00:00Z", "visit": {"topCandidate": {"placeId": "p", "placeLocation": {"latLng": "52.1°, -0.4°"}}}},
        {"startTime": "2024-01-01T01:00:00Z", "endTime": "2024-01-01T02:00:00Z", "activity": {"distanceMeters": 12.5, "topCandidate": {"type": "IN_BUS"}}},
        {"startTime": "2024-01-01T02:00:00Z", "endTime": "2024-01-01T03:00:00Z", "activity": {"topCandidate": {"type": "STILL"}}},
        {"startTime": "bad", "endTime": "2024-01-01T03:00:00Z", "visit": {"topCandidate": {"placeLocation": {"latLng": "1°, 2°"}}}},
        {"startTime": "2024-01-01T04:00:00Z", "endTime": "2024-01-01T05:00:00Z", "timelinePath": [{"point": "10.0°, 20.0°"}, {"point": "10.001°, 20.0°"}]},
        {"startTime": "2024-01-01T05:00:00Z", "endTime": "2024-01-01T06:00:00Z", "timelinePath": [{"point": "10.0°, 20.0°"}, {"point": "10.1°, 20.0°"}]},
    ]
    (tmp_path / "timeline.json").write_text(json.dumps({"semanticSegments": segs}))
    entries = importers.timeline(spark, str(tmp_path / "timeline.json"))
    assert [(r["lat"], r["lon"], r["start_ts"]) for r in importers.timeline_visits(entries).collect()] == [(52.1, -0.4, 1704067200)]
    assert [(r["mode"], r["distance_m"], r["duration_s"]) for r in importers.timeline_segments(entries).collect()] == [("bus", 12.5, 3600.0)]
    assert [r["point_count"] for r in importers.stationary_paths(entries).collect()] == [2]
    assert importers.timeline(spark, str(tmp_path / "timeline.json"), since=1704067200 + 3600).count() == 4
    (tmp_path / "raw.json").write_text(json.dumps({"rawSignals": [{"position": {"LatLng": "1.5°, 2.5°", "timestamp": "2024-01-01T00:00:00Z", "accuracyMeters": 7}}, {"position": {"timestamp": "2024-01-01T00:00:00Z"}}, {"wifi": 1}]}))
    assert [(r["lat"], r["acc"], r["tid"]) for r in importers.raw_signals(spark, str(tmp_path / "raw.json")).collect()] == [(1.5, 7.0, "goog")]
    side = tmp_path / "photos"
    side.mkdir()
    (side / "a.json").write_text(json.dumps({"photoTakenTime": {"timestamp": "100"}, "geoData": {"latitude": 0, "longitude": 0}, "geoDataExif": {"latitude": 3.0, "longitude": 4.0}}))
    (side / "b.json").write_text(json.dumps({"photoTakenTime": {"timestamp": "200"}}))
    assert sorted((r["taken_ts"], r["lat"]) for r in importers.photos(spark, str(side)).collect()) == [(100, 3.0), (200, None)]
    mark = lambda n, d: f"<Placemark><name>{n}</name><description>{d}</description><Point><coordinates>1.0,2.0,0</coordinates></Point></Placemark>"
    (tmp_path / "t.kml").write_text(f"<kml><Folder><name>F</name>{mark('a', '')}{mark('b', 'on 02Jan2020')}{mark('c', '')}{mark('d', '05Jan2020')}</Folder></kml>")
    got = importers.planned_stops(spark, str(tmp_path / "t.kml")).orderBy("position").collect()
    assert [str(r["day"]) for r in got] == ["2020-01-02", "2020-01-02", "2020-01-02", "2020-01-05"] and got[0]["lat"] == 2.0
    have = spark.createDataFrame([(1, 0, 100), (1, 200, 300), (2, 100, 200)], "tid long, start_ts long, end_ts long")
    offered = spark.createDataFrame([(1, 50, 60), (1, 100, 200), (1, 290, 400), (2, 50, 60)], have.schema)
    assert sorted((r["tid"], r["start_ts"]) for r in importers.not_overlapping(offered, have).collect()) == [(1, 100), (2, 50)]


def test_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    rng, rows = random.Random(6), []
    for k in range(240):
        rows.append({"_type": "location", "tid": f"dev{k % 2}-too-long", "lat": 50 + (k // 40) * 0.01 + rng.random() * 1e-4, "lon": 0.0, "tst": k * 60, "acc": None})
    rows += [{"_type": "lwt", "tid": "x", "tst": 1}, {"_type": "location", "tid": "x", "tst": 5}]
    rng.shuffle(rows)
    for i in range(3):
        (inbox / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i::3]))
    shaped = lambda df: df.withColumn("tid", F.substring("tid", 4, 1).try_cast("long")).withColumn("id", F.col("tst"))
    stream = shaped(ingest.ping_stream(spark, str(inbox)))
    ingest.derive_on_arrival(stream, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = stays.merged(stays.stays(shaped(importers.pings_of(spark.read.schema(importers.PING).json(str(inbox))))))
    key = lambda df: sorted((r["tid"], r["start_ts"], r["end_ts"], r["point_count"]) for r in df.collect())
    assert key(ingest.latest_stays(spark, str(tmp_path / "out"))) == key(batch) != []
    ingest.append_pings(ingest.ping_stream(spark, str(inbox)), str(tmp_path / "pings"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "pings")).count() == 240


def test_routes_via_hubs(spark, tmp_path):
    """On a line of longitude only neighbours at most 0.2 degrees apart have a direct route."""
    n = iter(range(10_000))
    keep = lambda df: (df.write.parquet(p := str(tmp_path / f"h{next(n)}")), spark.read.schema(df.schema).parquet(p))[1]
    spot = lambda a, b: F.concat_ws(":", F.round(a, 3).cast("string"), F.round(b, 3).cast("string"))
    direct = lambda legs: legs.where(F.abs(F.col("lat2") - F.col("lat1")) <= 0.2001).select("leg", geo.metres("lat1", "lon1", "lat2", "lon2").alias("metres"), F.array(spot("lat1", "lon1"), spot("lat2", "lon2")).alias("path"))
    hubs = spark.createDataFrame([("a", 50.2, 0.0), ("b", 50.4, 0.0), ("c", 50.6, 0.0), ("far", 50.4, 30.0)], "hub string, hlat double, hlon double")
    asked = spark.createDataFrame([(1, 50.0, 0.0, 50.1, 0.0), (2, 50.0, 0.0, 50.8, 0.0), (3, 50.0, 0.0, 58.0, 0.0)], "id long, lat1 double, lon1 double, lat2 double, lon2 double")
    got = {r["id"]: (len(r["path"]), round(r["metres"])) for r in routing.via_hubs(asked, hubs, direct, keep).collect()}
    assert got == {1: (2, 11119), 2: (5, 88956)}


def test_routes_via_hubs_of_any_number(spark, tmp_path):
    n = iter(range(10_000))
    keep = lambda df: (df.write.parquet(p := str(tmp_path / f"m{next(n)}")), spark.read.schema(df.schema).parquet(p))[1]
    direct = lambda legs: legs.where(F.abs(F.col("lat2") - F.col("lat1")) <= 0.2001).select("leg", geo.metres("lat1", "lon1", "lat2", "lon2").alias("metres"), F.array(F.col("lat1").cast("string"), F.col("lat2").cast("string")).alias("path"))
    hubs = spark.createDataFrame([(f"far{i}", 50.2, 30.0) for i in range(1500)] + [("z", 50.2, 0.0)], "hub string, hlat double, hlon double").coalesce(1)
    asked = spark.createDataFrame([(1, 50.0, 0.0, 50.4, 0.0)], "id long, lat1 double, lon1 double, lat2 double, lon2 double")
    assert [len(r["path"]) for r in routing.via_hubs(asked, hubs, direct, keep).collect()] == [3]


def test_rail_route_of_all_places(spark):
    """Against plain shortest paths between the nearest grid nodes of all places."""
    import heapq
    from math import asin, cos, radians, sin, sqrt

    from tracemill.plans.fixtures import frame
    from tracemill.plans.operator_queries import rail_route

    def far(a, b):
        h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371000 * asin(sqrt(h))

    at = {(i, j): (50 + i * 0.01, j * 0.01) for i in range(12) for j in range(12)}
    near = {(i, j): [n for n in ((i, j - 1), (i, j + 1), *(((i - 1, j), (i + 1, j)) if j % 3 == 0 else ())) if n in at] for i, j in at}
    snapped, tied = [], set()
    for r in frame(spark, "/root/testdata/sf0.001", "places").orderBy("id").collect():
        first, second = sorted((far((float(r["lat"]), float(r["lon"])), p), n) for n, p in at.items())[:2]
        if first[0] <= 2000:
            snapped.append((r["tid"], r["id"], first[1]))
            if second[0] - first[0] < 0.001:
                tied.add(r["id"])  # which of two nodes as near is taken depends on rounding
    want = {}
    snapped.sort()
    for (tid, id_, src), (next_tid, next_, dst) in zip(snapped, snapped[1:], strict=False):
        if tid != next_tid:
            continue
        best, heap = {}, [(0.0, src)]
        while heap:
            d, n = heapq.heappop(heap)
            if n not in best:
                best[n] = d
                for m in near[n]:
                    heapq.heappush(heap, (d + far(at[n], at[m]), m))
        want[id_] = best[dst] if not {id_, next_} & tied else None
    got = {r["id"]: r["metres"] for r in rail_route(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(want) and len(got) > 20
    assert sum(w is not None for w in want.values()) > 10 and all(abs(got[i] - w) < 0.2 for i, w in want.items() if w is not None)


def test_pings_are_clustered_once_for_merging(spark):
    """Merging looks at its candidates twice; the clustering in Python is done before, once."""
    rows = [(1, i, i * 60, 50.0 + (i // 40) * 0.01, 0.0, None, "owntracks") for i in range(120)]
    df = spark.createDataFrame(rows, "tid long, id long, tst long, lat double, lon double, acc double, source string")
    out = stays.merged(stays.stays(df))
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["start_ts"], r["end_ts"], r["point_count"]) for r in out.collect()) == [(0, 2340, 40), (2400, 4740, 40), (4800, 7140, 40)]
