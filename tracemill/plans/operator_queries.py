"""Queries that apply the sequence, join and edit operators to the driver's tables, each with an independent check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import away, legs, overlays, photos as photo_ops, places, rederive, routing, scan, sequence, stays
from ..storage import keeper, shared
from ..streaming import ingest
from ..streaming.pinglog import PingLog
from . import documents
from .checks import CHAIN, CHECKS as REPORT_CHECKS, with_ends
from .dialect import CHECK
from .fixtures import frame
from .reports import A_DAY, SEGMENT_KEYS, placed, top

QUERIES, CHECKS = {}, {}


def op(name: str, check: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if check is not None:
            CHECKS[name] = check.strip()
        return f

    return keep


M = CHECK.metres
TRUSTED = "t AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY tst, id) AS i FROM pings WHERE source = 'owntracks' AND (acc IS NULL OR acc <= 100))"
# The scan as a recursion over the whole track of each device: a state is a run of pings i..k with its sums.
SCAN = f"""{TRUSTED},
s AS (
  SELECT tid, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS k, lat AS la, lon AS lo, CAST(1 AS BIGINT) AS n, tst AS t0, tst AS t1,
         CAST(NULL AS BIGINT) AS o0, CAST(NULL AS BIGINT) AS o1, CAST(NULL AS DOUBLE) AS ola, CAST(NULL AS DOUBLE) AS olo, CAST(NULL AS BIGINT) AS o_n FROM t WHERE i = 1
  UNION ALL
  SELECT x.tid, CASE WHEN x.ext THEN x.i ELSE r.i END, CASE WHEN x.ext THEN x.k + 1 ELSE r.i END, CASE WHEN x.ext THEN x.la + x.nla ELSE r.lat END, CASE WHEN x.ext THEN x.lo + x.nlo ELSE r.lon END,
         CASE WHEN x.ext THEN x.n + 1 ELSE 1 END, CASE WHEN x.ext THEN x.t0 ELSE r.tst END, CASE WHEN x.ext THEN x.nt ELSE r.tst END,
         CASE WHEN NOT x.ext AND x.fin THEN x.t0 END, CASE WHEN NOT x.ext AND x.fin THEN x.t1 END, CASE WHEN NOT x.ext AND x.fin THEN x.la / x.n END, CASE WHEN NOT x.ext AND x.fin THEN x.lo / x.n END, CASE WHEN NOT x.ext AND x.fin THEN x.n END
  FROM (SELECT s.*, b.lat AS nla, b.lon AS nlo, b.tst AS nt, coalesce({M('s.la / s.n', 's.lo / s.n', 'b.lat', 'b.lon')} <= 150, false) AS ext, s.t1 - s.t0 >= 480 AS fin
        FROM s LEFT JOIN t b ON b.tid = s.tid AND b.i = s.k + 1 WHERE s.i IS NOT NULL) x
  LEFT JOIN t r ON r.tid = x.tid AND r.i = CASE WHEN x.fin THEN x.k + 1 ELSE x.i + 1 END
),
stay AS (SELECT tid, o0 AS start_ts, o1 AS end_ts, ola AS lat, olo AS lon, o_n AS n, row_number() OVER (PARTITION BY tid ORDER BY o0) AS r FROM s WHERE o0 IS NOT NULL),
f AS (
  SELECT tid, r, start_ts, end_ts, lat, lon, n, CAST(1 AS BIGINT) AS g FROM stay WHERE r = 1
  UNION ALL
  SELECT b.tid, b.r, CASE WHEN m THEN a.start_ts ELSE b.start_ts END, b.end_ts, CASE WHEN m THEN (a.lat * a.n + b.lat * b.n) / (a.n + b.n) ELSE b.lat END,
         CASE WHEN m THEN (a.lon * a.n + b.lon * b.n) / (a.n + b.n) ELSE b.lon END, CASE WHEN m THEN a.n + b.n ELSE b.n END, CASE WHEN m THEN a.g ELSE a.g + 1 END
  FROM (SELECT f.*, b0.start_ts - f.end_ts <= 10800 AND {M('f.lat', 'f.lon', 'b0.lat', 'b0.lon')} <= 250 AS m FROM f JOIN stay b0 ON b0.tid = f.tid AND b0.r = f.r + 1) a JOIN stay b ON b.tid = a.tid AND b.r = a.r + 1
),
merged AS (SELECT tid, g, min(start_ts) AS start_ts, max(end_ts) AS end_ts, max(n) AS n FROM f GROUP BY tid, g)"""


@op("stay_points", f"WITH RECURSIVE {SCAN} SELECT CAST(tid AS BIGINT) AS tid, start_ts, end_ts, n AS point_count FROM stay")
def stay_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stays.stays(frame(spark, sf_dir, "pings"))
    return rows.select("tid", "start_ts", "end_ts", F.col("point_count").cast("long").alias("point_count"))


@op("merged_visits", f"WITH RECURSIVE {SCAN} SELECT CAST(tid AS BIGINT) AS tid, start_ts, end_ts, n AS point_count FROM merged")
def merged_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stays.merged(stays.stays(frame(spark, sf_dir, "pings"))).select("tid", "start_ts", "end_ts", F.col("point_count").cast("long").alias("point_count"))


LEGS = f"""
g AS (SELECT tid, start_ts AS v, end_ts AS a, lead(start_ts) OVER (PARTITION BY tid ORDER BY start_ts, end_ts) AS b FROM merged),
o AS (SELECT tid, tst, max_by(lat, id) AS lat, max_by(lon, id) AS lon FROM t GROUP BY tid, tst),
l AS (SELECT g.tid, g.v, g.b, o.tst, o.tst - lag(o.tst) OVER w AS dt, {M('lag(o.lat) OVER w', 'lag(o.lon) OVER w', 'o.lat', 'o.lon')} AS hop
      FROM g JOIN o ON o.tid = g.tid AND o.tst >= g.a AND o.tst <= g.b WINDOW w AS (PARTITION BY g.tid, g.v ORDER BY o.tst)),
p AS (SELECT *, sum(CASE WHEN dt > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY tid, v ORDER BY tst ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM l),
q AS (SELECT tid, v, b, part, min(tst) AS start_ts, max(tst) AS end_ts, sum(CASE WHEN dt <= 1800 THEN hop ELSE 0 END) AS d, count(*) AS n FROM p GROUP BY tid, v, b, part),
z AS (SELECT *, max(part) OVER (PARTITION BY tid, v) AS last FROM q)"""


@op("segments", f"""WITH RECURSIVE {SCAN}, {LEGS}
SELECT CAST(tid AS BIGINT) AS tid, start_ts, end_ts, CASE WHEN k > 140 THEN 'flying' WHEN k > 25 THEN 'driving' WHEN k > 7 THEN 'cycling' ELSE 'walking' END AS mode, round(d, 2) AS distance_m,
       CASE WHEN part = 0 THEN v END AS start_visit, CASE WHEN part = last THEN b END AS end_visit
FROM (SELECT *, (d / 1000) / ((end_ts - start_ts) / 3600.0) AS k FROM z WHERE n >= 2 AND d >= 20 AND end_ts > start_ts) y""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = keeper(spark, "segments")
    trusted = keep(stays.trusted(frame(spark, sf_dir, "pings")).select("tid", "id", "tst", "lat", "lon"))
    visits = keep(stays.merged(stays.clustered_islands(stays.ping_islands(trusted))))
    return legs.segments(visits, trusted).select("tid", "start_ts", "end_ts", "mode", F.round("distance_m", 2).alias("distance_m"), "start_visit", "end_visit")


@op("gap_split_legs", f"""WITH {TRUSTED}, a AS (SELECT *, tst - lag(tst) OVER (PARTITION BY tid ORDER BY tst, id) AS gap FROM t),
b AS (SELECT *, sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY tst, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM a)
SELECT CAST(tid AS BIGINT) AS tid, CAST(part AS BIGINT) AS part, min(tst) AS start_ts, max(tst) AS end_ts, count(*) AS n FROM b GROUP BY 1, 2""")
def gap_split_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.islands(stays.trusted(frame(spark, sf_dir, "pings")), ["tid"], "tst", ["id"], {"was": F.col("tst")}, F.col("tst") - F.col("was") > 1800, "part")
    return rows.groupBy("tid", "part").agg(F.min("tst").alias("start_ts"), F.max("tst").alias("end_ts"), F.count("*").alias("n"))


@op("chained_runs", f"WITH {CHAIN} SELECT tid, mode, start_ts, end_ts, round(distance_m, 2) AS distance_m, n AS n_segments FROM j")
def chained_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legs.chained(frame(spark, sf_dir, "segments"), SEGMENT_KEYS)
    return rows.select("tid", "mode", "start_ts", "end_ts", F.round("distance_m", 2).alias("distance_m"), "n_segments")


@op("longest_journey", f"""WITH {CHAIN}, pv AS MATERIALIZED (SELECT v.tid, v.id AS vid, v.start_ts, v.end_ts, v.place_id, p.name, p.city, p.country, p.lat, p.lon FROM visits v JOIN places p ON v.place_id = p.id),
c AS (SELECT tid, mode, start_ts, end_ts, round(distance_m, 2) AS dist FROM j QUALIFY row_number() OVER (PARTITION BY tid ORDER BY round(distance_m, 2) DESC, start_ts, mode) <= 25)
SELECT tid, mode, start_ts, from_place, to_place, round(ends_m, 1) AS ends_m FROM {with_ends("c")} WHERE ends_m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tid ORDER BY round(ends_m, 1) DESC, start_ts, mode) = 1""")
def longest_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = legs.chained(frame(spark, sf_dir, "segments"), SEGMENT_KEYS).withColumn("dist", F.round("distance_m", 2))
    rank = F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("dist"), "start_ts", "mode"))
    some = chains.select("tid", "mode", "start_ts", "end_ts", "dist").withColumn("r", rank).where("r <= 25")
    visits = placed(frame(spark, sf_dir, "visits"), frame(spark, sf_dir, "places"))
    rows = places.with_ends(keeper(spark, "journeys")(some), visits, ["tid"]).where("ends_m is not null").withColumn("ends_m", F.round("ends_m", 1))
    return top(rows, ["tid"], [-F.col("ends_m"), F.col("start_ts"), F.col("mode")], "mode", "start_ts", "from_place", "to_place", "ends_m")


@op("highest_point", f"""WITH h AS (SELECT * FROM pings WHERE alt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tid ORDER BY alt DESC, tst, id) = 1)
SELECT h.tid, h.id, h.tst, coalesce((SELECT place_id FROM visits v WHERE v.tid = h.tid AND v.start_ts <= h.tst ORDER BY v.start_ts DESC, v.id DESC LIMIT 1), (SELECT place_id FROM visits v WHERE v.tid = h.tid AND v.start_ts >= h.tst ORDER BY v.start_ts, v.id LIMIT 1)) AS place_id FROM h""")
def highest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top(frame(spark, sf_dir, "pings").where("alt is not null"), ["tid"], [-F.col("alt"), F.col("tst"), F.col("id")], "id", "tst")
    visits = frame(spark, sf_dir, "visits").select("tid", F.col("id").alias("vid"), "start_ts", "place_id")
    before = sequence.asof(best, visits, "tst", "start_ts", ["place_id"], ["tid"], tie=["vid"]).withColumnRenamed("asof", "b")
    both = sequence.asof(before, visits, "tst", "start_ts", ["place_id"], ["tid"], forward=True, tie=["vid"])
    return both.select("tid", "id", "tst", F.coalesce("b.place_id", "asof.place_id").alias("place_id"))


HOMED = f"""hv AS (SELECT v.*, p.category, p.city, p.country, p.country_code, p.lat, p.lon FROM visits v JOIN places p ON v.place_id = p.id),
hh AS (SELECT hv.id, min_by(h.id, h.id) AS home, min_by(h.lat, h.id) AS hlat, min_by(h.lon, h.id) AS hlon, min_by(h.radius_m, h.id) AS r FROM hv JOIN home_periods h
       ON h.tid = hv.tid AND (h.start_ts IS NULL OR h.start_ts <= hv.start_ts) AND (h.end_ts IS NULL OR hv.start_ts < h.end_ts) GROUP BY 1),
ha AS (SELECT hv.*, hh.home, {M('hv.lat', 'hv.lon', 'hh.hlat', 'hh.hlon')} AS home_m, coalesce({M('hv.lat', 'hv.lon', 'hh.hlat', 'hh.hlon')} > hh.r, false) AS away, coalesce({M('hv.lat', 'hv.lon', 'hh.hlat', 'hh.hlon')} <= 15000, false) AS near FROM hv LEFT JOIN hh ON hv.id = hh.id)"""


def _homed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame(spark, sf_dir, "places").select(F.col("id").alias("place_id"), "category", "city", "country", "country_code", "lat", "lon")
    visits = frame(spark, sf_dir, "visits").join(p, "place_id")
    return keeper(spark, "homed")(away.with_home(visits, frame(spark, sf_dir, "home_periods")))


@op("home_period_lookup", f"WITH {HOMED} SELECT id, home, round(home_m, 1) AS home_m, away, near AS near_home FROM ha")
def home_period_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _homed(spark, sf_dir).select("id", "home", F.round("home_m", 1).alias("home_m"), "away", "near_home")


@op("trips", f"""WITH {HOMED},
r0 AS (SELECT *, lag(end_ts) OVER w AS g0, lag(away) OVER w AS wa, lag(near) OVER w AS wn FROM ha WHERE category <> 'Work' AND source NOT IN ('kml_import', 'photo_import') WINDOW w AS (PARTITION BY tid ORDER BY start_ts, id)),
gp AS (SELECT DISTINCT tid, g0, start_ts AS g1 FROM r0 WHERE away AND wa AND start_ts - g0 > 86400),
cv AS (SELECT gp.tid, gp.g0, gp.g1, greatest(s.start_ts, g0) AS s, least(s.end_ts, g1) AS e FROM gp JOIN segments s ON s.tid = gp.tid AND s.start_ts < g1 AND s.end_ts > g0),
ho AS (SELECT tid, g0, g1, e, s - greatest(g0, coalesce(max(e) OVER (PARTITION BY tid, g0, g1 ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g0)) AS hole FROM cv),
bl AS (SELECT gp.tid, gp.g0, gp.g1, coalesce(greatest(max(hole), gp.g1 - max(e)), gp.g1 - gp.g0) AS blank FROM gp LEFT JOIN ho ON gp.tid = ho.tid AND gp.g0 = ho.g0 AND gp.g1 = ho.g1 GROUP BY gp.tid, gp.g0, gp.g1),
r1 AS (SELECT r0.*, CASE WHEN away AND (NOT coalesce(wa, false) OR (start_ts - r0.g0 > 28800 AND (wn OR near)) OR coalesce(bl.blank, 0) > 86400) THEN 1 ELSE 0 END AS new FROM r0 LEFT JOIN bl ON r0.tid = bl.tid AND r0.g0 = bl.g0 AND r0.start_ts = bl.g1),
r2 AS (SELECT *, sum(new) OVER (PARTITION BY tid ORDER BY start_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r1),
ev AS (SELECT tid, run, 0 AS own, id, start_ts, end_ts, city, country FROM r2 WHERE away UNION ALL SELECT tid, -1, id, id, start_ts, end_ts, city, country FROM ha WHERE source = 'photo_import'),
sp AS (SELECT tid, run, own, min(start_ts) AS start_ts, arg_max(end_ts, (start_ts, id)) AS end_ts, count(*) AS n_visits FROM ev GROUP BY 1, 2, 3),
vt AS (SELECT tid, run, own, CASE WHEN city IS NOT NULL THEN 0 ELSE 1 END AS kind, coalesce(city, country) AS label, sum(greatest(end_ts - start_ts, 60)) AS s, min(start_ts) AS seen FROM ev WHERE coalesce(city, country) IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
bt AS (SELECT *, row_number() OVER (PARTITION BY tid, run, own ORDER BY kind, s DESC, seen, label) AS i FROM vt)
SELECT sp.tid, sp.start_ts, sp.end_ts, sp.n_visits, CASE WHEN bt.kind = 0 THEN bt.label END AS primary_city FROM sp LEFT JOIN bt ON sp.tid = bt.tid AND sp.run = bt.run AND sp.own = bt.own AND bt.i = 1 WHERE sp.end_ts - sp.start_ts >= 21600""")
def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return away.trips(_homed(spark, sf_dir), frame(spark, sf_dir, "segments")).select("tid", "start_ts", "end_ts", "n_visits", "primary_city")


#: Visits put in by hand (where no imported one stands), with what they replace, and people who moved: the tables after the edit.
EDITED = """mv AS (SELECT v.* REPLACE (v.id + 1000000000 AS id, v.start_ts + 259200 AS start_ts, v.start_ts + 277200 AS end_ts, 'manual' AS source) FROM visits v WHERE v.id % 9 = 4),
mo AS (SELECT * FROM mv WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.tid = mv.tid AND v.source NOT IN ('owntracks', 'manual') AND v.start_ts < mv.end_ts AND v.end_ts > mv.start_ts)),
v2 AS (SELECT * FROM visits v WHERE source <> 'owntracks' OR NOT EXISTS (SELECT 1 FROM mo WHERE mo.tid = v.tid AND v.start_ts < mo.end_ts AND v.end_ts > mo.start_ts) UNION ALL SELECT * FROM mo),
s2 AS (SELECT * FROM segments s WHERE NOT EXISTS (SELECT 1 FROM mo WHERE mo.tid = s.tid AND s.start_ts < mo.end_ts AND s.end_ts > mo.start_ts)),
h2 AS (SELECT * REPLACE (CASE WHEN tid % 5 = 2 AND id % 2 = 0 THEN 50.24 ELSE lat END AS lat) FROM home_periods)"""
_AFTER = CHECKS["trips"].replace("WITH ", f"WITH {EDITED}, ", 1).replace("FROM visits v JOIN places", "FROM v2 v JOIN places").replace("JOIN home_periods h", "JOIN h2 h").replace("JOIN segments s", "JOIN s2 s")


@op("rederived_trips", _AFTER)
def rederived_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips after visits put in by hand and moves of home, from the trips before: only what the edits touch is derived again."""
    keep = keeper(spark, "rederived")
    visits, periods = frame(spark, sf_dir, "visits"), frame(spark, sf_dir, "home_periods")
    segs = frame(spark, sf_dir, "segments").select("tid", "start_ts", "end_ts", F.lit("owntracks").alias("source"))
    p = frame(spark, sf_dir, "places").select(F.col("id").alias("place_id"), "category", "city", "country", "country_code", "lat", "lon")
    old = keep(away.trips(away.with_home(visits.join(p, "place_id"), periods), segs))
    hand = visits.where("id % 9 = 4").withColumns({"id": F.col("id") + 1000000000, "start_ts": F.col("start_ts") + 259200, "end_ts": F.col("start_ts") + 277200, "source": F.lit("manual")})
    visits2, segs2 = (keep(x) for x in overlays.manual_visit(visits, segs, hand))
    moved = periods.withColumn("lat", F.when((F.col("tid") % 5 == 2) & (F.col("id") % 2 == 0), 50.24).otherwise(F.col("lat")))
    changes = rederive.accepted(visits, segs, visits2.where("source = 'manual'")).unionByName(rederive.period_changes(periods, moved))
    rows = rederive.trips(old, visits2.join(p, "place_id"), segs2, moved, changes, keep)
    return rows.select("tid", "start_ts", "end_ts", "n_visits", "primary_city")


@op("rederived_segments", CHECKS["segments"].replace("FROM merged),\no AS", "FROM merged WHERE start_ts % 7 <> 3),\no AS"))
def rederived_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs after some visits were deleted, from the legs before."""
    keep = keeper(spark, "rederived")
    trusted = stays.trusted(frame(spark, sf_dir, "pings"))
    visits = keep(stays.merged(stays.stays(trusted)))
    left = visits.where("start_ts % 7 <> 3")
    old = keep(legs.segments(visits, trusted))
    rows = rederive.segments(old, left, trusted, rederive.changes_of(visits, left, ["tid", "start_ts"]), keep)
    return rows.select("tid", "start_ts", "end_ts", "mode", F.round("distance_m", 2).alias("distance_m"), "start_visit", "end_visit")


def _chained_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of seven names, so that many share one."""
    return frame(spark, sf_dir, "places").withColumn("name", F.concat(F.lit("Chain "), (F.col("id") % 7).cast("string"))).withColumn("city", F.when(F.col("id") % 29 > 0, F.col("country")))


CHAINED = "np AS (SELECT * REPLACE ('Chain ' || (id % 7) AS name, CASE WHEN id % 29 > 0 THEN country END AS city) FROM places)"


@op("similar_places", f"""WITH {CHAINED} SELECT a.tid, a.id, b.id AS other, a.name, a.city, round({M('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 2) AS metres, (SELECT count(*) FROM visits v WHERE v.place_id = b.id) AS n_visits
FROM np a JOIN np b ON a.tid = b.tid AND a.name = b.name AND a.city IS NOT DISTINCT FROM b.city AND a.id <> b.id WHERE {M('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2000""")
def similar_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = frame(spark, sf_dir, "visits").groupBy(F.col("place_id").alias("other")).agg(F.count("*").alias("n_visits"))
    rows = places.similar(_chained_places(spark, sf_dir)).withColumn("metres", F.round("metres", 2))
    return rows.join(n, "other", "left").fillna(0, ["n_visits"])


# clusters as a list that a recursion over the places of a name carries along
@op("place_dedupe", f"""WITH RECURSIVE {CHAINED}, o AS (SELECT id, tid, name, city, lat, lon, (SELECT count(*) FROM visits v WHERE v.place_id = np.id) AS n, row_number() OVER (PARTITION BY tid, name, city ORDER BY id) AS i FROM np),
r AS (SELECT tid, name, city, i, id, n, [{{'a': lat, 'b': lon, 'c': 1}}] AS cl, 1::BIGINT AS k FROM o WHERE i = 1
  UNION ALL SELECT x.tid, x.name, x.city, x.i, x.id, x.n, CASE WHEN hit IS NULL THEN list_append(cl, {{'a': x.lat, 'b': x.lon, 'c': 1}}) ELSE list_transform(cl, lambda c, j: CASE WHEN j = hit THEN {{'a': c.a + x.lat, 'b': c.b + x.lon, 'c': c.c + 1}} ELSE c END) END, coalesce(hit, len(cl) + 1)
  FROM (SELECT o.*, r.cl, nullif(list_position(list_transform(r.cl, lambda c: {M('c.a / c.c', 'c.b / c.c', 'o.lat', 'o.lon')} <= 300), true), 0)::BIGINT AS hit FROM r JOIN o ON o.tid = r.tid AND o.name = r.name AND o.city IS NOT DISTINCT FROM r.city AND o.i = r.i + 1) x)
SELECT id, first_value(id) OVER (PARTITION BY tid, name, city, k ORDER BY n DESC, id) AS keeper FROM r""")
def place_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.greedy_clusters(_chained_places(spark, sf_dir), frame(spark, sf_dir, "visits"))


@op("phantom_removal", "SELECT id, start_ts, end_ts FROM (SELECT id, CAST(floor(start_ts / 3600.0) AS BIGINT) * 3600 AS start_ts, CAST(floor(end_ts / 3600.0) AS BIGINT) * 3600 AS end_ts, source FROM visits) v WHERE NOT (source = 'google_import' AND end_ts - start_ts = 7200)")
def phantom_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = lambda c: (F.floor(F.col(c) / 3600) * 3600).alias(c)
    return overlays.without_phantoms(frame(spark, sf_dir, "visits").select("id", hour("start_ts"), hour("end_ts"), "source")).drop("source")


@op("segment_edits", "SELECT k1, k2, k3, k4, start_ts, distance_m, CASE WHEN k1 % 10 = 0 THEN 'train' WHEN k1 % 10 = 1 THEN 'bus' ELSE mode END AS mode FROM segments WHERE k1 % 10 <> 2")
def segment_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "segments").select("k1", "k2", "k3", "k4", "start_ts", "distance_m", "mode")
    keys = rows.select("k1").distinct()
    edits = keys.where("k1 % 10 < 2").select("k1", F.explode(F.array(F.struct(F.lit("ferry").alias("mode"), F.lit(1).alias("edited_at")), F.struct(F.when(F.col("k1") % 10 == 0, "train").otherwise("bus").alias("mode"), F.lit(2).alias("edited_at")))).alias("e")).select("k1", "e.*")
    return overlays.without(overlays.patched(rows, edits, ["k1"], ["mode"]), keys.where("k1 % 10 = 2"), ["k1"])


@op("place_merge", "SELECT CASE WHEN place_id % 3 = 1 THEN place_id - 1 ELSE place_id END AS place_id, count(*) AS n_visits FROM visits GROUP BY 1")
def place_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = frame(spark, sf_dir, "places").where("id % 3 = 1").select(F.col("id").alias("old_id"), (F.col("id") - 1).alias("new_id"))
    rows = overlays.repointed(frame(spark, sf_dir, "visits"), alias)
    return rows.groupBy("place_id").agg(F.count("*").alias("n_visits"))


# chains of merges by a recursion that carries the path along, so that circles are seen
@op("place_merge_chains", """WITH RECURSIVE al AS (SELECT id AS o, CASE WHEN id % 100 = 0 THEN id + 2 ELSE id - 1 END AS n FROM places WHERE id % 4 <> 0 OR id % 100 = 0),
w AS (SELECT o, n AS cur, [o] AS seen FROM al UNION ALL SELECT w.o, al.n, list_append(seen, w.cur) FROM w JOIN al ON al.o = w.cur WHERE NOT list_contains(seen, w.cur)),
e AS (SELECT o, CASE WHEN list_contains(seen, cur) THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS keeper FROM w QUALIFY row_number() OVER (PARTITION BY o ORDER BY len(seen) DESC) = 1)
SELECT p.id, (SELECT count(*) FROM visits v LEFT JOIN e ON e.o = v.place_id WHERE coalesce(e.keeper, v.place_id) = p.id) AS n_visits FROM places p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.o = p.id AND e.keeper <> p.id)""")
def place_merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the places after merges in chains and circles, with the visits that now point to each."""
    some = frame(spark, sf_dir, "places")
    alias = some.where("id % 4 <> 0 or id % 100 = 0").select(F.col("id").alias("old_id"), F.when(F.col("id") % 100 == 0, F.col("id") + 2).otherwise(F.col("id") - 1).alias("new_id"))
    left, visits = overlays.merged_places(some, frame(spark, sf_dir, "visits"), alias, keeper(spark, "merges"))
    n = visits.groupBy(F.col("place_id").alias("id")).agg(F.count("*").alias("n_visits")).hint("merge")
    return left.select("id").join(n, "id", "left").fillna(0, ["n_visits"])


def _photo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth photo has a second file, taken elsewhere."""
    rows = frame(spark, sf_dir, "photos").withColumn("file", F.lit("a"))
    return rows.unionByName(rows.where("uid % 4 = 0").withColumns({"file": F.lit("b"), "lat": F.lit(50.0), "lon": F.lit(0.01)}))


@op("photos_near_visits", f"""WITH f AS (SELECT *, 'a' AS file FROM photos UNION ALL SELECT * REPLACE (50.0::DOUBLE AS lat, 0.01::DOUBLE AS lon), 'b' FROM photos WHERE uid % 4 = 0),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY uid ORDER BY file) = 1),
m AS (SELECT v.id, u.uid, round({M('u.lat', 'u.lon', 'p.lat', 'p.lon')}, 1) AS metres FROM visits v JOIN places p ON p.id = v.place_id JOIN u ON u.tid = v.tid AND NOT (u.lat = 0 AND u.lon = 0)
  AND u.taken_ts >= CAST(floor((v.start_ts - 259200) / 86400.0) AS BIGINT) * 86400 AND u.taken_ts < (CAST(floor((v.end_ts + 259200) / 86400.0) AS BIGINT) + 1) * 86400 WHERE {M('u.lat', 'u.lon', 'p.lat', 'p.lon')} <= 100000)
SELECT id, uid, metres, CAST(row_number() OVER (PARTITION BY id ORDER BY metres, uid) AS INT) AS rank FROM m QUALIFY rank <= 24""")
def photos_near_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos within 100 km of a visit's place, taken up to three days around it; a photo's first file counts."""
    at = frame(spark, sf_dir, "places").select(F.col("id").alias("place_id"), "lat", "lon")
    spots = frame(spark, sf_dir, "visits").join(at, "place_id").select("id", "tid", "lat", "lon", (F.col("start_ts") - 259200).alias("start_ts"), (F.col("end_ts") + 259200).alias("end_ts"))
    return photo_ops.near(spots, _photo_files(spark, sf_dir), 100_000.0)


@op("photos_of_trips", """WITH f AS (SELECT *, 'a' AS file FROM photos UNION ALL SELECT * REPLACE (50.0::DOUBLE AS lat, 0.01::DOUBLE AS lon), 'b' FROM photos WHERE uid % 4 = 0),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY uid ORDER BY file) = 1)
SELECT t.id, u.uid, u.taken_ts, CASE WHEN NOT (lat = 0 AND lon = 0) THEN lat END AS lat, CASE WHEN NOT (lat = 0 AND lon = 0) THEN lon END AS lon, CAST(row_number() OVER (PARTITION BY t.id ORDER BY taken_ts, uid) AS INT) AS rank
FROM trips t JOIN u ON u.tid = t.tid AND u.taken_ts >= CAST(floor(t.start_ts / 86400.0) AS BIGINT) * 86400 AND u.taken_ts < (CAST(floor(t.end_ts / 86400.0) AS BIGINT) + 1) * 86400 QUALIFY rank <= 100""")
def photos_of_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = frame(spark, sf_dir, "trips").select("id", "tid", "start_ts", "end_ts")
    return photo_ops.taken_between(spans, _photo_files(spark, sf_dir), 100)


@op("away_seconds_per_day", "SELECT bin AS day, CAST(sum(least(end_ts, (bin + 1) * 86400) - greatest(start_ts, bin * 86400)) AS BIGINT) AS seconds FROM (SELECT start_ts, end_ts, CAST(unnest(generate_series(CAST(floor(start_ts / 86400.0) AS BIGINT), CAST(floor((end_ts - 1) / 86400.0) AS BIGINT))) AS BIGINT) AS bin FROM trips) t GROUP BY 1")
def away_seconds_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.clipped_per_bin(frame(spark, sf_dir, "trips"), "start_ts", "end_ts", 86400, "day").groupBy("day").agg(F.sum("seconds").alias("seconds"))


@op("overlapping_visits", "SELECT a.id AS a, b.id AS b FROM visits a JOIN visits b ON a.id < b.id AND a.start_ts <= b.end_ts AND a.end_ts >= b.start_ts AND a.place_id = b.place_id")
def overlapping_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frame(spark, sf_dir, "visits")
    a = v.select("place_id", F.col("id").alias("a"), F.col("start_ts").alias("a0"), F.col("end_ts").alias("a1"))
    b = v.select("place_id", F.col("id").alias("b"), F.col("start_ts").alias("b0"), F.col("end_ts").alias("b1"))
    return sequence.overlap_join(a, b, ("a0", "a1"), ("b0", "b1"), ["place_id"]).where("a < b").select("a", "b")


@op("nearby_places", f"""WITH m AS (SELECT a.id, b.name, b.category, {M('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS metres FROM places a JOIN places b ON b.name IS NOT NULL AND abs(a.lat - b.lat) < 0.01 WHERE {M('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 400),
o AS (SELECT id, name, round(min(metres), 2) AS metres FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, name) AS rank FROM o) SELECT id, name, metres, rank FROM r WHERE rank <= 15""")
def nearby_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame(spark, sf_dir, "places")
    return places.nearby(p, p, 400.0).select("id", "name", "metres", "rank")


@op("place_search", f"SELECT id, name, round({M('lat', 'lon', '50.0', '0.0')}, 1) AS metres FROM places WHERE lower(name) LIKE '%00001%' ORDER BY {M('lat', 'lon', '50.0', '0.0')}, id LIMIT 8")
def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.text_search(frame(spark, sf_dir, "places"), "00001", 50.0, 0.0).select("id", "name", F.round("metres", 1).alias("metres"))


# the grid by its indices, and distances relaxed by a keyed recursion until none improves
@op("rail_route", f"""WITH RECURSIVE nd AS MATERIALIZED (SELECT a.range * 100 + b.range AS n, 50.0 + a.range * 0.01 AS lat, b.range * 0.01 AS lon FROM range(12) a, range(12) b),
ed AS MATERIALIZED (SELECT p.n AS s, q.n AS t, {M('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS m FROM nd p JOIN nd q ON abs(p.n - q.n) = 1 OR abs(p.n - q.n) = 100 AND p.n % 100 % 3 = 0 AND p.n % 100 < 12),
sn AS MATERIALIZED (SELECT p.id, p.tid, arg_min(nd.n, (round({M('p.lat', 'p.lon', 'nd.lat', 'nd.lon')}, 3), nd.n)) AS n FROM places p JOIN nd ON abs(p.lat - nd.lat) < 0.05 AND {M('p.lat', 'p.lon', 'nd.lat', 'nd.lon')} <= 2000 GROUP BY ALL),
rq AS MATERIALIZED (SELECT id, n AS s, lead(n) OVER (PARTITION BY tid ORDER BY id) AS t FROM sn),
pa(s, n, d, k) USING KEY (s, n) AS (SELECT DISTINCT s, s, 0.0::DOUBLE, 1::BIGINT FROM rq UNION
  SELECT pa.s, ed.t, min(pa.d + ed.m), arg_min(pa.k + 1, pa.d + ed.m) FROM pa JOIN ed ON ed.s = pa.n LEFT JOIN recurring.pa r ON r.s = pa.s AND r.n = ed.t WHERE r.d IS NULL OR pa.d + ed.m < r.d - 1e-6 GROUP BY 1, 2)
SELECT rq.id, round(pa.d, 1) AS metres, CAST(pa.k AS INT) AS n_nodes FROM rq JOIN pa ON pa.s = rq.s AND pa.n = rq.t""")
def rail_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths on a grid of ways, one way for each row and every third column, from each place snapped to it to the person's next."""
    line = lambda s: F.transform(F.sequence(F.lit(0), F.lit(11)), s)
    rows = spark.range(12).select(F.col("id").alias("way_id"), line(lambda x: F.struct((F.lit(50.0) + F.col("id") * 0.01).alias("lat"), (x * 0.01).alias("lon"))).alias("geometry"))
    cols = spark.range(0, 12, 3).select((F.col("id") + 100).alias("way_id"), line(lambda x: F.struct((F.lit(50.0) + x * 0.01).alias("lat"), (F.col("id") * 0.01).alias("lon"))).alias("geometry"))
    keep = keeper(spark, "rail")
    ways = keep(rows.unionByName(cols))
    edges, nodes = keep(routing.edges_of(ways)), keep(routing.nodes_of(ways))
    some = frame(spark, sf_dir, "places")
    at = routing.snapped(some.select("id", "lat", "lon"), nodes).join(some.select("id", "tid"), "id")
    ends = keep(at.select("id", "tid", F.col("node").alias("src"))).withColumn("next", F.lead("src").over(Window.partitionBy("tid").orderBy("id")))
    requests = ends.where("next is not null").select("id", "src", F.col("next").alias("dst"))
    return routing.shortest_paths(requests, edges, keep).select("id", F.round("metres", 1).alias("metres"), F.size("path").alias("n_nodes"))


LINES = """c AS (SELECT c_custkey AS c, c_nationkey AS a, CAST((c_custkey * 7 + 3) % 25 AS INT) AS b, (c_custkey % 50) * 0.002 AS off FROM customer WHERE c_nationkey <> (c_custkey * 7 + 3) % 25),
pt AS MATERIALIZED (SELECT c, j, lat, lon, printf('%.6f,%.6f', lat, lon) AS n FROM (SELECT c, j, 50.0::DOUBLE + (a % 5) * 0.5 + ((b % 5) - (a % 5)) * 0.5 * j / 9.0 + CASE WHEN j IN (0, 9) THEN 0 ELSE off END AS lat,
  (a // 5) * 0.5::DOUBLE + ((b // 5) - (a // 5)) * 0.5 * j / 9.0 AS lon FROM c, (SELECT range AS j FROM range(10))))"""


# distances relaxed node by node by a keyed recursion, without any shortcut
@op("line_routes", f"""WITH RECURSIVE {LINES},
st AS (SELECT p.n AS s, q.n AS t, {M('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS m FROM pt p JOIN pt q ON p.c = q.c AND q.j = p.j + 1),
ed AS MATERIALIZED (SELECT s, t, min(m) AS m FROM (SELECT s, t, m FROM st UNION ALL SELECT t, s, m FROM st) GROUP BY 1, 2),
rq AS MATERIALIZED (SELECT x.c AS id, x.n AS s, y.n AS t FROM pt x JOIN pt y ON y.c = x.c + 1 AND y.j = 5 AND x.j = 3 WHERE x.c % 100 = 0),
pa(s, n, d, k) USING KEY (s, n) AS (SELECT DISTINCT s, s, 0.0::DOUBLE, 1::BIGINT FROM rq UNION
  SELECT pa.s, ed.t, min(pa.d + ed.m), arg_min(pa.k + 1, pa.d + ed.m) FROM pa JOIN ed ON ed.s = pa.n LEFT JOIN recurring.pa r ON r.s = pa.s AND r.n = ed.t WHERE r.d IS NULL OR pa.d + ed.m < r.d - 1e-6 GROUP BY 1, 2)
SELECT rq.id, round(pa.d, 1) AS metres FROM rq JOIN pa ON pa.s = rq.s AND pa.n = rq.t""")
def line_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths over ways between 25 hubs, one for each customer with eight nodes on the way: nearly all nodes lie on lines."""
    keep = keeper(spark, "lines")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").cast("long").alias("a"), ((F.col("c_custkey") * 7 + 3) % 25).alias("b"), (F.col("c_custkey") % 50 * 0.002).alias("off")).where("a <> b")
    row, col = (lambda k: F.col(k) % 5), (lambda k: F.floor(F.col(k) / 5))
    place = lambda j: F.struct((50 + row("a") * 0.5 + (row("b") - row("a")) * 0.5 * j / 9 + F.when(j.isin(0, 9), 0.0).otherwise(F.col("off"))).alias("lat"), (col("a") * 0.5 + (col("b") - col("a")) * 0.5 * j / 9).alias("lon"))
    ways = keep(c.select(F.col("c").alias("way_id"), F.transform(F.sequence(F.lit(0), F.lit(9)), place).alias("geometry")))
    node = lambda j: F.concat_ws(",", F.format_number(F.col("geometry")[j]["lat"], 6), F.format_number(F.col("geometry")[j]["lon"], 6))
    start = ways.where("way_id % 100 = 0").select(F.col("way_id").alias("id"), node(3).alias("src"))
    requests = keep(start.join(ways.select((F.col("way_id") - 1).alias("id"), node(5).alias("dst")), "id"))
    return routing.shortest_paths(requests, routing.edges_of(ways), keep).select("id", F.round("metres", 1).alias("metres"))


#: Documents as the checking database writes them: lists of structs in order, nulls kept, whole numbers.
E6 = "CAST(round_even({} * 1000000, 0) AS BIGINT)"
TRIP_DOC = f"""mine AS (SELECT t.id, v.id AS vid, v.start_ts AS from_ts, v.end_ts AS to_ts, p.name AS place_name, p.category, p.city, {E6.format('p.lat')} AS lat_e6, {E6.format('p.lon')} AS lon_e6
  FROM trips t JOIN visits v ON v.tid = t.tid AND v.start_ts >= t.start_ts AND v.start_ts < t.end_ts LEFT JOIN places p ON p.id = v.place_id),
shots AS (SELECT t.id, f.uid, f.taken_ts, (SELECT arg_min(m.vid, (m.from_ts, m.vid)) FROM mine m WHERE m.id = t.id AND f.taken_ts >= m.from_ts AND f.taken_ts <= m.to_ts) AS vid FROM trips t JOIN photos f ON f.tid = t.tid
  AND f.taken_ts >= CAST(floor(t.start_ts / 86400.0) AS BIGINT) * 86400 AND f.taken_ts < (CAST(floor(t.end_ts / 86400.0) AS BIGINT) + 1) * 86400),
vl AS (SELECT id, list({{'vid': vid, 'from_ts': from_ts, 'to_ts': to_ts, 'place_name': place_name, 'category': category, 'city': city, 'lat_e6': lat_e6, 'lon_e6': lon_e6,
  'photos': coalesce((SELECT list({{'uid': uid, 'taken_ts': taken_ts}} ORDER BY taken_ts, uid) FROM shots s WHERE s.id = mine.id AND s.vid = mine.vid), [])}} ORDER BY from_ts, vid) AS l FROM mine GROUP BY id),
gl AS (SELECT t.id, list({{'k1': s.k1, 'from_ts': s.start_ts, 'to_ts': s.end_ts, 'mode': s.mode, 'metres': CAST(round_even(s.distance_m, 0) AS BIGINT)}} ORDER BY s.start_ts, s.k1, s.k2, round_even(s.distance_m, 0)) AS l
  FROM trips t JOIN segments s ON s.tid = t.tid AND s.start_ts >= t.start_ts AND s.end_ts <= t.end_ts GROUP BY t.id),
pl AS (SELECT id, list({{'uid': uid, 'taken_ts': taken_ts}} ORDER BY taken_ts, uid) AS l FROM shots WHERE vid IS NULL GROUP BY id)"""


@op("trip_documents", f"""WITH {TRIP_DOC} SELECT tid, t.id, CAST(to_json({{'id': t.id, 'name': name, 'start_ts': start_ts, 'end_ts': end_ts, 'days': greatest(1, (end_ts - start_ts) // 86400 + 1), 'primary_city': primary_city, 'primary_country': primary_country, 'primary_country_code': primary_country_code,
  'visits': coalesce(vl.l, []), 'legs': coalesce(gl.l, []), 'photos': coalesce(pl.l, [])}}) AS VARCHAR) AS document FROM trips t LEFT JOIN vl ON vl.id = t.id LEFT JOIN gl ON gl.id = t.id LEFT JOIN pl ON pl.id = t.id""")
def trip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.trip_documents(*[frame(spark, sf_dir, t) for t in ("trips", "visits", "places", "segments", "photos")])


@op("new_country_documents", """WITH c AS (SELECT v.tid, p.country_code, min(v.start_ts) AS t, max(p.country) AS country FROM visits v JOIN places p ON p.id = v.place_id WHERE p.country_code IS NOT NULL GROUP BY 1, 2)
SELECT tid, CAST(year(make_timestamp(t * 1000000)) AS INT) AS year, CAST(to_json(list({'country_code': country_code, 'country': country} ORDER BY t, country_code)) AS VARCHAR) AS new_countries FROM c GROUP BY 1, 2""")
def new_country_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The countries that were new to a person in each year, by name, out of the documents of their years."""
    rows = documents.year_documents(*[frame(spark, sf_dir, t) for t in ("trips", "visits", "places", "segments")])
    return rows.select("tid", "year", F.get_json_object("document", "$.new_countries").alias("new_countries")).where("new_countries <> '[]'")


DAY_DOC = f"""dt AS ({REPORT_CHECKS['day_timeline']}), dm AS ({REPORT_CHECKS['day_modes']}),
dc AS (SELECT c.tid, c.side, c.id, c.at_ts, p.name, p.city, {E6.format('p.lat')} AS lat_e6, {E6.format('p.lon')} AS lon_e6 FROM ({REPORT_CHECKS['context_visits']}) c JOIN visits v ON v.id = c.id LEFT JOIN places p ON p.id = v.place_id),
dp AS (SELECT tid, uid, taken_ts, CASE WHEN NOT (lat = 0 AND lon = 0) THEN {E6.format('lat')} END AS lat_e6, CASE WHEN NOT (lat = 0 AND lon = 0) THEN {E6.format('lon')} END AS lon_e6 FROM photos WHERE taken_ts >= {A_DAY} AND taken_ts < {A_DAY} + 86400)"""


@op("day_documents", f"""WITH {DAY_DOC} SELECT w.tid, CAST(to_json({{
  'timeline': coalesce((SELECT list({{'type': type, 'id': id, 'start_ts': start_ts, 'end_ts': end_ts, 'place_name': place_name, 'category': category, 'city': city, 'mode': mode, 'metres': CAST(round_even(distance_m, 0) AS BIGINT)}} ORDER BY start_ts, type, id, end_ts) FROM dt WHERE dt.tid = w.tid), []),
  'modes': coalesce((SELECT list({{'mode': mode, 'metres': CAST(round_even(distance_m, 0) AS BIGINT), 'seconds': CAST(round_even(duration_s, 0) AS BIGINT)}} ORDER BY mode) FROM dm WHERE dm.tid = w.tid), []),
  'around': coalesce((SELECT list({{'side': side, 'id': id, 'at_ts': at_ts, 'name': name, 'city': city, 'lat_e6': lat_e6, 'lon_e6': lon_e6}} ORDER BY at_ts, id) FROM dc WHERE dc.tid = w.tid), []),
  'photos': coalesce((SELECT list({{'uid': uid, 'taken_ts': taken_ts, 'lat_e6': lat_e6, 'lon_e6': lon_e6}} ORDER BY taken_ts, uid) FROM dp WHERE dp.tid = w.tid), [])}}) AS VARCHAR) AS document FROM (SELECT tid FROM dt UNION SELECT tid FROM dp) w""")
def day_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.day_documents(*[frame(spark, sf_dir, t) for t in ("visits", "segments", "places", "photos")])


@op("stays_by_batches", CHECKS["stay_points"])
def stays_by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays brought up to date batch by batch, the second one full of late pings."""
    log, pings = PingLog(spark, shared(spark, "log"), shared(spark, "state"), buckets=8), frame(spark, sf_dir, "pings")
    for number, part in enumerate(("id % 3 <> 1", "id % 3 = 1")):
        log.append(pings.where(part), number)
        log.derive(number)
    return log.stays().select("tid", "start_ts", "end_ts", F.col("point_count").cast("long").alias("point_count"))


@op("stream_hourly_events", "SELECT CAST(floor(epoch(ts) / 3600.0) AS BIGINT) AS hour, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return ingest.counts_by_hour(spark, sf_dir, "events.parquet", schema, shared(spark, "hourly"), shared(spark, "stream"))
