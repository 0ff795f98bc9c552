"""The driver's tables as location history: pings from events, interval tables from orders, lineitem, customer and pages.

Every table has tid, the person: so many keys in a row are one person's places (and their visits and trips), segments, photos or pings, so people grow
with the tables, and pairs within a person in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .dialect import SPARK, Dialect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")
#: Keys of a table that make one person.
EACH = {"c_custkey": 30, "o_custkey": 30, "l_orderkey": 300, "page_id": 5, "user_id": 30}
#: Transport modes and place categories.
MODES = ["walking", "cycling", "driving", "taxi", "bus", "train", "subway", "tram", "ferry", "boating", "flying"]
CATEGORIES = ["Home", "Work", "Food and drink", "Shopping", "Hotels", "Airports", "Transport", "Other places"]


def person(key: str) -> str:
    return f"CAST(floor({key} / {EACH[key]}.0) AS BIGINT)"


def _anchor_lat(n: str) -> str:
    return f"(50 + 0.03 * power(({n}) % 5, 3))"


def _anchor_lon(n: str) -> str:
    return f"(floor(({n}) / 5.0) * 0.02)"


def pings(d: Dialect) -> str:
    """id, tid, lat, lon, alt, acc, tst, source: devices that move between anchors every four hours."""
    b = "CAST(floor(tst / 14400.0) AS BIGINT)"
    anchor = lambda b: f"CASE WHEN ({b}) % 6 IN (0, 1) AND CAST(floor(({b}) / 6.0) AS BIGINT) % 7 < 4 THEN 0 ELSE (tid * 7 + ({b}) * 11 + (({b}) * ({b})) % 13) % 25 END"
    return f"""
    SELECT event_id AS id, tid, a0lat + f * (a1lat - a0lat) + (k - 50) * 1e-5 AS lat, a0lon + f * (a1lon - a0lon) + (k - 50) * 1e-5 AS lon,
           value AS alt, CASE WHEN k = 99 THEN CAST(250 AS DOUBLE) WHEN k % 10 = 0 THEN NULL ELSE CAST(5 + k % 40 AS DOUBLE) END AS acc, tst, 'owntracks' AS source
    FROM (SELECT *, least(CAST(1 AS DOUBLE), CAST(tst % 14400 AS DOUBLE) / 3600) AS f, {_anchor_lat("p0")} AS a0lat, {_anchor_lon("p0")} AS a0lon, {_anchor_lat("p1")} AS a1lat, {_anchor_lon("p1")} AS a1lon
          FROM (SELECT event_id, tid, tst, k, value, {anchor(f"{b} - 1")} AS p0, {anchor(b)} AS p1
                FROM (SELECT event_id, {person('user_id')} AS tid, {d.unix("ts")} AS tst, CAST({d.json("props", "$.k")} AS BIGINT) AS k, value FROM {{events}}) e0) e1) e2"""


def places(d: Dialect) -> str:
    return f"""
    SELECT c_custkey AS id, {person('c_custkey')} AS tid, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS name,
           {d.pick("(length(c_mktsegment) + c_custkey) % 8", CATEGORIES)} AS category,
           CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE concat('CITY_', CAST(c_custkey % 97 AS VARCHAR(9))) END AS city,
           n_name AS country, CASE WHEN n_nationkey = 0 THEN 'GB' WHEN n_nationkey = 7 THEN NULL ELSE concat({d.letter("65 + floor(n_nationkey / 5.0)")}, {d.letter("65 + n_nationkey % 5")}) END AS country_code,
           CASE WHEN c_custkey % 41 = 0 THEN '{{{{"address":' ELSE concat('{{{{"address":{{{{"county":"County ', CAST(c_custkey % 23 AS VARCHAR(9)), '"}}}}}}}}') END AS raw_json,
           CAST({_anchor_lat("n_nationkey")} + (c_custkey % 100) * 0.001 AS DOUBLE) AS lat, CAST({_anchor_lon("n_nationkey")} + (c_custkey % 37) * 0.001 AS DOUBLE) AS lon
    FROM {{customer}} c JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey"""


def visits(d: Dialect) -> str:
    start = f"{d.unix('o_orderdate')} + (o_orderkey * 7919) % 86400"
    return f"""
    SELECT o_orderkey AS id, {person('o_custkey')} AS tid, {start} AS start_ts, {start} + 600 + (o_orderkey * 104729) % 28800 AS end_ts, o_custkey AS place_id,
           CASE WHEN o_orderkey % 19 = 0 THEN 'kml_import' WHEN o_orderstatus = 'F' THEN 'owntracks' WHEN o_orderstatus = 'O' THEN 'google_import' ELSE 'photo_import' END AS source, 1 AS point_count
    FROM {{orders}}"""


def segments(d: Dialect) -> str:
    start = f"{d.unix('l_shipdate')} + (l_orderkey * 31 + l_linenumber * 3571) % 86400"
    return f"""
    SELECT {person('l_orderkey')} AS tid, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, {start} AS start_ts, {start} + CAST(l_quantity * 60 AS BIGINT) AS end_ts,
           {d.pick("l_suppkey % 11", MODES)} AS mode, l_extendedprice AS distance_m, l_quantity * 60.0 AS duration_s
    FROM {{lineitem}}"""


def trips(d: Dialect) -> str:
    start = f"{d.unix('o_orderdate')} + (o_orderkey * 7919) % 86400"
    return f"""
    SELECT o_orderkey AS id, {person('o_custkey')} AS tid, {start} AS start_ts, {start} + (1 + o_orderkey % 14) * 86400 - (o_orderkey % 7) * 3600 AS end_ts,
           p.city AS primary_city, p.country AS primary_country, p.country_code AS primary_country_code,
           CASE WHEN o_orderpriority LIKE '1%' THEN concat('Trip ', CAST(o_orderkey % 5 AS VARCHAR(9))) END AS name
    FROM {{orders}} o JOIN places p ON o.o_custkey = p.id"""


def photos(d: Dialect) -> str:
    return f"""
    SELECT page_id AS uid, {person('page_id')} AS tid, 788918400 + (page_id * 7919 * 3600) % 200000000 AS taken_ts,
           CASE WHEN page_id % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(50 + (page_id % 400) * 0.01 AS DOUBLE) END AS lat, CASE WHEN page_id % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((page_id % 90) * 0.02 AS DOUBLE) END AS lon
    FROM {{pages}}"""


def home_periods(d: Dialect) -> str:
    """Two for each person: one before 1998 without a start, one after without an end, elsewhere."""
    each = f"(SELECT DISTINCT {person('c_custkey')} AS x FROM {{customer}})"
    return f"""
    SELECT 2 * x + 1 AS id, x AS tid, CAST(NULL AS BIGINT) AS start_ts, CAST(883612800 AS BIGINT) AS end_ts, CAST(50 AS DOUBLE) AS lat, CAST(0 AS DOUBLE) AS lon, CAST(500 AS DOUBLE) AS radius_m FROM {each} a
    UNION ALL SELECT 2 * x + 2, x, CAST(883612800 AS BIGINT), CAST(NULL AS BIGINT), CAST(50.03 AS DOUBLE), CAST(0.02 AS DOUBLE), CAST(500 AS DOUBLE) FROM {each} b"""


VIEWS = {"pings": pings, "places": places, "visits": visits, "segments": segments, "trips": trips, "photos": photos, "home_periods": home_periods}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = VIEWS[name](SPARK).replace("VARCHAR(9)", "STRING")
    if name == "trips":
        text = text.replace(" places p", " {places} p")
        return spark.sql(text, orders=read("orders"), places=frame(spark, sf_dir, "places"))
    used = [t for t in TABLES if f"{{{t}}}" in text]
    return spark.sql(text, **{t: read(t) for t in used}) if used else spark.sql(text)


def check_views(d: Dialect, wanted: set[str]) -> str:
    """WITH items for the checking database."""
    if "trips" in wanted:
        wanted = wanted | {"places"}
    parts = []
    for name in ("pings", "places", "visits", "segments", "trips", "photos", "home_periods"):
        if name in wanted:
            text = VIEWS[name](d)
            for t in TABLES:
                text = text.replace(f"{{{t}}}", t)
            parts.append(f"{name} AS ({text.replace('{{', '{').replace('}}', '}')})")
    return ", ".join(parts)
