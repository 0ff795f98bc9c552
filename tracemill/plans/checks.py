"""The statements that check the reports, in the checking database's own SQL.

They are written apart from reports.py and in another manner: plain range joins in place of bins, ranks and lists in place of
min_by, recursion or self joins in place of islands.
"""

from __future__ import annotations

from ..constants import MOON_DISTANCE, SPEED_CEILINGS, WORLD_COUNTRIES
from .dialect import CHECK as D
from .fixtures import MODES
from .reports import A_DAY, BIRTH, DECADE_S

NOW = "(SELECT max(end_ts) FROM visits)"
DAY, MONTH, YEAR = D.day, D.month, D.year
PV = "(SELECT v.tid, v.id AS vid, v.start_ts, v.end_ts, v.place_id, p.name, p.category, p.city, p.country, p.country_code, p.raw_json, p.lat, p.lon FROM visits v, places p WHERE v.place_id = p.id)"
RANK = "CASE mode " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODES)) + f" ELSE {len(MODES)} END"
CEILING = "CASE mode " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in SPEED_CEILINGS.items()) + " END"
S_ORDER = "start_ts, k1, k2, k3, k4, distance_m"
#: A month as a number, and its text.
MN = "CAST({y} * 12 + {m} - 1 AS BIGINT)"


def mnum(ts: str) -> str:
    return MN.format(y=YEAR(ts), m=D.month_of_year(ts))


def mtext(n: str) -> str:
    return f"printf('%04d-%02d', CAST(floor({n} / 12.0) AS INT), CAST({n} % 12 + 1 AS INT))"


def upto(low: str, high: str) -> str:
    return f"unnest(range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1))"


def first(source: str, order: str, keys: str = "tid") -> str:
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1)"


def busiest(table: str, unit: str, name: str, count: str) -> str:
    return f"SELECT tid, {name}, {count} FROM {first(f'(SELECT tid, {unit} AS {name}, count(*) AS {count} FROM {table} GROUP BY ALL)', f'{count} DESC, {name}')}"


def most_visited(where: str) -> str:
    return f"SELECT tid, place_id, name, city, category, n_visits FROM {first(f'(SELECT tid, place_id, name, city, category, count(*) AS n_visits FROM {PV} WHERE name IS NOT NULL AND {where} GROUP BY ALL)', 'n_visits DESC, place_id')}"


YEARS = f"""n AS (SELECT tid, y, sum(d) AS d, sum(v) AS v FROM (SELECT tid, {YEAR('start_ts')} AS y, distance_m AS d, 0 AS v FROM segments UNION ALL SELECT tid, {YEAR('start_ts')}, 0.0, 1 FROM visits) GROUP BY ALL),
ys AS (SELECT a.tid, b.y FROM (SELECT tid, min(y) AS lo, max(y) AS hi FROM n GROUP BY tid) a JOIN (SELECT range AS y FROM range(1900, 2200)) b ON b.y BETWEEN a.lo AND a.hi),
yt AS (SELECT ys.tid, CAST(ys.y AS INT) AS year, round(coalesce(n.d, 0.0), 2) AS distance_m, CAST(coalesce(n.v, 0) AS BIGINT) AS n_visits FROM ys LEFT JOIN n USING (tid, y))"""
MONTHS = f"""n AS (SELECT tid, {mnum('start_ts')} AS m, count(*) AS n_visits, min(start_ts) AS min_ts, max(start_ts) AS max_ts FROM visits GROUP BY ALL),
ms AS (SELECT tid, {upto('min(m)', 'max(m)')} AS m FROM n GROUP BY tid), d AS (SELECT tid, {mtext('m')} AS month, coalesce(n_visits, 0) AS n_visits, min_ts, max_ts FROM ms LEFT JOIN n USING (tid, m))"""
SHARES = f"""n AS (SELECT tid, {YEAR('start_ts')} AS year, mode, sum(distance_m) AS d FROM segments GROUP BY ALL), h AS (SELECT tid, min(year) AS lo, max(year) AS hi FROM n GROUP BY tid),
sp AS (SELECT DISTINCT h.tid, r.range AS year, n.mode FROM h JOIN range(1900, 2200) r ON r.range BETWEEN lo AND hi JOIN n ON n.tid = h.tid),
sh AS (SELECT sp.tid, CAST(sp.year AS INT) AS year, sp.mode, coalesce(round_even(n.d / (SELECT sum(d) FROM n t WHERE t.tid = sp.tid AND t.year = sp.year) * 100, 2), 0.0) AS share,
  round(coalesce((SELECT sum(d) FROM n t WHERE t.tid = sp.tid AND t.year = sp.year), 0.0), 2) AS total_m, {RANK.replace('mode', 'sp.mode', 1)} AS position FROM sp LEFT JOIN n ON n.tid = sp.tid AND n.year = sp.year AND n.mode = sp.mode)"""
#: Chains as a running count of breaks.
CHAIN = f"""a AS (SELECT *, CASE WHEN lag(mode) OVER w = mode AND mode <> 'flying' AND start_ts - lag(end_ts) OVER w <= 7200 THEN 0 ELSE 1 END AS new FROM segments WINDOW w AS (PARTITION BY tid ORDER BY {S_ORDER})),
b AS (SELECT *, sum(new) OVER (PARTITION BY tid ORDER BY {S_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g, row_number() OVER (PARTITION BY tid ORDER BY {S_ORDER}) AS i FROM a),
j AS (SELECT tid, g, min(mode) AS mode, min(start_ts) AS start_ts, max_by(end_ts, i) AS end_ts, sum(distance_m) AS distance_m, sum(duration_s) AS duration_s, count(*) AS n FROM b GROUP BY tid, g)"""
ENDS = f"""pv AS MATERIALIZED (SELECT * FROM {PV})"""


def with_ends(source: str) -> str:
    """source (tid, start_ts, end_ts ...) with the visits on both sides: x (before) and y (after)."""
    return f"""(SELECT c.*, coalesce(x.name, x.city, x.country) AS start_name, coalesce(y.name, y.city, y.country) AS end_name, x.place_id AS from_place, y.place_id AS to_place, {D.metres('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS ends_m FROM {source} c
LEFT JOIN LATERAL (SELECT * FROM pv WHERE pv.tid = c.tid AND pv.end_ts <= c.start_ts ORDER BY pv.end_ts DESC, pv.start_ts DESC, pv.vid DESC LIMIT 1) x ON true
LEFT JOIN LATERAL (SELECT * FROM pv WHERE pv.tid = c.tid AND pv.start_ts >= c.end_ts ORDER BY pv.start_ts, pv.end_ts, pv.vid LIMIT 1) y ON true)"""


DEST = "dt AS (SELECT *, CASE WHEN name IS NULL AND primary_city IS NULL AND primary_country_code IS NULL THEN id END AS own, greatest(1, CAST(floor((end_ts - start_ts) / 86400.0) AS BIGINT) + 1) AS days FROM trips)"
PAGE = """pg AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY s DESC, i DESC) AS position FROM (SELECT tid, name, primary_city, primary_country_code, own, count(*) AS n_trips, sum(days) AS days, max(end_ts) AS last_ts, max(start_ts) AS s, arg_max(id, (start_ts, id)) AS i FROM dt GROUP BY ALL))"""
TV = "tv AS (SELECT t.tid, t.id, t.start_ts AS ts, t.end_ts AS te, v.id AS vid, v.start_ts AS vs, v.end_ts AS ve, v.place_id FROM trips t JOIN visits v ON v.tid = t.tid AND v.start_ts >= t.start_ts AND v.start_ts < t.end_ts)"
CEILD = "CAST(ceil(({}) / 86400.0) AS BIGINT)"
COAL = """o AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY start_ts, id) AS i FROM {src}),
r AS (SELECT tid, i, id, place_id, start_ts, end_ts, 1 AS n, 1 AS g FROM o WHERE i = 1 UNION ALL
SELECT o.tid, o.i, CASE WHEN same THEN r.id ELSE o.id END, o.place_id, CASE WHEN same THEN r.start_ts ELSE o.start_ts END, CASE WHEN same THEN greatest(r.end_ts, o.end_ts) ELSE o.end_ts END, CASE WHEN same THEN r.n + 1 ELSE 1 END, CASE WHEN same THEN r.g ELSE r.g + 1 END
FROM r JOIN (SELECT o1.*, (SELECT 1) AS one FROM o o1) o ON o.tid = r.tid AND o.i = r.i + 1, LATERAL (SELECT coalesce(o.place_id = r.place_id AND o.start_ts - r.end_ts <= 10800, false) AS same) s),
co AS (SELECT tid, g, max(id) AS id, max(place_id) AS place_id, max(start_ts) AS start_ts, max(end_ts) AS end_ts, max(n) AS n_visits FROM r GROUP BY tid, g)"""
ON_DAY = f"start_ts < {A_DAY + 86400} AND end_ts >= {A_DAY}"
PEOPLE = "(SELECT tid FROM {} UNION SELECT tid FROM {})"

CHECKS: dict[str, str] = {
    "visit_month_density": f"WITH {MONTHS} SELECT * FROM d",
    "busiest_day": busiest("visits", DAY("start_ts"), "day", "n_visits"),
    "busiest_month": busiest("visits", MONTH("start_ts"), "month", "n_visits"),
    "busiest_trip_year": busiest("trips", YEAR("start_ts"), "year", "n_trips"),
    "peak_month": f"WITH {MONTHS} SELECT tid, CAST(sum(n_visits) AS BIGINT) AS n_visits, count(*) FILTER (WHERE n_visits > 0) AS active_months, min(month) AS first_month, max(month) AS last_month, arg_max(month, (n_visits, -CAST(replace(month, '-', '') AS INT))) AS peak_month, max(n_visits) AS peak_visits FROM d GROUP BY tid",
    "seasonality": f"""SELECT p.tid, CAST(m.range AS INT) AS month_of_year, round(coalesce((SELECT sum(distance_m) FROM segments s WHERE s.tid = p.tid AND {D.month_of_year('s.start_ts')} = m.range), 0.0), 2) AS distance_m,
        (SELECT count(*) FROM visits v WHERE v.tid = p.tid AND {D.month_of_year('v.start_ts')} = m.range) AS n_visits FROM {PEOPLE.format('segments', 'visits')} p, range(1, 13) m""",
    "weekday_pattern": f"SELECT p.tid, CAST(w.range AS INT) AS weekday, (SELECT count(*) FROM trips t WHERE t.tid = p.tid AND {D.weekday('t.start_ts')} = w.range) AS departures, (SELECT count(*) FROM trips t WHERE t.tid = p.tid AND {D.weekday('t.end_ts')} = w.range) AS returns FROM (SELECT DISTINCT tid FROM trips) p, range(0, 7) w",
    "yearly_trend": f"WITH {YEARS} SELECT * FROM yt",
    "night_owl": f"""WITH m AS (SELECT *, CAST(floor((start_ts % 86400) / 60) AS INT) AS q FROM visits), b AS {first('m', 'CASE WHEN q >= 720 THEN q ELSE q + 1440 END DESC, id')}
        SELECT b.tid, b.id, printf('%02d:%02d', q // 60, q % 60) AS time, {DAY('b.start_ts')} AS day, p.name AS place_name, p.city FROM b LEFT JOIN places p ON b.place_id = p.id""",
    "longest_day_out": f"SELECT tid, day, seconds FROM {first('(SELECT a.tid, ' + DAY('a.start_ts') + ' AS day, max(b.start_ts - a.start_ts) AS seconds FROM visits a JOIN visits b ON a.tid = b.tid AND floor(a.start_ts / 86400.0) = floor(b.start_ts / 86400.0) AND a.id <> b.id GROUP BY ALL)', 'seconds DESC, day')}",
    "most_visited_place": most_visited("true"),
    "most_visited_airport": most_visited("category = 'Airports'"),
    "most_visited_station": most_visited("category = 'Transport'"),
    "most_visited_country": f"SELECT tid, country_code, country, n_visits FROM {first(f'(SELECT tid, country_code, max(country) AS country, count(*) AS n_visits FROM {PV} WHERE country_code IS NOT NULL GROUP BY 1, 2)', 'n_visits DESC, country_code')}",
    "most_visited_city": f"SELECT tid, city, n_visits FROM {first(f'(SELECT tid, city, count(*) AS n_visits FROM {PV} WHERE city IS NOT NULL GROUP BY 1, 2)', 'n_visits DESC, city')}",
    "totals": f"""SELECT tid, (SELECT count(*) FROM visits v WHERE v.tid = q.tid) AS n_visits, coalesce((SELECT round(sum(distance_m), 2) FROM segments s WHERE s.tid = q.tid), 0.0) AS distance_m, (SELECT count(DISTINCT country_code) FROM places p WHERE p.tid = q.tid) AS n_countries,
        (SELECT count(DISTINCT city) FROM places p WHERE p.tid = q.tid) AS n_cities, round_even((SELECT count(DISTINCT country_code) FROM places p WHERE p.tid = q.tid) * 100.0::DOUBLE / {WORLD_COUNTRIES}, 1) AS percent_of_world FROM (SELECT tid FROM visits UNION SELECT tid FROM places UNION SELECT tid FROM segments) q""",
    "farthest_place": f"""WITH h AS {first('(SELECT * FROM home_periods WHERE end_ts IS NULL)', 'id')}, m AS (SELECT h.tid, p.id AS place_id, p.name, p.city, p.country, p.category, {D.metres('h.lat', 'h.lon', 'p.lat', 'p.lon')} AS metres FROM places p JOIN h ON EXISTS (SELECT 1 FROM visits v WHERE v.place_id = p.id AND v.tid = h.tid) WHERE p.name IS NOT NULL)
        SELECT tid, place_id, name, city, country, category, round(metres, 1) AS metres FROM {first('m', 'metres DESC, place_id')}""",
    "newest_place": f"SELECT tid, place_id, name, city, category, {DAY('f')} AS day FROM {first(f'(SELECT tid, place_id, name, city, category, min(start_ts) AS f FROM {PV} WHERE name IS NOT NULL GROUP BY ALL)', 'f DESC, place_id')}",
    "county_coverage": f"""WITH c AS (SELECT tid, {D.json('raw_json', '$.address.county')} AS county, count(*) AS n_visits FROM {PV} WHERE country_code = 'GB' GROUP BY ALL HAVING county <> '')
        SELECT tid, count(*) AS n_counties, arg_min(county, (n_visits, county)) AS county, min(n_visits) AS n_visits FROM c GROUP BY tid""",
    "chain_tour": "SELECT p.tid, count(*) AS n_branches, CAST(sum((SELECT count(*) FROM visits v WHERE v.place_id = p.id)) AS BIGINT) AS n_visits FROM places p WHERE p.name ILIKE '%7%' GROUP BY 1",
    "longest_stay_away": f"SELECT tid, vid AS id, name AS place_name, city, end_ts - start_ts AS seconds, {DAY('start_ts')} AS day FROM {first(f'(SELECT * FROM {PV} WHERE category <> $$Home$$ AND category <> $$Work$$)', 'end_ts - start_ts DESC, start_ts, vid')}",
    "category_totals": f"SELECT tid, category, CAST(sum(CASE WHEN end_ts > start_ts THEN end_ts - start_ts ELSE 0 END) AS BIGINT) AS seconds, count(*) AS n_visits FROM {PV} GROUP BY 1, 2",
    "favourite_category": f"SELECT tid, category, seconds FROM {first(f'(SELECT tid, category, CAST(sum(greatest(end_ts - start_ts, 0)) AS BIGINT) AS seconds FROM {PV} GROUP BY 1, 2)', 'seconds DESC, category')}",
    "airport_time": f"SELECT tid, CAST(sum(end_ts - start_ts) FILTER (WHERE end_ts > start_ts) AS BIGINT) AS seconds FROM {PV} WHERE category = 'Airports' GROUP BY 1 HAVING seconds > 0",
    "place_categories": "SELECT tid, category, sum(1)::BIGINT AS n_places FROM places GROUP BY 1, 2",
    "places_in_category": "SELECT p.tid, p.id, p.name, p.city, (SELECT count(*) FROM visits v WHERE v.place_id = p.id) AS n_visits, (SELECT max(end_ts) FROM visits v WHERE v.place_id = p.id) AS last_ts FROM places p WHERE p.category = 'Shopping' AND EXISTS (SELECT 1 FROM visits v WHERE v.place_id = p.id)",
    "place_visits": "SELECT tid, id, start_ts, end_ts FROM visits WHERE place_id IN (7)",
    "first_visit_per_country": f"SELECT tid, country_code, country, start_ts, place_id FROM {first(f'(SELECT * FROM {PV} WHERE country_code IS NOT NULL)', 'start_ts, vid', 'tid, country_code')}",
    "cities": f"SELECT tid, city, max(country) AS country, max(country_code) AS country_code, count(DISTINCT place_id) AS n_places, max(end_ts) AS last_ts FROM {PV} WHERE city IS NOT NULL GROUP BY 1, 2",
    "cities_page": f"""WITH c AS (SELECT tid, city, max(country) AS country, max(country_code) AS country_code, count(DISTINCT place_id) AS n_places, max(end_ts) AS last_ts FROM {PV} WHERE city IS NOT NULL GROUP BY 1, 2)
        SELECT * FROM (SELECT c.*, (SELECT count(*) FROM c o WHERE o.tid = c.tid AND (o.last_ts > c.last_ts OR o.last_ts = c.last_ts AND o.city <= c.city)) AS position, (SELECT count(*) FROM c o WHERE o.tid = c.tid) AS n_cities FROM c) WHERE position > 8 AND position <= 16""",
    "city_detail": "SELECT p.tid, p.id, p.name, p.category, round(p.lat, 6) AS lat, round(p.lon, 6) AS lon, count(*) AS n_visits, max(v.end_ts) AS last_ts FROM places p JOIN visits v ON v.place_id = p.id WHERE p.city = 'CITY_5' GROUP BY ALL",
    "world": f"SELECT tid, CASE WHEN country_code IS NULL THEN country ELSE country_code END AS code, max(country) AS country, max(country_code) AS country_code, count(DISTINCT city) AS n_cities, max(end_ts) AS last_ts FROM {PV} WHERE country IS NOT NULL GROUP BY 1, 2",
    "country_detail": f"SELECT tid, city, count(DISTINCT place_id) AS n_places, max(end_ts) AS last_ts FROM {PV} WHERE country_code = 'GB' AND city IS NOT NULL GROUP BY 1, 2",
    "country_pins": "SELECT tid, id, round(lat, 6) AS lat, round(lon, 6) AS lon, name, category, city FROM places WHERE country_code = 'GB'",
    "world_share": f"SELECT tid, len(list_distinct(list(country_code) FILTER (WHERE country_code IS NOT NULL)))::BIGINT AS n_countries, round_even(count(DISTINCT country_code) * 100.0::DOUBLE / {WORLD_COUNTRIES}, 1) AS share FROM places GROUP BY 1",
    "photo_groups": "SELECT tid, CAST(printf('%.4f', lat) AS DOUBLE) AS lat, CAST(printf('%.4f', lon) AS DOUBLE) AS lon, count(*) AS n_photos FROM photos WHERE lat <> 0 OR lon <> 0 GROUP BY 1, 2, 3",
    "mode_totals": "SELECT tid, mode, round(sum(distance_m), 2) AS distance_m, round(sum(duration_s), 2) AS duration_s FROM segments GROUP BY 1, 2",
    "mode_share": f"WITH {SHARES} SELECT * FROM sh",
    "stacked_share": f"WITH {SHARES} SELECT a.tid, a.year, a.mode, round(sum(b.share), 2) AS upto FROM sh a JOIN sh b ON a.tid = b.tid AND a.year = b.year AND b.position <= a.position GROUP BY 1, 2, 3",
    "odometer": f"WITH {YEARS} SELECT a.tid, a.year, round(sum(b.distance_m), 2) AS distance_m, round(sum(b.distance_m) / {MOON_DISTANCE} * 100, 4) AS to_moon FROM yt a JOIN yt b ON a.tid = b.tid AND b.year <= a.year GROUP BY 1, 2",
    "trend_delta": f"WITH {MONTHS} SELECT a.tid, a.month, a.n_visits AS n, CASE WHEN b.n_visits <> 0 THEN CAST(floor((a.n_visits - b.n_visits) * 100.0 / b.n_visits + 0.5) AS INT) END AS delta FROM d a LEFT JOIN d b ON a.tid = b.tid AND b.month = strftime(strptime(a.month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m')",
    "year_over_year": f"SELECT tid, year, n, CAST(floor((n - was) * 100.0 / was + 0.5) AS INT) AS delta FROM (SELECT *, lag(n) OVER (PARTITION BY tid ORDER BY year) AS was FROM (SELECT tid, {YEAR('start_ts')} AS year, count(*) AS n FROM trips GROUP BY 1, 2))",
    "monthly_insights": f"""WITH n AS (SELECT tid, mode, {mnum('start_ts')} AS m, sum(distance_m) AS d, sum(duration_s) AS s FROM segments GROUP BY ALL)
        SELECT a.tid, {mtext('a.m')} AS month, a.mode, round(a.d, 2) AS distance_m, round(a.s, 2) AS duration_s, {', '.join(f'round(coalesce((SELECT b.d FROM n b WHERE b.tid = a.tid AND b.mode = a.mode AND b.m = a.m - {5 - i}), 0.0), 2) AS trend_{i}' for i in range(6))} FROM n a WHERE a.d >= 160.9344""",
    "monthly_categories": f"""WITH n AS (SELECT tid, category, {mnum('start_ts')} AS m, CAST(sum(greatest(end_ts - start_ts, 0)) AS BIGINT) AS s FROM {PV} GROUP BY ALL)
        SELECT a.tid, {mtext('a.m')} AS month, a.category, a.s AS seconds, {', '.join(f'coalesce((SELECT b.s FROM n b WHERE b.tid = a.tid AND b.category = a.category AND b.m = a.m - {5 - i}), 0) AS trend_{i}' for i in range(6))} FROM n a WHERE a.s >= 60""",
    "fastest_journey": f"""WITH {ENDS}, s AS (SELECT *, {CEILING} AS c FROM segments WHERE duration_s >= 60),
        f AS (SELECT * FROM s WHERE mode = 'flying' QUALIFY row_number() OVER (PARTITION BY tid ORDER BY distance_m / duration_s DESC, {S_ORDER}) <= 30),
        k AS (SELECT tid, mode, start_ts, (distance_m / 1000) / (duration_s / 3600) AS kmh FROM s WHERE mode <> 'flying' AND distance_m / duration_s <= c / 3.6 UNION ALL SELECT tid, mode, start_ts, (ends_m / 1000) / (duration_s / 3600) FROM {with_ends('f')} WHERE (ends_m / 1000) / (duration_s / 3600) <= c)
        SELECT tid, mode, round_even(kmh, 0) AS kmh, {DAY('start_ts')} AS day FROM {first('(SELECT * FROM k WHERE kmh > 0)', f'kmh DESC, {RANK}, start_ts')}""",
    "longest_by_mode": f"""WITH {CHAIN}, {ENDS}, q AS (SELECT tid, mode, start_ts, end_ts, round(distance_m, 2) AS d, row_number() OVER (PARTITION BY tid, mode ORDER BY round(distance_m, 2) DESC, start_ts, end_ts) AS r FROM j),
        e AS (SELECT * FROM {with_ends("(SELECT * FROM q WHERE r = 1 OR mode = 'flying')")}), z AS (SELECT *, CASE WHEN mode = 'flying' THEN round(ends_m, 1) ELSE d END AS far FROM e WHERE mode <> 'flying' OR ends_m IS NOT NULL)
        SELECT tid, mode, far AS distance_m, start_name, end_name, {DAY('start_ts')} AS day FROM {first('z', 'far DESC, r', 'tid, mode')}""",
    "trip_totals": f"""SELECT tid, count(*) AS n_trips, CAST(sum({CEILD.format('end_ts - start_ts')}) AS BIGINT) AS trip_days, round_even(sum({CEILD.format('end_ts - start_ts')})::DOUBLE / count(*), 1) AS avg_days,
        CAST(floor(({NOW} - arg_max(end_ts, (start_ts, id))) / 86400.0) AS BIGINT) AS days_since, round_even(sum({CEILD.format('end_ts - start_ts')})::DOUBLE / (({NOW} - ({BIRTH})) / 86400.0) * 100, 2) AS life_percent FROM trips GROUP BY 1""",
    "longest_gap": "SELECT a.tid, CAST(max(floor((b.start_ts - a.end_ts) / 86400.0)) AS BIGINT) AS days FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY start_ts, id) AS i FROM trips) a JOIN (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY start_ts, id) AS i FROM trips) b ON a.tid = b.tid AND b.i = a.i + 1 GROUP BY 1",
    "trip_records": " UNION ALL ".join(
        f"SELECT tid, '{n}' AS record, id, name, primary_city, primary_country, round_even((end_ts - start_ts) / 86400.0, 0) AS days, {y} AS years_ago FROM {first(f'(SELECT * FROM trips WHERE {w})', o)}"
        for n, w, o, y in (("longest", "true", "end_ts - start_ts DESC, start_ts, id", "NULL::DOUBLE"), ("shortest", "end_ts - start_ts >= 86400", "end_ts - start_ts, start_ts, id", "NULL::DOUBLE"), ("first", "true", "start_ts, id", f"round_even(({NOW} - start_ts) / 86400.0 / 365.25, 1)"))
    ),
    "away_heatmap": f"""WITH y AS (SELECT tid, min({YEAR('start_ts')}) AS lo, max({YEAR('start_ts')}) AS hi FROM visits GROUP BY 1), d AS (SELECT y.tid, epoch(t.range)::BIGINT AS a FROM y JOIN range(TIMESTAMP '1990-01-01', TIMESTAMP '2030-01-01', INTERVAL 1 DAY) t ON year(t.range) BETWEEN lo AND hi),
        w AS (SELECT d.tid, d.a, sum(least(t.end_ts, d.a + 86400) - greatest(t.start_ts, d.a)) AS s FROM d JOIN trips t ON t.tid = d.tid AND t.start_ts < d.a + 86400 AND t.end_ts > d.a GROUP BY 1, 2), v AS (SELECT tid, start_ts - start_ts % 86400 AS a, count(*) AS n FROM visits GROUP BY 1, 2)
        SELECT d.tid, {DAY('d.a')} AS day, coalesce(v.n, 0) AS n_visits, CAST(coalesce(w.s, 0) AS BIGINT) AS away_s, round_even(coalesce(w.s, 0)::DOUBLE / 3600, 1) AS away_hours FROM d LEFT JOIN w USING (tid, a) LEFT JOIN v USING (tid, a)""",
    "life_calendar": f"""WITH k AS (SELECT tid, coalesce((SELECT min(start_ts) FROM home_periods h WHERE h.tid = p.tid), (SELECT min(start_ts) FROM visits v WHERE v.tid = p.tid)) AS seen FROM (SELECT tid FROM visits UNION SELECT tid FROM home_periods) p),
        w AS (SELECT k.*, {BIRTH} + 604800 * r.range AS a, r.range AS week FROM k, range(0, CAST(ceil(({NOW} - ({BIRTH})) / 604800.0) AS BIGINT)) r),
        s AS (SELECT w.tid, w.week, sum(least(t.end_ts, a + 604800) - greatest(t.start_ts, a)) AS s FROM w JOIN trips t ON t.tid = w.tid AND t.start_ts < a + 604800 AND t.end_ts > a GROUP BY 1, 2)
        SELECT w.tid, CAST(w.week AS INT) AS week, {DAY('w.a')} AS start_date, coalesce(a + 604800 > seen, false) AS has_data, CASE WHEN a + 604800 > seen THEN round_even(coalesce(s.s, 0)::DOUBLE / 604800, 3) ELSE 0.0 END AS away_share FROM w LEFT JOIN s USING (tid, week)""",
    "decade_of_life": f"""WITH d AS (SELECT tid, r.range AS i, {BIRTH} + r.range * {DECADE_S} AS a, {BIRTH} + (r.range + 1) * {DECADE_S} AS b FROM {PEOPLE.format('trips', 'segments')}, range(0, CAST(floor(({NOW} - ({BIRTH})) / {DECADE_S}.0) AS BIGINT) + 1) r)
        SELECT tid, CAST(i * 10 AS INT) AS age_start, CAST(i * 10 + 9 AS INT) AS age_end, round(coalesce((SELECT sum(distance_m) FROM segments s WHERE s.tid = d.tid AND s.start_ts >= d.a AND s.start_ts < d.b), 0.0), 2) AS distance_m,
        CAST(coalesce((SELECT sum({CEILD.format('least(end_ts, b) - greatest(start_ts, a)')}) FROM trips t WHERE t.tid = d.tid AND least(end_ts, b) > greatest(start_ts, a)), 0) AS BIGINT) AS trip_days FROM d""",
    "streaks": f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY start_ts, id) AS i FROM trips), g AS (SELECT a.tid, max(b.start_ts - a.end_ts) AS home FROM o a JOIN o b ON a.tid = b.tid AND b.i = a.i + 1 GROUP BY 1), l AS (SELECT * FROM o QUALIFY i = max(i) OVER (PARTITION BY tid))
        SELECT l.tid, round_even((SELECT max(end_ts - start_ts) FROM trips t WHERE t.tid = l.tid) / 86400.0, 0) AS longest_away_days, round_even(g.home / 86400.0, 0) AS longest_home_days, CASE WHEN l.end_ts >= {NOW} THEN 'away' ELSE 'home' END AS current,
        round_even(({NOW} - CASE WHEN l.end_ts >= {NOW} THEN l.start_ts ELSE l.end_ts END) / 86400.0, 0) AS current_days FROM l LEFT JOIN g USING (tid)""",
    "destination_concentration": """WITH n AS (SELECT tid, primary_city AS city, count(*) AS n_trips FROM trips WHERE primary_city IS NOT NULL GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY n_trips DESC, city) AS rank FROM n QUALIFY rank <= 5), s AS (SELECT tid, sum(n_trips) AS t5 FROM f GROUP BY 1), a AS (SELECT tid, count(*) AS t FROM trips GROUP BY 1)
        SELECT f.tid, f.city, f.n_trips, CAST(f.rank AS INT) AS rank, CAST(s.t5 AS BIGINT) AS top5_trips, a.t AS total_trips, round_even(s.t5::DOUBLE * 100 / a.t, 1) AS top5_percent FROM f JOIN s USING (tid) JOIN a USING (tid)""",
    "trip_destinations": f"""WITH {DEST}, {PAGE} SELECT tid, name, primary_city, primary_country_code, own, n_trips, CAST(days AS BIGINT) AS days, last_ts, CAST(position AS INT) AS position, (SELECT count(*) FROM pg o WHERE o.tid = pg.tid) AS n_destinations, (SELECT count(*) FROM trips t WHERE t.tid = pg.tid) AS all_trips, CAST((SELECT sum(days) FROM dt WHERE dt.tid = pg.tid) AS BIGINT) AS all_days FROM pg""",
    "trips_page": f"""WITH {DEST}, {PAGE}, {TV} SELECT dt.tid, CAST(pg.position AS INT) AS position, dt.id, dt.name, dt.start_ts, dt.end_ts, dt.days, (SELECT count(*) FROM tv WHERE tv.id = dt.id) AS n_visits
        FROM dt JOIN pg ON dt.tid = pg.tid AND dt.name IS NOT DISTINCT FROM pg.name AND dt.primary_city IS NOT DISTINCT FROM pg.primary_city AND dt.primary_country_code IS NOT DISTINCT FROM pg.primary_country_code AND dt.own IS NOT DISTINCT FROM pg.own WHERE pg.position <= 24""",
    "trip_scatter": """SELECT t.tid, t.id, round_even((t.end_ts - t.start_ts) / 86400.0, 1) AS days, round(sum(s.distance_m), 2) AS distance_m, coalesce(t.name, t.primary_city, t.primary_country) AS label
        FROM trips t JOIN segments s ON s.tid = t.tid AND s.start_ts >= t.start_ts AND s.start_ts < t.end_ts GROUP BY t.tid, t.id, t.start_ts, t.end_ts, label HAVING sum(s.distance_m) > 0 AND days > 0""",
    "trip_visits": f"WITH {TV} SELECT tv.tid, tv.id, count(*) AS n_visits, count(DISTINCT p.country_code) AS n_countries FROM tv JOIN places p ON p.id = tv.place_id GROUP BY 1, 2",
    "most_countries_in_a_trip": f"WITH {TV}, c AS (SELECT tv.tid, tv.id, count(DISTINCT p.country_code) AS n_countries FROM tv JOIN places p ON p.id = tv.place_id GROUP BY 1, 2 HAVING n_countries > 1) SELECT tid, id, n_countries FROM {first('c', 'n_countries DESC, id')}",
    "wrapped_years": f"""WITH yr AS (SELECT range AS y, epoch(make_date(CAST(range AS INT), 1, 1))::BIGINT AS a, epoch(make_date(CAST(range AS INT) + 1, 1, 1))::BIGINT AS b FROM range(1990, 2030)),
        s AS (SELECT tid, y, mode, sum(distance_m) AS d FROM segments, yr WHERE start_ts >= a AND start_ts < b GROUP BY ALL), sy AS (SELECT tid, y, sum(d) AS d, arg_max(mode, (round(d, 2), -ascii(mode), -ascii(mode[2]))) AS mode, max(round(d, 2)) AS mode_m FROM s GROUP BY ALL),
        t AS (SELECT t.*, y, least(end_ts, b) - greatest(start_ts, a) AS clip FROM trips t JOIN yr ON t.start_ts < b AND t.end_ts >= a),
        td AS (SELECT tid, y, sum({CEILD.format('clip')}) FILTER (WHERE clip > 0) AS trip_days, arg_max(id, (end_ts - start_ts, -id)) AS longest_trip, round_even(max(end_ts - start_ts) / 86400.0, 0) AS longest_days FROM t GROUP BY ALL),
        tc AS {first('(SELECT tid, y, primary_city AS city, sum(clip) AS s FROM t WHERE clip > 0 AND primary_city IS NOT NULL GROUP BY ALL)', 's DESC, city', 'tid, y')},
        v AS (SELECT DISTINCT tid, y, country_code FROM {PV}, yr WHERE start_ts >= a AND start_ts < b AND country_code IS NOT NULL), vc AS (SELECT tid, y, count(*) AS n_countries, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.tid = v.tid AND o.country_code = v.country_code AND o.y < v.y)) AS n_new FROM v GROUP BY ALL)
        SELECT k.tid, CAST(k.y AS INT) AS year, round(coalesce(sy.d, 0.0), 2) AS distance_m, round(coalesce(pr.d, 0.0), 2) AS prev_distance_m, CAST(coalesce(td.trip_days, 0) AS BIGINT) AS trip_days, (SELECT (b - a) // 86400 FROM yr WHERE yr.y = k.y) AS period_days, tc.city, round_even(tc.s / 86400.0, 0) AS city_days, td.longest_trip, td.longest_days,
        coalesce(vc.n_countries, 0) AS n_countries, round_even(coalesce(vc.n_countries, 0) * 100.0::DOUBLE / {WORLD_COUNTRIES}, 0) AS percent_of_world, coalesce(vc.n_new, 0) AS n_new, sy.mode, sy.mode_m, coalesce(sy.d, 0) > {MOON_DISTANCE} AS moon_trips
        FROM (SELECT tid, y FROM sy UNION SELECT tid, y FROM t UNION SELECT tid, y FROM vc) k LEFT JOIN sy USING (tid, y) LEFT JOIN td USING (tid, y) LEFT JOIN tc USING (tid, y) LEFT JOIN vc USING (tid, y) LEFT JOIN sy pr ON pr.tid = k.tid AND pr.y = k.y - 1""",
    "wrapped_all_time": f"""SELECT p.tid, CAST(coalesce((SELECT sum({CEILD.format('end_ts - start_ts')}) FROM trips t WHERE t.tid = p.tid), 0) AS BIGINT) AS trip_days, (SELECT round_even(({NOW} - min(start_ts)) / 86400.0 / 365.25, 1) FROM trips t WHERE t.tid = p.tid) AS years_tracked,
        (SELECT count(DISTINCT country_code) FROM {PV} q WHERE q.tid = p.tid) AS n_countries, coalesce((SELECT round(sum(distance_m), 2) FROM segments s WHERE s.tid = p.tid), 0.0) AS distance_m FROM (SELECT tid FROM trips UNION SELECT tid FROM visits UNION SELECT tid FROM segments) p""",
    "destination_pins": f"""WITH {DEST}, {TV}, o AS (SELECT tv.tid, dt.name, dt.primary_city, dt.primary_country_code, dt.own, tv.vid, p.lat, p.lon, row_number() OVER w AS i, first_value(p.lat) OVER w AS la, first_value(p.lon) OVER w AS lo
        FROM tv JOIN dt ON dt.id = tv.id JOIN places p ON p.id = tv.place_id WINDOW w AS (PARTITION BY tv.tid, dt.name, dt.primary_city, dt.primary_country_code, dt.own ORDER BY tv.ts DESC, tv.id DESC, tv.vs, tv.vid)), m AS (SELECT *, round({D.metres('la', 'lo', 'lat', 'lon')}, 1) AS metres FROM o)
        SELECT tid, name, primary_city, primary_country_code, own, vid, metres FROM {first('m', 'metres DESC, i', 'tid, name, primary_city, primary_country_code, own')}""",
    "home_periods": "SELECT tid, id, start_ts, end_ts, radius_m FROM home_periods",
    "coalesced_visits": f"WITH RECURSIVE {COAL.format(src='visits')} SELECT tid, id, place_id, start_ts, end_ts, CAST(n_visits AS BIGINT) AS n_visits FROM co",
    "day_timeline": f"""WITH RECURSIVE ov AS (SELECT * FROM visits WHERE {ON_DAY}), {COAL.format(src='ov')}, os AS (SELECT * FROM segments WHERE {ON_DAY}),
        al AS (SELECT tid, start_ts, 0 AS moving, end_ts FROM co UNION ALL SELECT tid, start_ts, 1, end_ts FROM os), la AS {first('al', 'start_ts DESC, moving DESC, end_ts DESC')},
        bk AS {first('(SELECT ov.tid, ov.id, ov.start_ts, ov.end_ts, ov.place_id, la.end_ts AS moved FROM la JOIN ov ON ov.tid = la.tid AND la.moving = 1 AND la.end_ts BETWEEN ov.start_ts AND ov.end_ts AND ov.place_id IS NOT NULL)', 'start_ts, id')},
        un AS (SELECT tid, 'visit' AS type, id, start_ts, end_ts, place_id, NULL::VARCHAR AS mode, NULL::DOUBLE AS distance_m FROM co UNION ALL SELECT tid, 'segment', k1, start_ts, end_ts, NULL, mode, distance_m FROM os UNION ALL SELECT tid, 'return', id, moved, end_ts, place_id, NULL, NULL FROM bk)
        SELECT un.*, p.name AS place_name, p.category, p.city FROM un LEFT JOIN places p ON un.place_id = p.id""",
    "day_modes": f"SELECT tid, mode, round(sum(distance_m), 2) AS distance_m, round(sum(duration_s), 2) AS duration_s FROM segments WHERE {ON_DAY} GROUP BY 1, 2",
    "day_points": "SELECT tid, id, tst, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pings WHERE tst BETWEEN 1704844800 AND 1704931199 AND coalesce(acc, 0) <= 100",
    "context_visits": f"SELECT tid, 'before' AS side, arg_max(id, (end_ts, id)) AS id, max(end_ts) AS at_ts FROM visits WHERE end_ts <= {A_DAY} GROUP BY 1 UNION ALL SELECT tid, 'after', arg_min(id, (start_ts, id)), min(start_ts) FROM visits WHERE start_ts >= {A_DAY + 86400} GROUP BY 1",
    "photo_clusters": f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY taken_ts, uid) AS i FROM photos WHERE NOT (lat = 0 AND lon = 0)),
        r AS (SELECT tid, i, taken_ts, lat, lon, 1 AS g FROM o WHERE i = 1 UNION ALL SELECT o.tid, o.i, o.taken_ts, o.lat, o.lon, CASE WHEN o.taken_ts - r.taken_ts <= 21600 AND {D.metres('r.lat', 'r.lon', 'o.lat', 'o.lon')} <= 1000 THEN r.g ELSE r.g + 1 END FROM r JOIN o ON o.tid = r.tid AND o.i = r.i + 1)
        SELECT tid, CAST(g AS BIGINT) AS g, min(taken_ts) AS start_ts, max(taken_ts) AS end_ts, count(*) AS n_photos, round(avg(lat), 5) AS lat, round(avg(lon), 5) AS lon FROM r GROUP BY tid, g""",
    "photos_in_visits": "SELECT f.tid, f.uid, arg_min(v.id, (v.start_ts, v.id)) AS visit_id FROM photos f JOIN visits v ON v.tid = f.tid AND f.taken_ts BETWEEN v.start_ts AND v.end_ts GROUP BY 1, 2",
    "trip_timeline": f"""WITH t AS {first('trips', 'end_ts - start_ts DESC, id')} SELECT t.tid, 'visit' AS kind, v.id AS k1, v.start_ts, v.end_ts FROM t JOIN visits v ON v.tid = t.tid AND v.start_ts >= t.start_ts AND v.start_ts < t.end_ts
        UNION ALL SELECT t.tid, s.mode, s.k1, s.start_ts, s.end_ts FROM t JOIN segments s ON s.tid = t.tid AND s.start_ts >= t.start_ts AND s.end_ts <= t.end_ts""",
    "stories": f"""WITH {YEARS}, sg AS (SELECT tid, sum(distance_m) AS d, sum(distance_m) FILTER (WHERE mode = 'flying') AS fl FROM segments GROUP BY 1),
        pk AS {first('yt', 'distance_m DESC, year')}, mo AS {first('(SELECT tid, ' + D.month_of_year('start_ts') + ' AS m, round(sum(distance_m), 2) AS d FROM segments GROUP BY ALL)', 'd DESC, m')},
        bd AS {first('(SELECT tid, ' + DAY('start_ts') + ' AS day, count(*) AS n FROM visits GROUP BY ALL)', 'n DESC, day')}, mv AS ({most_visited('true')}), lt AS {first('trips', 'end_ts - start_ts DESC, start_ts, id')},
        oo AS (SELECT *, lead(start_ts) OVER (PARTITION BY tid ORDER BY start_ts, id) AS nx FROM trips), gp AS (SELECT tid, max(floor((nx - end_ts) / 86400.0)) AS g FROM oo GROUP BY 1), cc AS (SELECT tid, count(DISTINCT country_code) AS n FROM places GROUP BY 1),
        nc AS {first(f'(SELECT tid, country_code, min(start_ts) AS t FROM {PV} WHERE country_code IS NOT NULL GROUP BY ALL)', 't DESC, country_code')},
        ca AS {first(f"(SELECT tid, category, sum(greatest(end_ts - start_ts, 0)) AS s FROM {PV} WHERE category NOT IN ('Home', 'Streets and roads', 'Other places') GROUP BY ALL)", 's DESC, category')},
        tr AS (SELECT tid, count(*) AS n, round_even(sum({CEILD.format('end_ts - start_ts')})::DOUBLE / count(*), 1) AS av FROM trips GROUP BY 1)
        SELECT tid, 'circumference' AS story, round(d, 2) AS number_, NULL::VARCHAR AS label FROM sg WHERE d > 0 UNION ALL SELECT tid, 'most_visited', n_visits, name FROM mv UNION ALL SELECT tid, 'longest_trip', round_even((end_ts - start_ts) / 86400.0, 0), id::VARCHAR FROM lt UNION ALL SELECT tid, 'busiest_day', n, day FROM bd
        UNION ALL SELECT tid, 'peak_year', distance_m, year::VARCHAR FROM pk WHERE distance_m > 0 UNION ALL SELECT tid, 'peak_month', m, NULL FROM mo WHERE d > 0 UNION ALL SELECT tid, 'longest_gap', g, NULL FROM gp WHERE g > 0 UNION ALL SELECT tid, 'country_count', n, round_even(n * 100.0::DOUBLE / {WORLD_COUNTRIES}, 0)::INT::VARCHAR FROM cc WHERE n > 0
        UNION ALL SELECT tid, 'newest_country', {YEAR('t')}, country_code FROM nc UNION ALL SELECT tid, 'top_category', s, category FROM ca WHERE s > 0 UNION ALL SELECT tid, 'moon_trips', round(fl, 2), NULL FROM sg WHERE fl > {MOON_DISTANCE} UNION ALL SELECT tid, 'trip_frequency', n, printf('%.1f', av) FROM tr WHERE av > 0""",
    "tracking_status": f"""WITH n AS (SELECT max(tst) AS now FROM pings) SELECT p.tid, arg_max(p.id, (p.tst, p.id)) AS id, max(p.tst) AS tst, list(p.acc ORDER BY p.tst DESC, p.id DESC)[1] AS acc, arg_max(p.source, (p.tst, p.id)) AS source, count(*) FILTER (WHERE p.tst >= now - 3600) AS last_hour, count(*) FILTER (WHERE p.tst >= now - 86400) AS last_day, count(*) AS n_points,
        any_value(now) - max(p.tst) AS age_s, CASE WHEN any_value(now) - max(p.tst) > 14400 THEN 'error' WHEN any_value(now) - max(p.tst) > 3600 THEN 'warn' ELSE 'ok' END AS level FROM pings p, n GROUP BY 1""",
    "diagnostics_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("visits", "segments", "trips", "places", "pings")),
    "ping_days": f"SELECT tid, {DAY('tst')} AS day, count(*) AS n_pings, min(tst) AS first_ts, max(tst) AS last_ts FROM pings WHERE coalesce(acc, 0) <= 100 GROUP BY 1, 2",
}
