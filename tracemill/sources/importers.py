"""Importers: exports of phones and services as DataFrames of pings, visits and segments. Malformed entries are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import STATIONARY_RADIUS
from ..functions.categories import mode_of_activity
from ..functions.geo import metres
from ..functions.text import dates_of_folder, lat_lon, trip_name, unix_of_iso, without_parentheses

PING = "_type string, tid string, lat double, lon double, alt double, acc double, vel double, batt double, tst long"
TIMELINE = "semanticSegments array<struct<startTime:string,endTime:string,visit:struct<topCandidate:struct<placeId:string,placeLocation:struct<latLng:string>>>,activity:struct<distanceMeters:double,topCandidate:struct<type:string>>,timelinePath:array<struct<point:string>>>>"
SIGNALS = "rawSignals array<struct<position:struct<LatLng:string,timestamp:string,altitudeMeters:double,accuracyMeters:double,speedMetersPerSecond:double>>>"
SIDECAR = "photoTakenTime struct<timestamp:string>, geoData struct<latitude:double,longitude:double>, geoDataExif struct<latitude:double,longitude:double>"


def pings_of(messages: DataFrame) -> DataFrame:
    """Location messages of a phone (PING, batch or stream) as pings; other messages and those without place or time go."""
    ok = (F.col("_type") == "location") & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("tst").isNotNull()
    return messages.where(ok).select(F.coalesce(F.substring("tid", 1, 8), F.lit("??")).alias("tid"), "lat", "lon", "alt", "acc", "vel", "batt", "tst", F.lit("owntracks").alias("source"))


def timeline(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """Entries of a timeline export with start_ts and end_ts, from `since` on."""
    rows = spark.read.schema(TIMELINE).option("multiLine", True).json(path).select(F.explode("semanticSegments").alias("s")).select("s.*")
    rows = rows.withColumns({"start_ts": unix_of_iso(F.col("startTime")), "end_ts": unix_of_iso(F.col("endTime"))}).where("start_ts is not null and end_ts is not null")
    return rows if since is None else rows.where(F.col("start_ts") >= since)


def timeline_visits(entries: DataFrame) -> DataFrame:
    at = lat_lon(F.col("visit.topCandidate.placeLocation.latLng"))
    rows = entries.where("visit is not null").select("start_ts", "end_ts", at.alias("at"), F.col("visit.topCandidate.placeId").alias("place_key"))
    return rows.where("at.lat is not null and at.lon is not null").select("start_ts", "end_ts", "at.lat", "at.lon", F.lit(1).alias("point_count"), F.lit("google_import").alias("source"), "place_key")


def timeline_segments(entries: DataFrame) -> DataFrame:
    rows = entries.where("visit is null and activity is not null").select("start_ts", "end_ts", mode_of_activity(F.col("activity.topCandidate.type")).alias("mode"), F.coalesce("activity.distanceMeters", F.lit(0.0)).alias("distance_m"))
    return rows.where("mode is not null and end_ts > start_ts").withColumn("duration_s", (F.col("end_ts") - F.col("start_ts")).cast("double")).withColumn("source", F.lit("google_import"))


def stationary_paths(entries: DataFrame) -> DataFrame:
    """Paths whose points all lie near their mean, as visits."""
    points = F.filter(F.transform("timelinePath", lambda p: lat_lon(p["point"])), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    rows = entries.where("timelinePath is not null").select("start_ts", "end_ts", points.alias("p")).where((F.size("p") > 0) & (F.col("end_ts") > F.col("start_ts")))
    mean = lambda part: F.aggregate("p", F.lit(0.0), lambda a, x: a + x[part]) / F.size("p")
    rows = rows.withColumns({"lat": mean("lat"), "lon": mean("lon")})
    spread = F.array_max(F.transform("p", lambda x: metres(F.col("lat"), F.col("lon"), x["lat"], x["lon"])))
    return rows.where(spread < STATIONARY_RADIUS).select("start_ts", "end_ts", "lat", "lon", F.size("p").alias("point_count"), F.lit("google_import").alias("source"))


def raw_signals(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SIGNALS).option("multiLine", True).json(path).select(F.explode("rawSignals.position").alias("p")).where("p is not null")
    rows = rows.select(lat_lon(F.col("p.LatLng")).alias("at"), unix_of_iso(F.col("p.timestamp")).alias("tst"), F.col("p.altitudeMeters").alias("alt"), F.col("p.accuracyMeters").alias("acc"), F.col("p.speedMetersPerSecond").alias("vel"))
    return rows.where("at.lat is not null and at.lon is not null and tst is not null").select(F.lit("goog").alias("tid"), "at.lat", "at.lon", "alt", "acc", "vel", F.lit(None).cast("double").alias("batt"), "tst", F.lit("google_raw").alias("source"))


def photos(spark: SparkSession, path: str) -> DataFrame:
    """Photo sidecar files as uid (file), taken_ts, lat, lon; (0, 0) and missing places are null."""
    place = lambda g, part: F.when(~((F.col(f"{g}.latitude") == 0) & (F.col(f"{g}.longitude") == 0)), F.col(f"{g}.{part}"))
    rows = spark.read.schema(SIDECAR).option("multiLine", True).json(path).withColumn("uid", F.input_file_name())
    taken = F.col("photoTakenTime.timestamp").try_cast("long")
    return rows.select("uid", taken.alias("taken_ts"), F.coalesce(place("geoData", "latitude"), place("geoDataExif", "latitude")).alias("lat"), F.coalesce(place("geoData", "longitude"), place("geoDataExif", "longitude")).alias("lon")).where("taken_ts is not null")


def planned_stops(spark: SparkSession, path: str) -> DataFrame:
    """Folders of a KML file as planned trips: folder, position (from 0, of the stops with a point), name, lat, lon, day; missing days come from the
    nearest dated stop, the one before first. Folders without a dated stop, or with one stop only, are left out."""
    schema = "name string, Placemark array<struct<name:string,description:string,Point:struct<coordinates:string>>>"
    rows = spark.read.format("xml").option("rowTag", "Folder").schema(schema).load(path).select(F.col("name").alias("folder"), F.posexplode(F.filter("Placemark", lambda p: p["Point"].isNotNull())).alias("position", "p"))
    parts = F.split(F.btrim("p.Point.coordinates"), ",")
    day = F.to_date(F.nullif(F.regexp_extract("p.description", r"(\d{2}[A-Z][a-z]{2}\d{4})", 1), F.lit("")), "ddMMMyyyy")
    rows = rows.select("folder", "position", F.col("p.name").alias("name"), F.get(parts, F.lit(1)).try_cast("double").alias("lat"), F.get(parts, F.lit(0)).try_cast("double").alias("lon"), day.alias("dated"))
    w = Window.partitionBy("folder").orderBy("position")
    before = F.last("dated", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("dated", ignorenulls=True).over(Window.partitionBy("folder").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("day", F.coalesce(before, after)).where("day is not null").drop("dated")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("folder"))).where("n >= 2").drop("n")


def planned_trips(stops: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Planned stops (tid, folder and more, see planned_stops) as visits, segments and trips, for folders whose days meet no visit (tid, start_ts,
    end_ts) of the person; any overlap refuses the whole folder.

    A stop is a visit of a minute, so many seconds into its day as its position says. Legs lead from stop to stop, those under a kilometre
    are left out. A trip goes from its first stop to its last, is named after its folder, and has the place of the stop farthest from the first."""
    of = ["tid", "folder"]
    at = (F.unix_date("day").cast("long") * 86400 + F.col("position")).alias("start_ts")
    spans = stops.groupBy(*of).agg((F.min(F.unix_date("day")).cast("long") * 86400).alias("start_ts"), ((F.max(F.unix_date("day")).cast("long") + 1) * 86400).alias("end_ts"))
    free = not_overlapping(spans, visits).select(*of)
    stays = stops.join(free, of, "left_semi").select(*of, "position", "name", "lat", "lon", at).withColumn("end_ts", F.col("start_ts") + 60)
    w = Window.partitionBy(*of).orderBy("start_ts", "position")
    ends = {c: F.lead(c).over(w) for c in ("name", "lat", "lon", "start_ts")}
    legs = stays.withColumns({f"to_{c}": v for c, v in ends.items()}).where("to_start_ts is not null")
    far = metres("lat", "lon", "to_lat", "to_lon")
    legs = legs.withColumn("distance_m", far).where("distance_m >= 1000").select(
        *of, "start_ts", F.col("to_start_ts").alias("end_ts"), planned_mode(F.col("name"), F.col("to_name"), F.col("distance_m")).alias("mode"), "distance_m",
        F.greatest(F.col("to_start_ts") - F.col("start_ts"), F.lit(1)).cast("double").alias("duration_s"), F.lit("kml_import").alias("source"))
    first = stays.withColumns({"lat0": F.first("lat").over(w), "lon0": F.first("lon").over(w)}).withColumn("far", metres("lat0", "lon0", "lat", "lon"))
    order = F.struct("start_ts", "position")
    trips = first.groupBy(*of).agg(F.min("start_ts").alias("start_ts"), F.max_by("end_ts", order).alias("end_ts"), F.max_by(F.struct("lat", "lon", F.col("name").alias("far_name")), F.struct("far", -F.col("start_ts"))).alias("f"))
    trips = trips.select("tid", "folder", "start_ts", "end_ts", trip_name(F.col("folder")).alias("name"), "f.far_name", F.col("f.lat").alias("far_lat"), F.col("f.lon").alias("far_lon"), F.lit("kml_import").alias("source"))
    return stays.select("tid", "folder", "start_ts", "end_ts", "lat", "lon", F.lit(1).alias("point_count"), F.lit("kml_import").alias("source")), legs, trips


def confirmed_photo_trips(found: DataFrame, trips: DataFrame) -> DataFrame:
    """Visits of trips known from photos only (found: tid, first_day, last_day as dates, lat, lon): from the first day's start to the last second of
    the last day. Those that overlap any trip (tid, start_ts, end_ts) of the person are left out."""
    spans = found.select("tid", (F.unix_date("first_day").cast("long") * 86400).alias("start_ts"), (F.unix_date("last_day").cast("long") * 86400 + 86_399).alias("end_ts"), "lat", "lon")
    return not_overlapping(spans, trips).withColumns({"point_count": F.lit(1), "source": F.lit("photo_import")})


def planned_mode(name_a: Column, name_b: Column, distance_m: Column) -> Column:
    """Flying between airports or over 300 km, else driving."""
    air = r"(?i)\b(airport|aeropuerto|aéroport|flughafen)\b"
    return F.when(F.coalesce(name_a, F.lit("")).rlike(air) | F.coalesce(name_b, F.lit("")).rlike(air) | (distance_m > 300_000), "flying").otherwise("driving")


def not_overlapping(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (tid, start_ts, end_ts) that no existing interval of the tid overlaps; matched through the day bins both touch."""
    on, days = ["tid", "start_ts", "end_ts"], lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 86400), F.floor(F.greatest(F.col(a), F.col(b)) / 86400)))
    left = candidates.select(*on).distinct().withColumn("__day", days("start_ts", "end_ts"))
    right = existing.select("tid", F.col("start_ts").alias("__s"), F.col("end_ts").alias("__e")).withColumn("__day", days("__s", "__e"))
    hit = left.join(right, ["tid", "__day"]).where("__s < end_ts and __e > start_ts").select(*on).distinct()
    return candidates.join(hit, on, "left_anti").select(*candidates.columns)


def new_places(seeds: DataFrame, places: DataFrame) -> DataFrame:
    """places with the seeds added whose coordinate key isn't there yet."""
    return places.unionByName(seeds.dropDuplicates(["lat_round", "lon_round"]).join(places, ["lat_round", "lon_round"], "left_anti").select(*places.columns))


def folders_to_review(folders: DataFrame, photos: DataFrame, found: DataFrame, generic: tuple = ("Other places", "Streets and roads")) -> DataFrame:
    """Dated folders (folder) without a photo (folder, lat) that has a place: folder, first, last, query, verdict.

    found: query, category, the first answer to each folder's cleaned name. The verdict is confident, uncertain (a generic category) or none."""
    rows = folders.select("folder", dates_of_folder(F.col("folder")).alias("d"), without_parentheses(F.col("folder")).alias("query")).where("d.first is not null").distinct()
    rows = rows.join(photos.where("lat is not null").select("folder").distinct(), "folder", "left_anti").join(found.dropDuplicates(["query"]).select("query", "category", F.lit(True).alias("hit")), "query", "left")
    sure = F.when(F.col("hit").isNull(), "none").when(F.coalesce(F.col("category").isin(*generic), F.lit(True)), "uncertain").otherwise("confident")
    return rows.select("folder", "d.first", "d.last", "query", sure.alias("verdict"))


def replaced(table: DataFrame, rows: DataFrame, source: str) -> DataFrame:
    """table with all rows of the source replaced by the given ones."""
    return table.where(~F.col("source").eqNullSafe(F.lit(source))).unionByName(rows, allowMissingColumns=True)


def made_up(stays: DataFrame, moves: DataFrame) -> DataFrame:
    """Pings of a plan, for demonstrations: stays (tid, lat, lon, start_ts, duration_s) every ten minutes, a few metres apart, and straight
    moves (tid, lat, lon, lat2, lon2, start_ts, duration_s, n) in n steps. Returns tid, lat, lon, tst."""
    at = stays.select("tid", "lat", "lon", "start_ts", F.explode(F.sequence(F.lit(0), F.col("duration_s").cast("int"), F.lit(600))).alias("t"))
    rest = at.select("tid", (F.col("lat") + F.col("t") % 3 * 0.00003).alias("lat"), "lon", (F.col("start_ts") + F.col("t")).cast("long").alias("tst"))
    step = moves.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int")))).withColumn("share", F.col("i") / F.col("n"))
    along = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("share")
    moved = step.select("tid", along("lat", "lat2").alias("lat"), along("lon", "lon2").alias("lon"), F.floor(F.col("start_ts") + F.col("duration_s") * F.col("share")).alias("tst"))
    return rest.unionByName(moved)
