"""Edits as overlay tables: the derived tables are never changed in place, edits are joined in and survive a rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(edits: DataFrame, keys: list[str]) -> DataFrame:
    """The last edit (by edited_at) of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col("edited_at").desc())
    return edits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "edited_at")


def patched(table: DataFrame, edits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """table with the edits' non-null columns in place (mode, render_mode, names ...)."""
    e = latest(edits, keys).select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    out = table.join(e, keys, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def without(table: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(tombstones.select(*keys).distinct(), keys, "left_anti").select(*table.columns)


def without_phantoms(visits: DataFrame) -> DataFrame:
    """Without imported visits of exactly two hours that start and end on the hour: they were never there."""
    phantom = (F.col("source") == "google_import") & (F.col("end_ts") - F.col("start_ts") == 7200) & (F.col("start_ts") % 3600 == 0) & (F.col("end_ts") % 3600 == 0)
    return visits.where(~phantom)


def repointed(visits: DataFrame, alias: DataFrame) -> DataFrame:
    """visits whose place was merged into another (alias: old_id, new_id) point to that one."""
    a = alias.select(F.col("old_id").alias("place_id"), F.col("new_id").alias("__new"))
    return visits.join(a, "place_id", "left").withColumn("place_id", F.coalesce("__new", "place_id")).select(*visits.columns)


def final_aliases(alias: DataFrame, stored) -> DataFrame:
    """old_id, new_id with each merged place's last keeper: chains of merges (old_id, new_id, in any order) are followed to their end.

    Pointers double in each round, so a chain of n merges takes log n of them. Of several merges of one place, the one into the smallest id counts.
    Places that were merged in a circle are kept by the smallest id of the circle, which isn't merged itself; merges into oneself are none."""
    one = alias.where("old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    at = stored(one.withColumn("least", F.col("old_id")))  # the smallest id from old_id up to before new_id
    known, reach = at.count(), 1
    while True:
        step = at.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("__next"), F.col("least").alias("__least")).hint("merge")  # ids compress so well that millions of them pass for a small table, and would go through the driver
        met = at.join(step, "new_id", "left")
        if reach > known or met.where("__next is not null").isEmpty():
            break
        at, reach = stored(met.select("old_id", F.coalesce("__next", "new_id").alias("new_id"), F.least("least", "__least").alias("least"))), 2 * reach
    # what still goes on after so many steps ends in a circle, whose smallest id is that seen from there
    return met.select("old_id", F.coalesce("__least", "new_id").alias("new_id")).where("old_id <> new_id")


def merged_places(places: DataFrame, visits: DataFrame, alias: DataFrame, stored) -> tuple[DataFrame, DataFrame]:
    """Places without those merged into others, and visits that point to their last keepers."""
    last = stored(final_aliases(alias, stored)).hint("merge")
    return without(places, last.select(F.col("old_id").alias("id")), ["id"]), repointed(visits, last)


def merged_into_previous(visits: DataFrame, segments: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The visits of `ids` are merged into the ones before them; segments inside a merged span go. visits: tid, id, start_ts, end_ts."""
    w = Window.partitionBy("tid").orderBy("start_ts", "id")
    marked = visits.join(ids.select("id", F.lit(1).alias("__m")), "id", "left").withColumn("__g", F.sum(F.when(F.col("__m").isNull(), 1).otherwise(0)).over(w))
    first = marked.groupBy("tid", "__g").agg(F.min(F.struct("start_ts", "id")).alias("f"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n"))
    heads = first.select(F.col("f.id").alias("id"), F.col("end_ts").alias("__end"), "n")
    out = visits.join(heads, "id").withColumn("end_ts", F.col("__end"))
    spans = out.where("n > 1").select("tid", F.col("start_ts").alias("__s"), F.col("end_ts").alias("__e"))
    inside = (F.col("start_ts") >= F.col("__s")) & (F.col("end_ts") <= F.col("__e"))
    return out.select(*visits.columns), _apart_from(segments, spans, inside)


def _apart_from(rows: DataFrame, spans: DataFrame, meets: Column) -> DataFrame:
    """rows (tid, start_ts, end_ts) without those that meet one of the spans (tid, __s, __e) they overlap; matched through day bins."""
    days = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 86400), F.floor(F.greatest(F.col(a), F.col(b)) / 86400)))
    dated = rows.select("tid", "start_ts", "end_ts").distinct().withColumn("__day", days("start_ts", "end_ts"))
    hit = dated.join(spans.withColumn("__day", days("__s", "__e")), ["tid", "__day"]).where(meets).select("tid", "start_ts", "end_ts").distinct()
    return rows.join(hit, ["tid", "start_ts", "end_ts"], "left_anti").select(*rows.columns)


def manual_visit(visits: DataFrame, segments: DataFrame, visit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Puts in visits by hand (some rows): tracked and manual rows of the tid that they overlap go; over imported ones they are refused (not added)."""
    v = visit.select("tid", F.col("start_ts").alias("__s"), F.col("end_ts").alias("__e"))
    over = (F.col("start_ts") < F.col("__e")) & (F.col("end_ts") > F.col("__s"))
    imported = visits.where(~F.col("source").isin("owntracks", "manual")).select("tid", F.col("start_ts").alias("__s"), F.col("end_ts").alias("__e"))
    added = _apart_from(visit, imported, over)
    allowed = v.join(added.select("tid", F.col("start_ts").alias("__s"), F.col("end_ts").alias("__e")).distinct(), ["tid", "__s", "__e"], "left_semi")
    own = F.col("source").isin("owntracks", "manual")
    keep = _apart_from(visits.where(own), allowed, over).unionByName(visits.where(~own))
    tracked = F.col("source") == "owntracks"
    return keep.unionByName(added, allowMissingColumns=True), _apart_from(segments.where(tracked), allowed, over).unionByName(segments.where(~tracked))


def converted_to_visits(visits: DataFrame, segments: DataFrame, stops: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Segments that were stops (stops: the segments' keys, id, lat, lon, place_id) become visits of the segment's time and source; the segments go."""
    made = segments.join(stops, keys).select("tid", "id", "start_ts", "end_ts", "lat", "lon", F.lit(0).alias("point_count"), "source", "place_id")
    return visits.unionByName(made, allowMissingColumns=True), without(segments, stops, keys)


def renamed(places: DataFrame, answers: DataFrame) -> DataFrame:
    """English names (answers: id, name, city): where they differ from a place's own, the old ones move to name_local and city_local."""
    a = answers.select("id", F.col("name").alias("__name"), F.col("city").alias("__city"))
    out = places.join(a, "id", "left")
    for c in ("name", "city"):
        new = F.col(f"__{c}").isNotNull() & F.col(c).isNotNull() & (F.col(f"__{c}") != F.col(c))
        out = out.withColumn(f"{c}_local", F.when(new, F.col(c)).otherwise(F.col(f"{c}_local"))).withColumn(c, F.when(new, F.col(f"__{c}")).otherwise(F.col(c)))
    return out.select(*places.columns)


def vendor_named(places: DataFrame, details: DataFrame, generic: tuple = ("Other places", "Streets and roads")) -> DataFrame:
    """A vendor's names and categories (details: google_place_id, vendor_name, vendor_category) for places of generic categories.

    A name that only repeats the city is not taken; corrected places stay as they are."""
    out = places.join(details, "google_place_id", "left")
    open_ = F.col("category").isin(*generic) & ~F.coalesce("manually_corrected", F.lit(False))
    city = F.lower(F.btrim("vendor_name")) == F.lower(F.btrim("city"))
    name = F.when(open_ & F.col("vendor_name").isNotNull() & ~F.coalesce(city, F.lit(False)), F.col("vendor_name")).otherwise(F.col("name"))
    category = F.when(open_, F.coalesce("vendor_category", "category")).otherwise(F.col("category"))
    return out.withColumns({"name": name, "category": category}).select(*places.columns)


def relabelled(trips: DataFrame, folders: DataFrame) -> DataFrame:
    """Trips take the name of their person's first folder (tid, folder, first_day, last_day as dates) of exactly their first and last day."""
    day = lambda c: F.date_from_unix_date(F.floor(F.col(c) / 86400).cast("int"))
    on = ["tid", "first_day", "last_day"]
    named = folders.groupBy(*on).agg(F.min("folder").alias("__folder"))
    out = trips.withColumns({"first_day": day("start_ts"), "last_day": day("end_ts")}).join(named, on, "left")
    return out.withColumn("name", F.coalesce("__folder", "name")).select(*trips.columns)


def carried_over(trips: DataFrame, corrected: DataFrame) -> DataFrame:
    """Fresh trips take the names of their person's corrected ones with the same start and end; of several (id), those of the greatest id."""
    names, on = ("name", "primary_city", "primary_country", "primary_country_code"), ["tid", "start_ts", "end_ts"]
    c = corrected.where("manually_corrected").groupBy(*on).agg(F.max_by(F.struct(*names), "id").alias("__c"))
    out = trips.join(c, on, "left")
    kept = lambda x: F.when(F.col("__c").isNotNull(), F.col(f"__c.{x}")).otherwise(F.col(x)).alias(x) if x in names else F.col(x)
    return out.select(*[kept(x) for x in trips.columns if x != "manually_corrected"], F.col("__c").isNotNull().alias("manually_corrected"))
