"""The ping log and the stays derived from it, both partitioned, and brought up to date where new pings touch them.

Pings lie by day and bucket of devices (a folder for each device would be too many), in a folder for each batch, so that a batch that runs
again overwrites its own part. Stays and island starts lie by bucket and month. An island is a stretch of a track without a hop that no stay
can span. A ping between two island starts can change the island it falls into and the one after it, which it may join to the first; so
a batch's zones reach from the last island start before a ping to the second one after it. The days of the zones are all that is read of the
log, their months all that is rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..operators.rederive import END, in_zones
from ..operators.sequence import asof
from ..operators.stays import clustered_islands, ping_islands, trusted
from ..storage import keeper

DAY, MONTH = 86_400, 30 * 86_400
STAYS = "tid long, start_ts long, end_ts long, lat double, lon double, point_count int, bucket int, month int"
#: Starts of islands before which nothing stands in the same second, and the last ping of the zone that they were found in (islands that share their first second are in no row).
ISLANDS = "tid long, at long, end_ts long, bucket int, month int"


class PingLog:
    """log: the folder of pings; state: the folder of stays and islands. Pings have tid, id, tst, lat, lon, acc and source; (tst, id) orders a device's."""

    def __init__(self, spark: SparkSession, log: str, state: str, buckets: int = 64):
        self.spark, self.log, self.state, self.buckets = spark, log, state, buckets
        self.keep = keeper(spark, "pinglog")

    def _bucket(self):
        return F.pmod(F.xxhash64("tid"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _there(self, path: str):
        name = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = name.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return files, name, files.exists(name)

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self.state}/{table}"
        return self.spark.read.schema(schema).parquet(path) if self._there(path)[2] else self.spark.createDataFrame([], schema)

    def stays(self) -> DataFrame:
        """The current stays of all devices."""
        return self._read("stays", STAYS).drop("bucket", "month")

    def days(self, days: list[int], buckets: list[int]) -> DataFrame:
        """The pings of some days and buckets: only their folders are read."""
        return self.spark.read.parquet(self.log).where(F.col("day").isin(days) & F.col("bucket").isin(buckets))

    def append(self, batch: DataFrame, number: int, dedupe: bool = False) -> None:
        """Writes a batch by day and bucket. dedupe: without what the log holds already (same device, time and place), whenever that came."""
        rows = batch.withColumns({"day": F.floor(F.col("tst") / DAY).cast("int"), "bucket": self._bucket()})
        if dedupe:
            same = ["tid", "tst", "lat", "lon"]
            rows = self.keep(rows.dropDuplicates(same))
            if self._there(self.log)[2]:
                at = [(r["day"], r["bucket"]) for r in rows.select("day", "bucket").distinct().collect()]
                known = self.days(sorted({d for d, _ in at}), sorted({b for _, b in at})).where(F.col("batch") < number)
                rows = rows.join(known.select(*same), same, "left_anti")
        rows.withColumn("batch", F.lit(number)).repartition("day", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "bucket", "batch").parquet(self.log)

    def zones(self, new: DataFrame, marks: DataFrame) -> DataFrame:
        """tid, lo, hi (not included): from the last mark (tid, at, end_ts) before each new ping (tid, tst) to the second one after it; zones that meet are one."""
        at = marks.select("tid", "at")
        rows = new.select("tid", "tst", (F.col("tst") - 1).alias("__before"), (F.col("tst") + 1).alias("__after")).distinct()
        rows = asof(self.keep(rows), at, "__before", "at", [], ["tid"]).withColumnRenamed("asof", "__low")
        rows = asof(rows, at, "__after", "at", [], ["tid"], forward=True).withColumn("__next", F.col("asof.at") + 1).drop("asof")
        rows = asof(self.keep(rows), at, "__next", "at", [], ["tid"], forward=True)
        last = marks.groupBy("tid").agg(F.max("end_ts").alias("__last"))
        newest = new.groupBy("tid").agg(F.max("tst").alias("__newest"))
        rows = rows.join(last, "tid", "left").join(newest, "tid")
        end = F.greatest("__last", "__newest") + 1
        spans = self.keep(rows.select("tid", F.coalesce("__low.at", "tst").alias("lo"), F.coalesce("asof.at", end).alias("hi")).distinct())
        spans = scan.running(spans, ["tid"], "lo", ["hi"], {"__upto": ("max_before", F.col("hi"))})
        spans = scan.islands(spans, ["tid"], "lo", ["hi"], {}, F.col("lo") > F.coalesce("__upto", F.lit(-END)), "zone")
        return spans.groupBy("tid", "zone").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("zone")

    def derive(self, number: int) -> None:
        """Brings stays and islands up to date with a batch of the log."""
        new = self.keep(trusted(self.spark.read.parquet(self.log).where(F.col("batch") == number)).select("tid", "tst", "bucket"))
        buckets = [r[0] for r in new.select("bucket").distinct().collect()]
        if not buckets:
            return
        mine = new.select("tid").distinct()
        marks = self.keep(self._read("islands", ISLANDS).where(F.col("bucket").isin(buckets)).join(mine, "tid", "left_semi"))
        spans = self.keep(self.zones(new.drop("bucket"), marks))
        each = lambda width: F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
        days = [r[0] for r in spans.select(each(DAY)).distinct().collect()]
        touched = [(r["bucket"], r["month"]) for r in spans.select(self._bucket(), each(MONTH).alias("month")).distinct().collect()]

        pings = trusted(self.days(days, buckets)).join(mine, "tid", "left_semi").select("tid", "id", "tst", "lat", "lon")
        again = in_zones(pings, "tst", spans, closed=False).where("zone is not null")
        cut = self.keep(ping_islands(self.keep(again), ("tid", "zone")))
        found = clustered_islands(cut, ("tid", "zone"))
        ends = cut.groupBy("tid", "zone").agg(F.max("tst").alias("end_ts"))
        starts = cut.groupBy("tid", "zone", "island").agg(F.min("tst").alias("at"), F.min_by("was", F.struct("tst", "id")).alias("was"))
        starts = starts.where("was is null or was.tst is null or was.tst < at").join(ends, ["tid", "zone"]).select("tid", "at", "end_ts")
        self._replace("islands", ISLANDS, starts, "at", spans, touched)
        self._replace("stays", STAYS, found, "start_ts", spans, touched)

    def _replace(self, table: str, schema: str, fresh: DataFrame, ts: str, spans: DataFrame, touched: list[tuple[int, int]]) -> None:
        """Writes the touched partitions anew: their old rows outside the zones, and the fresh ones."""
        here = F.col("bucket").isin(sorted({b for b, _ in touched})) & F.col("month").isin(sorted({m for _, m in touched}))
        placed = fresh.withColumns({"bucket": self._bucket(), "month": F.floor(F.col(ts) / MONTH).cast("int")})
        old = in_zones(self._read(table, schema).where(here), ts, spans, closed=False).where("zone is null").drop("zone")
        rows = self.keep(old.select(*placed.columns).unionByName(placed))
        rows.repartition("bucket", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "month").parquet(f"{self.state}/{table}")
        full = {(r["bucket"], r["month"]) for r in rows.select("bucket", "month").distinct().collect()}
        for bucket, month in set(touched) - full:  # nothing is left there, so nothing has overwritten it
            files, name, there = self._there(f"{self.state}/{table}/bucket={bucket}/month={month}")
            if there:
                files.delete(name, True)
