"""Continuous ingest: pings arrive as files, each micro-batch is appended and the touched parts of its devices are derived again.

Late pings are never dropped: derivation is a recomputation of what they touch, so there is no watermark on that path.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.stays import merged
from ..sources.importers import PING, pings_of
from .pinglog import PingLog


def ping_stream(spark: SparkSession, path: str) -> DataFrame:
    return pings_of(spark.readStream.schema(PING).json(path))


def append_pings(stream: DataFrame, out: str, checkpoint: str):
    """Appends to a Parquet log, partitioned by source, exactly once; ends when all there is has been read."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("source").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def derive_on_arrival(stream: DataFrame, log: str, out: str, checkpoint: str, dedupe: bool = False):
    """Each micro-batch goes to the ping log, then the islands that its pings touch are derived again (see pinglog.PingLog). dedupe: pings that the
    log holds already (same device, time and place) are left out; late ones never are."""
    pings = PingLog(stream.sparkSession, log, out)

    def step(batch: DataFrame, number: int) -> None:
        pings.append(batch, number, dedupe)
        pings.derive(number)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_stays(spark: SparkSession, out: str) -> DataFrame:
    """The visits of all devices: their current stays, with neighbouring ones merged."""
    return merged(PingLog(spark, "", out).stays())


def counts_by_hour(spark: SparkSession, folder: str, pattern: str, schema, out: str, checkpoint: str) -> DataFrame:
    """Events an hour, counted by a stream in complete mode over the files that are there; each micro-batch writes its totals as files."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    counted = rows.groupBy(F.expr("CAST(floor(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 3600) AS BIGINT)").alias("hour")).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


class RunLog(StreamingQueryListener):
    """Writes a row for each micro-batch and each end of a stream to a table: name, run_id, batch, ended_at (unix seconds), n_rows, seconds, ok, error."""

    SCHEMA = "name string, run_id string, batch long, ended_at long, n_rows long, seconds double, ok boolean, error string"

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path, self.names = spark, path, {}

    def _write(self, run: str, batch: int | None, n_rows: int | None, seconds: float | None, error: str | None) -> None:
        row = (self.names.get(run), run, batch, int(time.time()), n_rows, seconds, error is None, error)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write(str(p.runId), p.batchId, p.numInputRows, p.batchDuration / 1000, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write(str(event.runId), None, None, None, event.exception)

    def runs(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)


def last_run(runs: DataFrame) -> DataFrame:
    """The latest row of a run log: ok, error, ended_at. A failure and a batch of the same second: the failure."""
    return runs.orderBy(F.desc("ended_at"), "ok", F.desc("batch")).limit(1).select("ok", "error", "ended_at")
