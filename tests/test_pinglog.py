"""The partitioned ping log: batches in any order give what one batch gives; only the touched days are read; failures are logged."""

import random

from pyspark.sql import functions as F

from tracemill.operators import stays
from tracemill.plans import reports
from tracemill.streaming import ingest
from tracemill.streaming.pinglog import PingLog

PINGS = "tid long, id long, tst long, lat double, lon double, acc double, source string"


def track(rng, tid, days, at=0):
    """Stays of some hours at spots far apart, with hops, pauses and equal seconds between."""
    out, t = [], at
    while t < at + days * 86_400:
        lat = 50 + rng.randrange(40) * 0.01
        for _ in range(rng.choice([1, 2, 12, 30])):
            out.append((tid, len(out) + tid * 1_000_000, t, lat + rng.random() * 1e-3, 0.0, rng.choice([None, 10.0, 10.0, 500.0]), "owntracks"))
            t += rng.choice([0, 120, 300, 300, 4000])
        t += rng.choice([300, 20_000])
    return out


def key(df):
    return sorted((r["tid"], r["start_ts"], r["end_ts"], r["point_count"]) for r in df.collect())


def test_batches_in_any_order_equal_one(spark, tmp_path):
    """Late pings far back, in the middle of islands and between them (README.md:8-11, app/processing.py:153-184)."""
    rng = random.Random(8)
    rows = track(rng, 1, 9) + track(rng, 2, 4, 86_400 * 40)
    parts = [[], [], []]
    for i in range(0, len(rows), 7):
        parts[rng.choice([0, 0, 1, 2])].extend(rows[i : i + 7])
    log = PingLog(spark, str(tmp_path / "log"), str(tmp_path / "state"), buckets=2)
    for n, part in enumerate(parts):
        log.append(spark.createDataFrame(part, PINGS), n)
        log.derive(n)
        seen = spark.createDataFrame([r for p in parts[: n + 1] for r in p], PINGS)
        assert key(log.stays()) == key(stays.stays(seen)) != []
    log.append(spark.createDataFrame(parts[1], PINGS), 1)  # a batch that runs again changes nothing
    log.derive(1)
    assert key(log.stays()) == key(stays.stays(spark.createDataFrame(rows, PINGS)))


def test_only_touched_days_are_read(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    log = PingLog(spark, str(tmp_path / "log"), str(tmp_path / "state"), buckets=1)
    log.append(spark.createDataFrame(track(rng, 1, 12), PINGS), 0)
    log.derive(0)
    read, was = [], PingLog.days
    monkeypatch.setattr(PingLog, "days", lambda self, days, buckets: (read.append(days), was(self, days, buckets))[1])
    log.append(spark.createDataFrame([(1, 99, 5 * 86_400 + 40_000, 51.0, 0.0, None, "owntracks")], PINGS), 1)
    log.derive(1)
    assert len(read) == 1 and 5 in read[0] and len(read[0]) <= 3
    files = log.days(read[0], [0]).select(F.input_file_name()).distinct().count()
    assert files <= 4 < spark.read.parquet(str(tmp_path / "log")).select(F.input_file_name()).distinct().count()


def test_copies_are_left_out_on_demand(spark, tmp_path):
    rows = [(1, i, i * 60, 50.0, 0.0, None, "owntracks") for i in range(30)]
    log = PingLog(spark, str(tmp_path / "log"), str(tmp_path / "state"))
    log.append(spark.createDataFrame(rows[10:20], PINGS), 0, dedupe=True)
    log.append(spark.createDataFrame(rows + rows[:5], PINGS), 1, dedupe=True)  # copies of the batch before and within, and late ones
    assert spark.read.parquet(str(tmp_path / "log")).count() == 30
    log.append(spark.createDataFrame(rows[:3], PINGS), 2)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 33


def test_runs_are_logged_and_a_failure_shows(spark, tmp_path):
    """Each batch and each end of a stream is a row; a failed run makes every device an error (app/scheduler.py:18-41)."""
    box = tmp_path / "in"
    spark.createDataFrame([(1,), (2,)], "x long").write.parquet(str(box))
    runs = ingest.RunLog(spark, str(tmp_path / "runs"))
    spark.streams.addListener(runs)
    try:
        rows = spark.readStream.schema("x long").parquet(str(box))
        for name, step in (("good", lambda df, n: df.count()), ("bad", lambda df, n: 1 / 0)):
            query = rows.writeStream.foreachBatch(step).queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except Exception:
                assert name == "bad"
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(runs)
    got = {(r["name"], r["ok"]): r for r in runs.runs().collect()}
    assert got["good", True]["error"] is None and "ZeroDivisionError" in got["bad", False]["error"]
    assert sum(r["n_rows"] or 0 for r in runs.runs().where("name = 'good'").collect()) == 2
    pings = spark.createDataFrame([(1, 1, 1000, 5.0, "owntracks")], "tid long, id long, tst long, acc double, source string")
    assert reports.tracking_status(pings, 1000).first()["level"] == "ok"
    assert reports.tracking_status(pings, 1000, ingest.last_run(runs.runs())).first()["level"] == "error"


def test_zones_that_meet_are_one_across_weeks(spark, tmp_path):
    """A ping's zone of several weeks takes in the zones of later pings that begin inside it."""
    log = PingLog(spark, str(tmp_path / "log"), str(tmp_path / "state"))
    new = spark.createDataFrame([(1, 100), (1, 2_900_000), (1, 9_000_000)], "tid long, tst long")
    marks = spark.createDataFrame([(1, t, t + 10) for t in (0, 2_800_000, 3_000_000, 5_000_000, 8_900_000, 9_100_000, 9_200_000)], "tid long, at long, end_ts long")
    assert sorted(map(tuple, log.zones(new, marks).collect())) == [(1, 0, 5_000_000), (1, 8_900_000, 9_200_000)]


def test_a_last_island_that_shares_its_second_is_derived_again(spark, tmp_path):
    """The hop lies within one second, so the last island has no mark of its own; a late ping before it must not lose it."""
    rows = [(1, i, i * 60, 50.0, 0.0, None, "owntracks") for i in range(11)] + [(1, 100 + i, 600 + i * 60, 51.0, 0.0, None, "owntracks") for i in range(30)]
    late = [(1, 99, 301, 50.0, 0.0, None, "owntracks")]
    log = PingLog(spark, str(tmp_path / "log"), str(tmp_path / "state"), buckets=1)
    for n, part in enumerate((rows, late)):
        log.append(spark.createDataFrame(part, PINGS), n)
        log.derive(n)
    assert key(log.stays()) == key(stays.stays(spark.createDataFrame(rows + late, PINGS))) == [(1, 0, 600, 12), (1, 600, 2340, 30)]
