"""Running values over time bins equal one window over a person's whole history, wherever the bins cut."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.constants import MERGE_GAP
from tracemill.operators import legs, scan, sequence
from tracemill.plans import reports


def rows(spark, seed, n=400, people=2):
    """Few people with long histories, equal times, null values, gaps of many bins."""
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 5, 40, 3000, 9000, 2_000_000])
        out.append((rng.choice([*range(people), None]), i, t, t + rng.randrange(4000), rng.choice([None, 1, 2, 2, 2]), rng.choice(["walking", "bus", "bus", "flying"]), float(i)))
    return spark.createDataFrame(out, "tid long, id long, start_ts long, end_ts long, place_id long, mode string, distance_m double").withColumn("duration_s", F.lit(1.0))


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())) != []


@pytest.mark.parametrize("width", [1, 7, 10_000, 10**9])
@pytest.mark.parametrize("back", [False, True])
def test_running_equals_one_window(spark, width, back):
    df = rows(spark, width)
    v = F.col("place_id")
    df = df.where("tid is not null")
    got = scan.running(df, ["tid"], "start_ts", ["id"], {"l": ("lag", v), "x": ("last", v), "s": ("sum", v), "m": ("max_before", F.col("end_ts"))}, width, back)
    w = Window.partitionBy("tid").orderBy(*[F.col(c).desc() if back else F.col(c) for c in ("start_ts", "id")])
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    assert same(got, df.withColumns({"l": F.lag(v).over(w), "x": F.last(v, True).over(upto), "s": F.sum(v).over(upto), "m": F.max("end_ts").over(before)}))


@pytest.mark.parametrize("width", [3, 5000])
def test_chains_and_runs_across_bins(spark, width, monkeypatch):
    monkeypatch.setattr(scan.islands, "__defaults__", ("island", width))
    monkeypatch.setattr(scan.running, "__defaults__", (width, False))
    df = rows(spark, 3).where("tid is not null")
    w = Window.partitionBy("tid").orderBy("start_ts", "id")
    marked = df.withColumns({"was": F.lag("mode").over(w), "left": F.lag("end_ts").over(w)})
    new = F.col("was").isNull() | (F.col("was") != F.col("mode")) | (F.col("mode") == "flying") | (F.col("start_ts") - F.col("left") > 7200)
    plain = sequence.islands(marked, ["tid"], ["start_ts", "id"], new, "j").groupBy("tid", "j").agg(F.min("start_ts").alias("start_ts"), F.first("mode").alias("mode"), F.sum("distance_m").alias("distance_m"), F.count("*").alias("n_segments"))
    assert same(legs.chained(df, ["id"]).select("tid", "mode", "start_ts", "distance_m", "n_segments"), plain)

    visits, want = sorted(df.collect(), key=lambda r: (r["tid"], r["start_ts"], r["id"])), []
    for r in visits:
        last = want[-1] if want else None
        if last and last[0] == r["tid"] and last[2] == r["place_id"] is not None and r["start_ts"] - last[4] <= MERGE_GAP:
            last[4], last[5] = max(last[4], r["end_ts"]), last[5] + 1
        else:
            want.append([r["tid"], r["id"], r["place_id"], r["start_ts"], r["end_ts"], 1])
    assert sorted(tuple(r) for r in reports.coalesced(df).select("tid", "id", "place_id", "start_ts", "end_ts", "n_visits").collect()) == sorted(map(tuple, want))


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("width", [2, 20_000])
def test_asof_across_bins(spark, forward, width):
    rng = random.Random(width)
    left = [(i, rng.choice([1, 2, 3]), rng.randrange(3000) * 1000) for i in range(60)]
    right = [(i, rng.choice([1, 2]), rng.randrange(300) * 10_000) for i in range(60)]
    l, r = spark.createDataFrame(left, "a long, tid long, at long"), spark.createDataFrame(right, "b long, tid long, ts long")
    got = {x["a"]: x["asof"]["b"] if x["asof"] else None for x in sequence.asof(l, r, "at", "ts", ["b"], ["tid"], forward, ["b"], width).collect()}
    side = (lambda x, t: x >= t) if forward else (lambda x, t: x <= t)
    pick = min if forward else max
    assert got == {a: (pick(((ts, b) for b, k, ts in right if k == tid and side(ts, t)), default=(0, None))[1]) for a, tid, t in left}


def test_no_window_by_person_alone(spark):
    """Plans: every window over visits, segments or trips is dealt by person and bin (or run); by person alone go only the bins' summaries."""
    df = rows(spark, 1).where("tid is not null")
    for out in (legs.chained(df, ["id"]), reports.coalesced(df), reports.streaks(df, df, 0), scan.islands(df, ["tid"], "start_ts", ["id"], {}, F.col("mode") == "bus")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in (x for x in plan.split("\n") if "Window [" in x):
            by, order = line.rsplit("], [", 2)[1:]
            assert "__bin" in by or "__run" in by or "__bin" in order, line


@pytest.mark.parametrize("width", [3, 5000, 10**9])
def test_journeys_are_joined_over_the_borders_of_bins(spark, width):
    """Journeys equal a plain fold, also where a mode is missing (no journey goes on there); rows are not shuffled again by journey."""
    df = rows(spark, 5).where("tid is not null").withColumn("mode", F.when(F.col("id") % 7 > 0, F.col("mode")))
    got, want = legs.chained(df, ["id"], width), []
    for r in sorted(df.collect(), key=lambda r: (r["tid"], r["start_ts"], r["id"])):
        last = want[-1] if want else None
        if last and last[0] == r["tid"] and last[1] == r["mode"] not in (None, "flying") and r["start_ts"] - last[3] <= 7200:
            last[3:] = [r["end_ts"], last[4] + r["distance_m"], last[5] + 1.0, last[6] + 1]
        else:
            want.append([r["tid"], r["mode"], r["start_ts"], r["end_ts"], r["distance_m"], 1.0, 1])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want))) and any(x[6] > 2 for x in want)
    shuffles = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(" in x]
    assert shuffles and not any("journey" in x or "__run" in x.split("hashpartitioning(")[1].split(")")[0] for x in shuffles)


def test_trends_are_read_off_one_window(spark):
    """Months without rows are zeros, a missing mode has no trend (as in SQL), and nothing is copied six times."""
    month = lambda m: 86_400 * 31 * m + 86_400
    df = spark.createDataFrame([(1, "bus", month(m), 1000.0 * (m + 1), 1.0) for m in (0, 1, 5, 9)] + [(1, None, month(1), 500.0, 1.0), (2, "bus", month(1), 700.0, 1.0)], "tid long, mode string, start_ts long, distance_m double, duration_s double")
    out = reports.monthly_insights(df)
    assert sorted((r["tid"], str(r["mode"]), r["month"], *[r[f"trend_{i}"] for i in range(6)]) for r in out.collect()) == [
        (1, "None", "1970-02", 0, 0, 0, 0, 0, 0), (1, "bus", "1970-01", 0, 0, 0, 0, 0, 1000), (1, "bus", "1970-02", 0, 0, 0, 0, 1000, 2000),
        (1, "bus", "1970-06", 1000, 2000, 0, 0, 0, 6000), (1, "bus", "1970-10", 0, 6000, 0, 0, 0, 10000), (2, "bus", "1970-02", 0, 0, 0, 0, 0, 700)]
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
