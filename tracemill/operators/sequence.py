"""Sequence operators that scale: islands, as-of joins, interval joins by bins.

Windows are partitioned by a key of few rows or by person and time bin; scan.py has those that run over a person's whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import WIDTH


def islands(df: DataFrame, keys: list[str], order: list, breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows of keys with few rows each (see scan.islands for whole histories): a row where `breaks` holds starts a new one. `breaks` may use lag() over the same window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("__starts", F.when(F.coalesce(breaks, F.lit(False)), 1).otherwise(0))
    return flagged.withColumn(name, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, value: list[str], keys: list[str] = [], forward: bool = False, tie: list[str] = [], width: int = WIDTH) -> DataFrame:  # noqa: B006
    """left with the right row of the latest right_ts <= left_ts (forward: earliest right_ts >= left_ts) as struct `asof`.

    Rows meet in time bins of `width` seconds: right rows of the bins that left asks for, in one union and one window, no per-row probe; what
    lies in the bins before comes from one row a bin. Equal times: the right row with the greatest (forward: smallest) tie columns. Rows
    with null keys or times find nothing.
    """
    names, sign = [f"__k{i}" for i in range(len(keys))], -1 if forward else 1
    rec = F.struct(F.col(right_ts).alias("at"), *value)
    kind = right.select(rec.alias("r"), F.struct(F.lit(0), *tie).alias("t")).schema
    common = lambda ts: [*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], (F.floor(F.col(ts) / width) * sign).alias("__bin"), F.col(ts).alias("__t")]
    r = right.select(*common(right_ts), rec.alias("__rec"), F.struct(F.lit(0), *tie).alias("__tie")).where("__t is not null")
    l = left.select(*common(left_ts), F.struct("*").alias("__row"))  # noqa: E741
    asked = l.select(*names, "__bin").distinct()
    of_bin = r.groupBy(*names, "__bin").agg((F.min_by if forward else F.max_by)("__rec", F.struct("__t", "__tie")).alias("__rec"), F.lit(1).alias("__own"))
    every = of_bin.unionByName(asked.withColumns({"__rec": F.lit(None).cast(kind["r"].dataType), "__own": F.lit(0)}))
    before = Window.partitionBy(*names).orderBy("__bin", "__own").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("__carried", F.last("__rec", ignorenulls=True).over(before)).where("__own = 0").drop("__rec", "__own")
    near = r.join(asked, [*names, "__bin"], "left_semi").withColumns({"__side": F.lit(1 if forward else 0), "__row": F.lit(None).cast(l.schema["__row"].dataType)})
    l = l.withColumns({"__side": F.lit(0 if forward else 1), "__rec": F.lit(None).cast(kind["r"].dataType), "__tie": F.lit(None).cast(kind["t"].dataType)})  # noqa: E741
    # forward is backward over the reversed order: frames that grow cost one step a row, frames that shrink would cost n
    down = (lambda c: F.col(c).desc()) if forward else F.col
    w = Window.partitionBy(*names, "__bin").orderBy(*[down(c) for c in ("__t", "__side", "__tie")]).rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(near).withColumn("__near", F.last("__rec", ignorenulls=True).over(w)).where("__row is not null").join(carried, [*names, "__bin"], "left")
    return out.select("__row.*", F.coalesce("__near", "__carried").alias("asof"))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: list[str], width: int = 86400) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals overlap: both sides go to the time bins they touch, an equi-join
    on the bin follows, and each pair is kept in its first common bin only. Column names must differ except for the keys."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b)) / width)))
    l = left.withColumn("__bin", bins(*left_span))  # noqa: E741
    r = right.withColumn("__bin", bins(*right_span))
    first = F.floor(F.greatest(F.col(left_span[0]), F.col(right_span[0])) / width)
    met = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(left_span[1]) >= F.col(right_span[0])) & (F.col("__bin") == first)
    return l.join(r, [*keys, "__bin"]).where(met).drop("__bin")


def clipped_per_bin(spans: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    """One row for each bin of `width` seconds that a span touches: bin number `name` and `seconds` inside it."""
    bins = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(start), F.col(end) - 1)) / width)))
    low = F.greatest(F.col(start), F.col(name) * width)
    return spans.where(F.col(end) > F.col(start)).withColumn(name, bins).withColumn("seconds", F.least(F.col(end), (F.col(name) + 1) * width) - low)
