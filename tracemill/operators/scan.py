"""Running values over a person's whole history without a task that holds it.

A window partitioned by person puts a history of any length in one task. Here rows are dealt by person and time bin; a bin's window
sees the bin's rows only, and what the bins before it add up to (their last row, sum or greatest value) is carried in from one summary
row a bin. The results are those of the one window, wherever the bins cut. Rows are shuffled once for themselves and once, as few
columns, for the summaries; keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bin. It bounds what a task must hold of a person, and the summary of a person has a row for each bin that has rows.
WIDTH = 7 * 86_400


def _binned(df: DataFrame, keys: list[str], ts: str, order: list[str], width: int, back: bool):
    """Rows with their bin (__bin, rising in the order of the scan), the window of a bin, and the window of the bins before one."""
    down = (lambda c: F.col(c).desc()) if back else F.col
    rows = df.withColumn("__bin", F.floor(F.col(ts) / width) * (-1 if back else 1))
    w = Window.partitionBy(*keys, "__bin").orderBy(down(ts), *[down(c) for c in order])
    return rows, w, Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, keys: list[str], ts: str, order: list[str], values: dict[str, tuple[str, Column]], width: int = WIDTH, back: bool = False) -> DataFrame:
    """df with a column for each of `values` (name: kind, value), over the rows of the same keys in the order of ts and `order`:

    lag: the value in the row before; last: the last non-null value up to this row; sum: the sum up to this row; max_before: the greatest
    value before this row. back: from the end of time (lag is then lead). ts and order tell the rows of a key apart.
    """
    rows, w, before = _binned(df, keys, ts, order, width, back)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = {"lag": lambda v: F.lag(v).over(w), "last": lambda v: F.last(v, ignorenulls=True).over(upto), "sum": lambda v: F.sum(v).over(upto), "max_before": lambda v: F.max(v).over(earlier)}
    of_bin = {"lag": lambda v, n: F.struct(v.alias("v")), "last": lambda v, n: F.col(n), "sum": lambda v, n: F.col(n), "max_before": lambda v, n: F.greatest(v, F.col(n))}
    carry = {"lag": lambda n: F.last(n).over(before), "last": lambda n: F.last(n, ignorenulls=True).over(before), "sum": lambda n: F.sum(n).over(before), "max_before": lambda n: F.max(n).over(before)}
    joined = {
        "lag": lambda n, c: F.when(F.col("__first"), F.col(f"{c}.v")).otherwise(F.col(n)),
        "last": lambda n, c: F.coalesce(n, c),
        "sum": lambda n, c: F.when(F.col(n).isNull(), F.col(c)).otherwise(F.col(n) + F.coalesce(c, F.lit(0))),
        "max_before": lambda n, c: F.greatest(n, c),
    }
    rows = rows.withColumns({f"__l_{n}": local[kind](v) for n, (kind, v) in values.items()} | {"__first": F.lag(F.lit(1)).over(w).isNull(), "__last": F.lead(F.lit(1)).over(w).isNull()})
    ends = rows.where("__last").select(*keys, "__bin", *[of_bin[kind](v, f"__l_{n}").alias(f"__c_{n}") for n, (kind, v) in values.items()])
    carried = ends.select(*keys, "__bin", *[carry[kind](f"__c_{n}").alias(f"__c_{n}") for n, (kind, _) in values.items()])
    out = rows.join(carried, [*keys, "__bin"], "left")
    return out.select(*df.columns, *[joined[kind](f"__l_{n}", f"__c_{n}").alias(n) for n, (kind, _) in values.items()])


def islands(df: DataFrame, keys: list[str], ts: str, order: list[str], lagged: dict[str, Column], breaks: Column, name: str = "island", width: int = WIDTH) -> DataFrame:
    """Numbers runs of rows within the keys: a row where `breaks` holds starts a new one. lagged: names for values of the row before, which
    `breaks` may use; they stay as columns.

    Breaks inside a bin are found there; whether a bin's first row starts a run is found among the bins, whose summaries hold their first row,
    the lagged values of their last one and their number of breaks."""
    rows, w, before = _binned(df, keys, ts, order, width, False)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.coalesce(breaks, F.lit(False)), 1).otherwise(0)
    marks = {"__first": F.lag(F.lit(1)).over(w).isNull(), "__last": F.lead(F.lit(1)).over(w).isNull()}
    rows = rows.withColumns({n: F.lag(v).over(w) for n, v in lagged.items()} | marks)
    rows = rows.withColumn("__break", F.when(F.col("__first"), 0).otherwise(starts)).withColumn("__breaks", F.sum("__break").over(upto))
    rest = [c for c in df.columns if c not in keys]
    head = F.first(F.struct(*rest)).over(upto) if rest else F.struct()
    ends = rows.withColumn("__head", head).where("__last").select(*keys, "__bin", "__head.*", F.col("__breaks").alias("__held"), *[F.struct(v.alias("v")).alias(f"__c_{n}") for n, v in lagged.items()])
    one = Window.partitionBy(*keys).orderBy("__bin")
    bins = ends.withColumns({n: F.lag(f"__c_{n}").over(one)["v"] for n in lagged}).withColumn("__new", starts)
    offset = F.coalesce(F.sum(F.col("__new") + F.col("__held")).over(before), F.lit(0)) + F.col("__new")
    carried = bins.select(*keys, "__bin", offset.alias("__offset"), *[F.col(n).alias(f"__c_{n}") for n in lagged])
    out = rows.join(carried, [*keys, "__bin"], "left")
    seen = [F.when(F.col("__first"), F.col(f"__c_{n}")).otherwise(F.col(n)).alias(n) for n in lagged]
    return out.select(*df.columns, *seen, (F.col("__breaks") + F.col("__offset")).alias(name))
