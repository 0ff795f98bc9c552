"""Mixing sources to target token counts by entropy balancing, in DataFrame operations only.

Unit weights are one a document; the moment constraint of each source is its token target. The convex
dual has one multiplier a source and is solved by Newton steps whose gradient and curvature are sums over
all documents. The primal solution is the exponentially tilted rate of each document, here with the
bounded entropy of rates in [0, max_copies]:  rate = max_copies * e / (e + max_copies - 1), e = exp(lambda * size / mean size).
Rates become whole copies: copies = floor(rate + u + shift), u a hash of the document, shift the one number a
source that brings its taken words nearest to the target, found from two histograms.

Defined cases: a null text has size 0; a source without words has target 0 and takes nothing; a null
source is a source of its own and comes last; documents of size 0 get no copies; repeated doc_ids are
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

BINS = 4096


def water_filled(sources: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """sources (skey, source, source_size) with target: min(cap * size, level * weight), summing up to share of all sizes.

    Sources sorted by cap * size / weight fill up in that order: the level is set by those that don't.
    It works on one row a source.
    """
    order = Window.orderBy("skey")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sources.withColumn("weight", pick).withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    up, every = Window.orderBy("full_at", "skey").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (
        rows.withColumn("before", F.coalesce(F.sum(cap * F.col("source_size")).over(up), F.lit(0.0)))
        .withColumn("w_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
        .withColumn("level", (share * F.sum("source_size").over(every) - F.col("before")) / F.col("w_left"))
    )
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "skey", "level"))).over(every)["level"]  # of the first source that isn't full
    return rows.withColumn("target", F.least(cap * F.col("source_size"), F.coalesce(level * F.col("weight"), cap * F.col("source_size"))).cast("double")).select("skey", "source", "source_size", "target")


def tilted(scaled: Column, multiplier: Column, most: float) -> Column:
    """The rate in [0, most] that the dual multiplier gives; 1 at multiplier 0."""
    return most / (1 + (most - 1) * F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), multiplier * scaled))))


def balanced(groups: DataFrame, targets: DataFrame, most: float, steps: int = 12, tolerance: float = 1e-4) -> DataFrame:
    """skey, multiplier. groups: (skey, size, n): documents of the same source and size share their rate.

    Newton steps on the dual, each one sum over groups; a step is halved, or the bracket of multipliers cut,
    wherever Newton would leave it.
    """
    state = stored(
        groups.groupBy("skey").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
        .join(targets, "skey")
        .select("skey", "mean", "target", F.lit(0.0).alias("multiplier"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"), F.lit(False).alias("done")),
        "mix-state",
    )
    for _ in range(steps):
        scaled = F.col("size") / F.col("mean")
        rate = tilted(scaled, F.col("multiplier"), most)
        sums = groups.join(state, "skey").groupBy("skey").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("taken"),
            F.sum(F.col("n") * F.col("size") * scaled * rate * (1 - rate / most)).alias("slope"),
        )
        off = F.col("taken") - F.col("target")
        low, high = F.when(off <= 0, F.col("multiplier")).otherwise(F.col("low")), F.when(off > 0, F.col("multiplier")).otherwise(F.col("high"))
        step = F.col("multiplier") - off / F.greatest(F.col("slope"), F.lit(1e-300))
        inside = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        done = F.abs(off) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        state = stored(
            state.join(sums, "skey").select("skey", "mean", "target", F.when(done, F.col("multiplier")).otherwise(inside).alias("multiplier"), low.alias("low"), high.alias("high"), done.alias("done")),
            "mix-state",
        )
        if state.where("not done").isEmpty():
            break
    return state.select("skey", "mean", "multiplier")


def _crossings(docs: DataFrame, copies: int) -> DataFrame:
    """skey, at, size: the shifts at which a document takes its first, second ... copy."""
    levels = F.explode(F.array(*[F.lit(float(k)) for k in range(1, copies + 1)])).alias("copy")
    return docs.where("size > 0").select("skey", "size", "want", levels).select("skey", "size", (F.col("copy") - F.col("want")).alias("at"))


def _chosen(bins: DataFrame) -> DataFrame:
    """From (skey, bin, words, target): the last bin that is taken whole (may be none) and the words up to there."""
    upto = F.sum("words").over(Window.partitionBy("skey").orderBy("bin"))
    return bins.withColumn("upto", upto).where(F.col("upto") <= F.col("target")).groupBy("skey").agg(F.max_by("bin", "upto").alias("bin"), F.max("upto").alias("taken"))


def mixed(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs (doc_id, source, text ...) with size, source_size, target, rate, copies and taken added; text and others stay out."""
    rows = stored(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
        .withColumn("skey", F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce("source", F.lit("")))),
        "mix-sizes",
    )
    groups = stored(rows.groupBy("skey", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")), "mix-groups")
    targets = stored(water_filled(groups.groupBy("skey").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, float(most)), "mix-targets")
    duals = balanced(groups.where("size > 0"), targets.where("source_size > 0").select("skey", "target"), float(most))
    small = stored(targets.join(duals, "skey", "left"), "mix-duals")

    # u is uniform and the same in every run; only rows of one doc_id and one text share it
    u = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id"), F.col("mark")), F.lit(1 << 40)) / float(1 << 40)
    rate = F.when((F.col("size") == 0) | F.col("mean").isNull(), F.lit(0.0)).otherwise(tilted(F.col("size") / F.col("mean"), F.col("multiplier"), float(most)))
    rated = rows.join(small.select("skey", "source_size", "target", "mean", "multiplier"), "skey", "left").withColumn("rate", rate).withColumn("want", F.col("rate") + u)

    # the shift: first to 1 / BINS of its range, then inside the bin where the target falls
    span = float(most + 1)
    first = _crossings(rated, most).withColumn("bin", F.floor((F.col("at") + span) * (BINS / (2 * span))))
    goal = targets.select("skey", "target")
    coarse = _chosen(stored(first.groupBy("skey", "bin").agg(F.sum("size").alias("words")), "mix-bins").join(goal, "skey"))
    coarse = stored(goal.join(coarse, "skey", "left").select("skey", "target", F.coalesce("bin", F.lit(-1)).alias("done_bin"), F.coalesce("taken", F.lit(0)).alias("base")), "mix-coarse")
    width = 2 * span / BINS
    start = (F.col("done_bin") + 1) * width - span
    fine = first.join(coarse, "skey").where("bin > done_bin").groupBy("skey").agg(F.min("bin").alias("open_bin"))
    coarse = stored(coarse.join(fine, "skey", "left").withColumn("start", F.coalesce(F.col("open_bin") * width - span, start)), "mix-open")
    inside = (
        first.join(coarse, "skey").where("bin = open_bin")
        .withColumn("bin", F.floor((F.col("at") - F.col("start")) / width * BINS))
        .groupBy("skey", "bin").agg(F.sum("size").alias("words"))
    )
    upto = F.sum("words").over(Window.partitionBy("skey").orderBy("bin")) + F.col("base")
    steps = stored(inside.join(coarse, "skey").withColumn("upto", upto).select("skey", "bin", "upto", "target", "base", "start"), "mix-fine")
    nearest = steps.groupBy("skey").agg(F.min_by("bin", F.struct(F.abs(F.col("upto") - F.col("target")), "bin")).alias("bin"), F.min(F.abs(F.col("upto") - F.col("target"))).alias("off"), F.first(F.abs(F.col("base") - F.col("target"))).alias("stay"))
    shift = stored(coarse.join(nearest, "skey", "left").select("skey", "start", (F.when(F.col("off") < F.col("stay"), F.col("bin"))).alias("last_bin"), F.col("open_bin")), "mix-shifts")

    taken = F.lit(0)
    for k in range(1, most + 1):
        at = k - F.col("want")
        coarse_bin = F.floor((at + span) * (BINS / (2 * span)))
        fine_bin = F.floor((at - F.col("start")) / width * BINS)
        is_taken = (coarse_bin < F.coalesce("open_bin", F.lit(1 << 40))) | ((coarse_bin == F.col("open_bin")) & (fine_bin <= F.col("last_bin")))
        taken = taken + F.when((F.col("size") > 0) & F.coalesce(is_taken, F.lit(False)), 1).otherwise(0)
    return (
        rated.join(shift, "skey", "left").withColumn("copies", taken.cast("long"))
        .select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
