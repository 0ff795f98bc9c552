"""A Merkle manifest of a table: one tree a source, a tree over the sources' roots, and an inclusion proof for every row.

A leaf is the SHA-256 of a row's columns, each with its length in front. Leaves of a source are numbered by doc_id; every `width`
consecutive nodes form a run, whose hash is the node above. A level is one self-join: the slot-zero rows of the runs look for their
siblings at computed indices (their own plus 1 to width - 1), and emit the parents. Going down again, each run hands to its members
what the levels above add to their proofs, so proofs are put together where their run is, and never shuffled whole.

Numbers within a source come from one sort over all sources, dealt by range, and counts of the ranges before, so no source has to fit
in a task. The driver runs one round a level (nine for 16^9 rows) and holds nothing but the largest number of nodes.

Defined cases: nulls in any hashed column are hashed as `-`, empty texts as `0:`; long texts are hashed whole where they stand; a null
source is a source of its own, before all others; null doc_ids come first in their source; rows of one doc_id are ordered by leaf, and
like rows are leaves each; an empty table gives an empty manifest (it has no root); further columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

WIDTH = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**instead: Column) -> Column:
    return F.sha2(F.concat(*[field(instead.get(c, F.col(c))) for c in COLUMNS]), 256)


def source_key() -> Column:
    """Never null, and ordered as the sources are: null first, then by their bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with idx, from 0 within each g by `order`, and n, the rows of g; g may hold any number of rows."""
    ranges = stored(rows.repartitionByRange("g", *order).withColumn("part", F.spark_partition_id()), "manifest-ranges")
    counts = ranges.groupBy("g", "part").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("g").orderBy("part")
    counts = counts.select("g", "part", F.coalesce(F.sum("held").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"), F.sum("held").over(Window.partitionBy("g")).alias("n"))
    nth = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order))
    return ranges.withColumn("nth", nth).join(counts, ["g", "part"]).withColumn("idx", F.col("nth") - 1 + F.col("skip")).drop("part", "nth", "skip")


def runs_of(nodes: DataFrame, *carried: str) -> DataFrame:
    """g, idx (of the parent), n (of the parents), h (its hash), members: the slot-zero rows with the siblings found at their computed indices."""
    last = F.least(F.col("idx") + WIDTH - 1, F.col("n") - 1)
    zero = nodes.where((F.col("n") > 1) & (F.col("idx") % WIDTH == 0))
    wanted = zero.select("g", F.col("idx").alias("zero"), "n", F.explode(F.sequence(F.col("idx"), last)).alias("idx"))
    met = wanted.join(nodes.drop("n"), ["g", "idx"])
    runs = met.groupBy("g", "zero", "n").agg(F.array_sort(F.collect_list(F.struct("idx", "h", *carried))).alias("members"))
    return runs.select("g", (F.col("zero") / WIDTH).cast("long").alias("idx"), F.ceil(F.col("n") / WIDTH).alias("n"), F.sha2(F.array_join("members.h", ""), 256).alias("h"), "members")


def tree(nodes: DataFrame, *carried: str) -> tuple[DataFrame, list[DataFrame]]:
    """roots (g, top: its level, h), and the runs of each level from the leaves up. nodes: g, idx, n, h and what the leaves carry."""
    level, levels, roots = nodes, [], []
    while True:
        roots.append(level.where("n = 1").select("g", F.lit(len(levels)).alias("top"), "h"))
        if (level.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        levels.append(stored(runs_of(level, *(carried if not levels else ())), "manifest-runs"))
        level = levels[-1].select("g", "idx", "n", "h")
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return out, levels


STEP = "array<struct<left string, right string>>"


def spread(runs: DataFrame, above: DataFrame) -> DataFrame:
    """The members of each run, with the step that their own level adds to what the run's node is given: g, member, steps, further columns of above."""
    met = runs.select("g", "idx", "members").join(above, ["g", "idx"])
    rest = [c for c in above.columns if c not in ("g", "idx", "steps")]
    out = met.select("g", F.posexplode("members").alias("slot", "member"), "members", "steps", *rest)
    hashes = F.col("members.h")
    left, right = (F.array_join(x, "") for x in (F.slice(hashes, F.lit(1), F.col("slot")), F.slice(hashes, F.col("slot") + 2, F.lit(WIDTH))))
    return out.select("g", "member", F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("steps")).alias("steps"), *rest)


def steps_down(roots: DataFrame, levels: list[DataFrame], start: DataFrame) -> DataFrame:
    """The rows of the lowest level: g, member, steps and further columns of start (g, steps and more, one row for each g)."""
    start = roots.drop("h").join(start, "g").withColumn("idx", F.lit(0).cast("long"))
    given = None
    for k in range(len(levels) - 1, -1, -1):
        here = start.where(F.col("top") == k + 1).drop("top")
        given = here if given is None else given.unionByName(here)
        given = spread(levels[k], given)
        if k:
            given = given.select("g", F.col("member.idx").alias("idx"), *[c for c in given.columns if c not in ("g", "member")])
    return given


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, steps and tampered_leaf of every row of docs (COLUMNS).

    steps: for each level from the leaf's up, the hashes of its run left and right of the node. tampered_leaf: what the leaf would be
    with the text's A-Z in lower case, where 5 divides the crc32 of doc_id; else the leaf."""
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaf = leaf_hash()
    leaves = docs.select(source_key().alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("h"), F.when(fifth, leaf_hash(text=ascii_lower(F.col("text")))).otherwise(leaf).alias("tampered"))
    leaves = stored(numbered(leaves, "doc_id", "h"), "manifest-leaves")
    subroots, levels = tree(leaves, "doc_id", "tampered")
    subroots = stored(subroots, "manifest-subroots")

    tops = numbered(subroots.select(F.lit("all").alias("g"), F.col("g").alias("source_key"), "h"), "source_key")
    tops = stored(tops, "manifest-tops")
    roots, upper = tree(tops, "source_key")
    nothing = F.array().cast(STEP)
    root = roots.select("g", F.col("h").alias("root"), nothing.alias("steps"))
    alone = tops.where("n = 1").select(F.struct("idx", "h", "source_key").alias("member"), F.col("h").alias("root"), nothing.alias("steps"))
    if upper:
        alone = alone.unionByName(steps_down(roots, upper, root).select("member", "root", "steps"))
    sources = stored(alone.select(F.col("member.source_key").alias("g"), F.col("member.h").alias("subroot"), "root", "steps"), "manifest-sources")

    single = leaves.where("n = 1").join(sources, "g").select("doc_id", F.col("h").alias("leaf"), "tampered", "subroot", "root", "steps")
    if levels:
        found = steps_down(subroots, levels, sources)
        single = single.unionByName(found.select("member.doc_id", F.col("member.h").alias("leaf"), "member.tampered", "subroot", "root", "steps"))
    return single.withColumnRenamed("tampered", "tampered_leaf")


def proof_text() -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate("steps", leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))
