"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact Euclidean distance.

Each of TABLES tables cuts space into cells by floor((a . x + b) / w) for a few Gaussian projections a. A neighbour at
distance d falls into a cell with a probability that its projections give; a query visits the cells
around its own in falling order of that probability until they hold a share of it that brings the tables
together to the target recall. All rows are indexed; d, and with it w, comes from a bounded sample (SAMPLE rows).

Equal vectors are one entry with their smallest ids, so that a vector with many copies fills no bucket. Cells are dealt
to shards, and shards of more than SHARD rows are split by a hash of the vector, with the queries going to each
part. Queries that get fewer than k are searched again in all cells.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id;
vectors of different lengths never meet; repeated rows count once; ties go to the smaller id; without candidates a query has no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash128, python_ready, stored

TABLES, SAMPLE, SHARD, TARGET = 4, 2000, 20_000, 0.96
_Z = np.vectorize(math.erf)


def valid(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), h1, h2 of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(whole).select("vec_id", "v", hash128(F.col("v")).alias("h")).select("vec_id", "v", "h.h1", "h.h2")


class Tables:
    """The hash functions for vectors of one length, from a fixed seed."""

    def __init__(self, dim: int, projections: int, distance: float, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.distance, self.width = distance, 0.87 * distance
        self.a = rng.normal(size=(TABLES, dim, projections))
        self.b = rng.uniform(0, self.width, (TABLES, projections))

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.width

    @staticmethod
    def cell(steps: np.ndarray) -> np.ndarray:
        """One number for a row of steps."""
        out = np.zeros(steps.shape[:-1], np.int64)
        for m in range(steps.shape[-1]):
            out = out * 1_000_003 + steps[..., m].astype(np.int64) * 0x9E3779B1
        return out

    def probes(self, place: np.ndarray, mass: float) -> np.ndarray:
        """The cells around a place, best first, until they hold `mass` of a neighbour's probability."""
        home = np.floor(place).astype(int)
        reach = np.arange(-4, 5)
        axes = []
        for p, h in zip(place, home, strict=True):
            edge = (h + np.append(reach, 5) - p) * self.width / self.distance
            share = np.diff(0.5 * (1 + _Z(edge / math.sqrt(2))))
            order = np.argsort(-share, kind="stable")
            axes.append((h + reach[order], np.log(np.maximum(share[order], 1e-12))))
        first = (0,) * len(axes)
        queue, seen, held, out = [(-sum(a[1][0] for a in axes), first)], {first}, 0.0, []
        while queue and held < mass:
            cost, at = heapq.heappop(queue)
            held += math.exp(-cost)
            out.append([axes[m][0][i] for m, i in enumerate(at)])
            for m, i in enumerate(at):
                if i + 1 < len(reach) and (new := (*at[:m], i + 1, *at[m + 1 :])) not in seen:
                    seen.add(new)
                    heapq.heappush(queue, (cost + axes[m][1][i] - axes[m][1][i + 1], new))
        return self.cell(np.array(out))


def fitted(sample: np.ndarray, rows: int, k: int) -> Tables:
    """Tables for the distance of a k-th neighbour in the sample, which is no smaller than among all rows."""
    d2 = (sample**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * sample @ sample.T
    np.fill_diagonal(d2, np.inf)
    near = np.sqrt(np.maximum(np.sort(d2, 1)[:, min(k, len(sample) - 1) - 1], 0)) if len(sample) > 1 else np.ones(1)
    distance = float(np.median(near[np.isfinite(near)])) or float(np.sqrt((sample**2).sum(1)).mean())
    projections = int(np.clip(round(math.log(max(rows, 1) / 64) / math.log(5)), 2, 12)) if rows > 64 else 2
    return Tables(sample.shape[1], projections, distance)


def search_shard(k: int):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k nearest entries of one shard part for each query that visits it."""
        if not len(index) or not len(queries):
            return pd.DataFrame({"q1": [], "q2": [], "h1": [], "h2": [], "score": []}).astype({"q1": "int64", "q2": "int64", "h1": "int64", "h2": "int64"})
        order = np.argsort(index["cell"].to_numpy(), kind="stable")
        cells, x = index["cell"].to_numpy()[order], np.stack(index["v"].to_numpy()[order])
        h, norm, out = index[["h1", "h2"]].to_numpy()[order], (x**2).sum(1), []
        for q1, q2, v, visited in zip(queries["q1"], queries["q2"], queries["v"], queries["cells"], strict=True):
            if visited is None or not len(visited):
                at = np.arange(len(x))
            else:
                visited = np.unique(visited)
                a, b = np.searchsorted(cells, visited), np.searchsorted(cells, visited, side="right")
                at = np.concatenate([np.arange(i, j) for i, j in zip(a, b, strict=True) if j > i] or [np.zeros(0, int)])
            if not len(at):
                continue
            rough = norm[at] - 2 * (x[at] @ v)
            if len(at) > 2 * k:
                at = at[np.argpartition(rough, 2 * k)[: 2 * k]]
            score = np.sqrt(((x[at] - v) ** 2).sum(1))
            best = np.argsort(score, kind="stable")[: k + 4]
            out.append(pd.DataFrame({"q1": q1, "q2": q2, "h1": h[at[best], 0], "h2": h[at[best], 1], "score": score[best]}))
        return pd.concat(out) if out else search(index[:0], queries)

    return search


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """rows, queries: vec_id, embedding. Returns query_id, rank, vec_id, score: for each query its k nearest other rows found."""
    spark = rows.sparkSession
    python_ready(spark)
    every = stored(valid(rows).dropDuplicates(["h1", "h2", "vec_id"]), "ann-rows")
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    copies = every.withColumn("r", first).where(F.col("r") <= k + 1)
    index = stored(copies.groupBy("h1", "h2").agg(F.collect_list("vec_id").alias("ids"), F.any_value("v").alias("v")), "ann-index")
    asked = stored(valid(queries).dropDuplicates(["h1", "h2", "vec_id"]), "ann-asked")
    search = stored(asked.groupBy("h1", "h2").agg(F.any_value("v").alias("v")).select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "v"), "ann-queries")

    found = None
    sizes = {r["dim"]: r["n"] for r in index.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # one row a vector length
    for dim, n in sorted(sizes.items()):
        part = index.where(F.size("v") == dim)
        thin = min(1.0, 3 * SAMPLE / n)
        sample = part.where(F.pmod("h1", F.lit(1 << 20)) < int(thin * (1 << 20)) + 1).orderBy("h2").limit(SAMPLE).select("v").collect()
        got = _searched(part, search.where(F.size("v") == dim), fitted(np.array([r["v"] for r in sample]), n, k), n, k, False)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    found = stored(_ranked(found, index, k), "ann-found")
    short = search.join(found.groupBy("q1", "q2").agg(F.count("*").alias("n")), ["q1", "q2"], "left").where(F.coalesce("n", F.lit(0)) <= k).drop("n")
    short = stored(short, "ann-short")
    if sum(sizes.values()) > 0 and not short.isEmpty():  # too few found: all cells
        more = None
        for dim, n in sorted(sizes.items()):
            got = _searched(index.where(F.size("v") == dim), short.where(F.size("v") == dim), Tables(dim, 2, 1.0), n, k, True)
            more = got if more is None else more.unionByName(got)
        found = found.join(short.select("q1", "q2"), ["q1", "q2"], "left_anti").unionByName(_ranked(more, index, k))
    mine = asked.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).join(found, ["q1", "q2"]).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q1", "q2").orderBy("score", "vec_id"))
    return mine.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _ranked(found: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """q1, q2, vec_id, score: the k + 1 nearest ids of each query vector (its own may be one of them)."""
    best = Window.partitionBy("q1", "q2").orderBy("score", "vec_id")
    rows = found.distinct().join(index.select("h1", "h2", "ids"), ["h1", "h2"]).select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
    return rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")


def _searched(index: DataFrame, search: DataFrame, tables: Tables, n: int, k: int, everywhere: bool) -> DataFrame:
    """q1, q2, h1, h2, score: candidates of all tables."""
    spark = index.sparkSession
    shards, used = max(1, -(-n // SHARD)), 1 if everywhere else TABLES
    mass = 1 - (1 - TARGET) ** (1 / TABLES)
    sent = (tables.a, tables.b, tables.width, tables.distance)

    def rebuilt() -> Tables:
        t = Tables.__new__(Tables)
        t.a, t.b, t.width, t.distance = sent
        return t

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = rebuilt()
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                for k_ in range(used):
                    cell = t.cell(np.floor(t.places(x, k_)))
                    yield b.assign(tab=k_, cell=cell, shard=(cell % shards).astype(int))

    def aimed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = rebuilt()
        for b in batches:
            out = []
            for q1, q2, v in zip(b["q1"], b["q2"], b["v"], strict=True):
                for k_ in range(used):
                    cells = None if everywhere else t.probes(t.places(v[None], k_)[0], mass)
                    for s in range(shards) if everywhere else np.unique(cells % shards):
                        out.append((q1, q2, v, k_, int(s), [] if everywhere else cells[cells % shards == s]))
            if out:
                yield pd.DataFrame(out, columns=["q1", "q2", "v", "tab", "shard", "cells"])

    entries = index.select("h1", "h2", "v").mapInPandas(hashed, "h1 long, h2 long, v array<double>, tab int, cell long, shard int")
    entries = stored(entries, "ann-entries")
    probes = stored(search.mapInPandas(aimed, "q1 long, q2 long, v array<double>, tab int, shard int, cells array<long>"), "ann-probes")
    parts = stored(entries.groupBy("tab", "shard").agg(F.ceil(F.count("*") / F.lit(SHARD)).cast("int").alias("parts")), "ann-parts")
    left = entries.join(parts, ["tab", "shard"]).select("tab", "shard", F.expr("cast(pmod(xxhash64(h1, h2), parts) as int)").alias("part"), "h1", "h2", "cell", "v")
    right = probes.join(parts, ["tab", "shard"]).select("tab", "shard", F.expr("explode(sequence(0, parts - 1))").alias("part"), "q1", "q2", "v", "cells")
    return left.groupBy("tab", "shard", "part").cogroup(right.groupBy("tab", "shard", "part")).applyInPandas(search_shard(k + 1), "q1 long, q2 long, h1 long, h2 long, score double")
