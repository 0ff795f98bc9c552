"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

State lives in a folder, one sub-folder per version:

* postings  (shard, h1, h2, doc_id): which document holds which line key;
* refcounts (shard, h1, h2, n_docs, min_doc): exact counts; min_doc keeps the lines;
* filters   (shard, n_buckets, data): one cuckoo filter a shard, holding the keys of two or more documents.

insert() and delete() touch only the keys of the documents given: counts are brought up to date from
postings, and filter entries go in as a key's count reaches two and out as it falls below.
clean() asks the filters first, at every size; only lines that they may hold meet the exact table.

Defined cases: a null or empty text is one empty line; lines under min_chars code points always stay;
a line repeated within its first document stays as often as it stands there; rows of the same doc_id are
one document; rows without a doc_id are passed through whole and count nowhere; an empty table gives an
empty result; further columns are passed through by clean().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, hash128, python_ready, scratch_path, stored

#: Filters of up to this many bytes in all are sent to every task; larger ones meet their shard's lines, dealt by shard.
BROADCAST_BYTES = 32 << 20
#: Shards with more lines than this are dealt in several parts, each with a copy of the filter.
PART_LINES = 1 << 20
KEYS_PER_SHARD = 1 << 17
FILTER_SCHEMA = "shard int, n_buckets long, data binary"


def line_key(line):
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that counts: doc_id, rid (tells apart texts of the same doc_id), pos, h1, h2."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    key = line_key(F.col("line"))
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("rid"), F.posexplode(lines).alias("pos", "line"))
        .select("doc_id", "rid", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "rid", "pos", hash128(F.col("key")).alias("h"))
        .select("doc_id", "rid", "pos", "h.h1", "h.h2")
    )


class LineDedup:
    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = 10, shards: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, part_lines: int = PART_LINES):
        self.spark, self.min_chars, self.shards, self.version = spark, min_chars, shards, 0
        self.broadcast_bytes, self.part_lines = broadcast_bytes, part_lines
        python_ready(spark)
        self.path = path or scratch_path(spark, "line-dedup")

    # -- state ---------------------------------------------------------------------------------

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version:06d}/{name}")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := f"{self.path}/v{self.version + 1:06d}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def _keys(self, docs: DataFrame) -> DataFrame:
        return lines_of(docs, self.min_chars).select("h1", "h2", "doc_id").distinct()

    def _counts(self, postings: DataFrame) -> DataFrame:
        return postings.groupBy("shard", "h1", "h2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("min_doc"))

    # -- changes -------------------------------------------------------------------------------

    def insert(self, docs: DataFrame) -> None:
        """Adds documents. Lines of documents that are already in are added to theirs."""
        batch = self._keys(docs)
        if self.version == 0:
            self._first(batch)
            return
        batch = stored(self._sharded(batch), "line-batch")
        old = self._read("postings")
        self._change(old.unionByName(batch).distinct(), batch)

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes documents (a doc_id column) out again: as if they had never been inserted."""
        if self.version == 0:
            return
        gone, old = doc_ids.select("doc_id").distinct(), self._read("postings")
        batch = stored(old.join(gone, "doc_id", "left_semi"), "line-batch")
        self._change(old.join(gone, "doc_id", "left_anti"), batch)

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.col("h2"), F.lit(self.shards)).cast("int"))

    def _first(self, batch: DataFrame) -> None:
        postings = self._write(batch, "keys")
        if self.shards is None:  # grows with the first load, then stays
            self.shards = max(8, -(-postings.count() // KEYS_PER_SHARD))
        postings = self._write(self._sharded(postings), "postings")
        counts = self._write(self._counts(postings), "refcounts")
        self._write(self._built(counts.where("n_docs > 1")), "filters")
        self.version += 1

    def _built(self, repeated: DataFrame) -> DataFrame:
        def build(rows: pd.DataFrame) -> pd.DataFrame:
            return filled(int(rows["shard"].iloc[0]), rows["h1"].to_numpy())

        return repeated.groupBy("shard").applyInPandas(build, FILTER_SCHEMA)

    def _change(self, postings: DataFrame, batch: DataFrame) -> None:
        """Writes the next version, where only the keys of batch have changed."""
        touched = batch.select("shard", "h1", "h2").distinct()
        on = ["shard", "h1", "h2"]
        postings = self._write(postings.select("h1", "h2", "doc_id", "shard"), "postings")
        before, fresh = self._read("refcounts"), self._counts(postings.join(touched, on, "left_semi"))
        counts = self._write(before.join(touched, on, "left_anti").unionByName(fresh), "refcounts")
        moved = (
            touched.join(before.select(*on, F.col("n_docs").alias("was")), on, "left")
            .join(counts.select(*on, F.col("n_docs").alias("now")), on, "left")
            .select("shard", "h1", (F.coalesce("was", F.lit(0)) > 1).alias("was"), (F.coalesce("now", F.lit(0)) > 1).alias("now"))
            .where("was <> now")
        )
        old = self._read("filters")
        updated = stored(old.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(updated_filter, FILTER_SCHEMA), "line-filters")
        full = updated.where("data is null").select("shard")  # too full: built anew from the exact table
        rebuilt = self._built(counts.where("n_docs > 1").join(full, "shard", "left_semi"))
        self._write(updated.where("data is not null").unionByName(rebuilt), "filters")
        self.version += 1

    # -- use -----------------------------------------------------------------------------------

    def dropped(self, docs: DataFrame) -> DataFrame:
        """doc_id, rid, drop: the positions of the lines that go."""
        lines, filters = lines_of(docs, self.min_chars), self._read("filters")
        total = filters.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
        if total <= self.broadcast_bytes:
            lines = self._asked(lines, {r["shard"]: (r["n_buckets"], r["data"]) for r in filters.collect()})
        else:
            lines = self._asked_by_shard(self._sharded(lines), filters)
        repeated = self._read("refcounts").where("n_docs > 1").select("h1", "h2", "min_doc")
        gone = stored(lines.join(repeated, ["h1", "h2"]).where("doc_id <> min_doc").select("doc_id", "rid", "pos"), "line-drops")
        return gone.groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("drop"))

    def _asked(self, lines: DataFrame, filters: dict) -> DataFrame:
        sent, shards = self.spark.sparkContext.broadcast(filters), self.shards

        def ask(batches):
            import pyarrow as pa

            from .cuckoo import CuckooFilter

            ready = {k: CuckooFilter(n, data) for k, (n, data) in sent.value.items()}
            for batch in batches:
                h1, shard = batch["h1"].to_numpy(), batch["h2"].to_numpy() % shards
                keep = np.zeros(len(h1), bool)
                for k in np.unique(shard):
                    if (f := ready.get(int(k))) is not None:
                        at = np.flatnonzero(shard == k)
                        keep[at] = f.contains(h1[at])
                yield batch.filter(pa.array(keep))

        return lines.mapInArrow(ask, lines.schema)

    def _asked_by_shard(self, lines: DataFrame, filters: DataFrame) -> DataFrame:
        """Lines are dealt by shard, behind the shard's filter, and streamed past it; shards with many lines are dealt in parts."""
        lines = stored(lines, "line-sharded")
        many = lines.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > self.part_lines)
        parts = stored(many.select("shard", F.ceil(F.col("n") / self.part_lines).cast("int").alias("parts")), "line-parts")
        few = F.broadcast(parts) if parts.count() <= 1_000_000 else parts
        n_parts = F.coalesce("parts", F.lit(1))
        mine = lines.join(few, "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id", "pos"), n_parts).cast("int").alias("part"), F.lit(None).cast("binary").alias("data"), "doc_id", "rid", "pos", "h1", "h2")
        nothing = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("doc_id", "rid", "pos", "h1", "h2")]
        theirs = filters.join(few, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), "data", *nothing)
        dealt = theirs.unionByName(mine).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("data").isNull())

        def ask(batches):
            import pyarrow as pa

            from .cuckoo import SLOTS, CuckooFilter

            at, held = None, None
            for batch in batches:
                group = np.stack([batch["shard"].to_numpy(), batch["part"].to_numpy()])
                keep, data = np.zeros(batch.num_rows, bool), batch["data"]
                edges = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a == b:
                        continue
                    if (now := tuple(group[:, a])) != at:
                        at, held = now, None
                    if data[a].is_valid:  # a group's first row
                        held, a = CuckooFilter(len(raw := data[a].as_py()) // (2 * SLOTS), raw), a + 1
                    if held is not None and a < b:
                        keep[a:b] = held.contains(batch["h1"][a:b].to_numpy())
                yield batch.select(["doc_id", "rid", "pos", "h1", "h2"]).filter(pa.array(keep))

        return dealt.mapInArrow(ask, lines.select("doc_id", "rid", "pos", "h1", "h2").schema)

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs with kept_text, n_lines and n_dropped beside its own columns."""
        drops = self.dropped(docs).select(F.col("doc_id").alias("__tm_doc"), F.col("rid").alias("__tm_rid"), F.col("drop").alias("__tm_drop"))
        lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
        kept = F.array_except(F.sequence(F.lit(0), F.size("__tm_lines") - 1), F.col("__tm_drop"))
        return (
            docs.join(drops, (F.col("doc_id") == F.col("__tm_doc")) & (F.xxhash64("text") == F.col("__tm_rid")), "left")
            .withColumn("__tm_lines", lines)
            .withColumn("n_lines", F.size("__tm_lines").cast("long"))
            .withColumn("n_dropped", F.coalesce(F.size("__tm_drop"), F.lit(0)).cast("long"))
            .withColumn("kept_text", F.when(F.col("__tm_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__tm_lines", i)), "\n")))
            .drop("__tm_doc", "__tm_rid", "__tm_drop", "__tm_lines")
        )


def filled(shard: int, hashes: np.ndarray) -> pd.DataFrame:
    from .cuckoo import CuckooFilter, buckets_for

    n = buckets_for(len(hashes))
    while not (f := CuckooFilter(n)).insert(hashes):
        n *= 2
    return pd.DataFrame({"shard": [shard], "n_buckets": [n], "data": [f.to_bytes()]})


def updated_filter(key, old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after its changes; data is null if they don't fit."""
    from .cuckoo import CuckooFilter

    shard = int(key[0])
    add, gone = (moved.loc[moved["now"] == x, "h1"].to_numpy(np.int64) for x in (True, False))
    if not len(old):
        return filled(shard, add)
    n = int(old["n_buckets"].iloc[0])
    f = CuckooFilter(n, old["data"].iloc[0])
    f.delete(gone)
    return pd.DataFrame({"shard": [shard], "n_buckets": [n], "data": [f.to_bytes() if f.insert(add) else None]})
