"""Importance resampling towards a target distribution over hashed n-gram features.

A 256-byte table lower-cases A-Z and blanks the separators of a text's UTF-8 bytes, bytes.split() gives its words ([0-9a-z] and all
that isn't ASCII), and zlib.crc32 hashes each run of 1 to `n` words, a run's seed being the hash of the run before it was extended.
Counters sum the buckets in a task, Spark sums the tasks. A bucket's gain is the smoothed log ratio of target to documents; a
document's weight is the floored mean of its features' gains, its score the weight with Gumbel noise from a hash of its id, and the
highest scores are drawn: `percent` of the documents that have `min_words` words.

Bounds: a task holds one batch of texts, one piece of a text and at most `buckets` counts; the driver and each task hold `buckets`
gains. Scores are whole numbers of some 10^5 possible values, so ranks come from a histogram of scores (its size doesn't follow the
data) and a window inside one score.

Defined cases: null and empty texts, and texts without words, have no features, weight 0 and are never drawn (unless min_words is 0);
long texts are read in pieces, whole; equal scores are ranked by doc_id; repeated rows count and are drawn each on its own, ties among
them in any order (they are alike); rows without doc_id count as features, have no score and are never drawn; an empty table gives an
empty result, an empty target gains from smoothing alone; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, python_ready, stored

#: Byte by byte: letters of ASCII lower-cased, digits and all bytes over 127 kept, the rest blanks.
TABLE = bytes(b if b > 127 or chr(b) in LOWER + "0123456789" else b + 32 if chr(b) in UPPER else 32 for b in range(256))
#: A text's bytes are split in pieces of about this size, cut at blanks.
PIECE = 1 << 20
COUNTS = "bucket int, n long"
SCORES = "doc_id long, n_words long, n_features long, weight long"


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, a bounded list at a time."""
    plain = text.translate(TABLE) if text else b""
    at = 0
    while at < len(plain):
        cut = plain.find(b" ", at + PIECE)
        cut = len(plain) if cut < 0 else cut
        yield plain[at:cut].split()
        at = cut


def hashes(words: list[bytes], n: int, before: list[bytes]) -> Iterator[int]:
    """crc32 of each run of 1 to n words that ends in `words`; before: the last n - 1 words of the piece before."""
    yield from map(zlib.crc32, words)
    if n > 1:
        spaced, known = [b" " + w for w in before + words], len(before)
        for i, w in enumerate(before + words):
            seed = zlib.crc32(w)
            for j in range(i + 1, min(i + n, len(spaced))):
                seed = zlib.crc32(spaced[j], seed)
                if j >= known:
                    yield seed


def features(text: bytes | None, n: int) -> Iterator[tuple[int, Iterator[int]]]:
    """(words, hashes) of each piece of a text."""
    before: list[bytes] = []
    for words in pieces(text):
        yield len(words), hashes(words, n, before)
        before = (before + words)[-(n - 1) :] if n > 1 else []


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, n: how often each bucket stands in a table's text column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                for _, found in features(text, n):
                    for h, times in Counter(found).items():
                        total[h % buckets] += times
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"])

    python_ready(texts.sparkSession)
    return texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, COUNTS).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> list[int]:
    """A bucket's gain: 1000 ln of its smoothed share in the target over that in the documents, floored."""
    spark = docs.sparkSession
    ours, theirs = (stored(bucket_counts(df, n, buckets), "resampling-counts") for df in (docs, target))
    total, wanted = (float(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + buckets) for df in (ours, theirs))
    rows = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = rows.join(ours.withColumnRenamed("n", "s"), "bucket", "left").join(theirs.withColumnRenamed("n", "t"), "bucket", "left")
    t, s = (F.coalesce(c, F.lit(0)).cast("double") + 1 for c in ("t", "s"))
    found = rows.select("bucket", F.floor(1000 * F.ln(t * F.lit(total) / (s * F.lit(wanted)))).alias("gain")).collect()
    out = [0] * buckets
    for r in found:
        out[r["bucket"]] = r["gain"]
    return out


def weighed(docs: DataFrame, gain: list[int], n: int = 1) -> DataFrame:
    """SCORES: the weight of every document."""
    spark, buckets = docs.sparkSession, len(gain)
    python_ready(spark)
    sent = spark.sparkContext.broadcast(np.array(gain, np.int64))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            made: list[tuple[int, int, int]] = []
            for text in batch["text"].to_pylist():
                n_words = n_features = total = 0
                for words, found in features(text, n):
                    at = np.fromiter(found, np.int64) % buckets
                    n_words, n_features, total = n_words + words, n_features + len(at), total + int(table[at].sum())
                made.append((n_words, n_features, total // n_features if n_features else 0))
            columns = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(weigh, SCORES)


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a standard Gumbel number, floored; it depends on the id and the seed alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def drawn(rows: DataFrame, most: int) -> DataFrame:
    """rows with a rank from 1 to `most` by falling score and rising doc_id, null beyond."""
    counts = stored(rows.groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / 1000)), "resampling-scores")
    falling = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # over a few hundred blocks
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(falling), F.lit(0)).alias("above"))
    inside = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "score", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("before")).join(blocks, "block")
    offsets = offsets.select("score", (F.col("before") + F.col("above")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    ranked = rows.join(offsets.where(F.col("before") < most), "score", "left").withColumn("rank", F.col("before") + nth)
    return ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).cast("long")).drop("before")


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs (doc_id, text); target needs a text column."""
    scores = weighed(docs, gains(docs, target, n, buckets), n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scores = stored(scores, "resampling-documents")
    may = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    able = scores.where(may)
    ranked = drawn(able, able.count() * percent // 100)
    rest = scores.where(~may).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
