"""Language-model scoring with a hidden Markov model trained on all training documents.

Tokens are [^\\x20\\x09-\\x0D]+ words, A-Z lower-cased, then one end token. The model emits symbols: the most frequent
tokens are symbols of their own; every other token belongs to one of CLASSES ending classes and has, given its
class, probability (c + 1) / (N_class + V_class + 1). The latter does not depend on the state, so the sequence
likelihood is exact: the scaled forward recursion over symbols times those factors.

Baum-Welch: a bounded sample of training documents gives the starting point; then each full pass sums
expected counts over all training documents, partition by partition, and Spark adds them up.
Counts of all tokens are exact. Tasks get the counts of the most frequent tokens (at most DICTIONARY); all other
tokens of a document meet their counts in a join.

Defined cases: a null or empty text is the end token alone; without training documents every token is
unknown; repeated rows are scored alike, each as a row of its own; a null doc_id counts as empty text
for the folds; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, stored
from .hmm import expected_counts, log_likelihood

END = b"\n"  # no word holds a line break
STATES, SYMBOLS, CLASSES = 12, 8192, 512
#: Bound on the tokens whose counts are sent to every task.
DICTIONARY = 200_000
#: Bound on the training documents from which Baum-Welch starts.
SAMPLE_DOCS, SAMPLE_PASSES, FULL_PASSES = 2000, 10, 2
#: A longer document is cut for the expected counts, not for the scores.
CUT = 1 << 16
FLUSH = 200_000


def tokens(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, which is what the contract says."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def ending_class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % CLASSES


def token_counts(docs: DataFrame) -> DataFrame:
    """token (binary), n, over all texts given; counted in the tasks first."""

    def count(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update(tokens(text))
                if len(seen) > FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """All tokens at or above the smallest count that at most `most` tokens reach, by falling count."""
    level = F.when(F.col("n") < 2048, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 2048)
    steps, total, least = counts.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), 0, None
    for row in sorted(steps, key=lambda r: -r["level"]):
        total += row["k"]
        if total > most:
            break
        least = row["n"]
    if least is None:
        return []
    return sorted(((bytes(r["token"]), r["n"]) for r in counts.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))


class Dictionary:
    """What a task knows of the frequent tokens: symbol and log10(c + 1)."""

    def __init__(self, known: list[tuple[bytes, int]]):
        self.index = {t: i for i, (t, _) in enumerate(known)}
        self.symbol = np.array([i if i < SYMBOLS else SYMBOLS + ending_class(t) for i, (t, _) in enumerate(known)], np.int32)
        self.log = np.log10(np.array([c for _, c in known], float) + 1)


def encoded(docs: DataFrame, known) -> DataFrame:
    """uid, doc_id, train, n_tokens, n_here, log_here, log_class, symbols, rare, rare_n: each document as symbols, and the tokens still to be counted."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = known.value
        for b in batches:
            rows = []
            for text in b["text"]:
                words = tokens(text)
                at = np.fromiter(map(d.index.get, words, repeat(-1)), np.int32, len(words))
                miss = np.flatnonzero(at < 0)
                rare = Counter(words[i] for i in miss)
                sym = d.symbol[at] if len(d.symbol) else np.zeros(len(at), np.int32)
                sym[miss] = [SYMBOLS + ending_class(words[i]) for i in miss]
                hit = at[at >= 0]
                logs = d.log[hit]
                rows.append((len(words), len(hit), float(logs.sum()), float(logs[d.symbol[hit] >= SYMBOLS].sum()), sym.astype(np.uint16).tobytes(), list(rare.keys()), list(rare.values())))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_here", "log_here", "log_class", "symbols", "rare", "rare_n"])
            yield pd.concat([b[["uid", "doc_id", "train"]].reset_index(drop=True), out], axis=1)

    schema = f"uid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, train boolean, n_tokens long, n_here long, log_here double, log_class double, symbols binary, rare array<binary>, rare_n array<long>"
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "train", "text").mapInPandas(encode, schema)


def baum_welch(rows: DataFrame, model: tuple, passes: int) -> tuple:
    """model (start, move, emit) after some passes over rows (symbols); every pass sums expected counts over all of them."""
    spark, (start, move, emit) = rows.sparkSession, model
    k, size = len(start), len(emit)
    schema = "kind int, i int, " + ", ".join(f"v{j} double" for j in range(k))
    for _ in range(passes):
        sent = spark.sparkContext.broadcast((start, move, emit))

        def expect(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                seqs = [s[i : i + CUT] for s in (np.frombuffer(x, np.uint16) for x in b["symbols"]) for i in range(0, len(s), CUT)]
                got = expected_counts(seqs, *sent.value)[:3]
                total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
            if total is not None:
                on = np.flatnonzero(total[2].sum(1))
                kind = np.repeat([0, 1, 2], [1, k, len(on)])
                yield pd.DataFrame(np.vstack([total[0], total[1], total[2][on]]), columns=[f"v{j}" for j in range(k)]).assign(kind=kind, i=np.concatenate([[0], np.arange(k), on]))[["kind", "i", *(f"v{j}" for j in range(k))]]

        sums = rows.select("symbols").mapInPandas(expect, schema).groupBy("kind", "i").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(k)]).toPandas()
        sent.unpersist()
        if not len(sums):
            break
        new = [np.zeros((1, k)), np.zeros((k, k)), np.zeros((size, k))]
        for kind, part in sums.groupby("kind"):
            new[int(kind)][part["i"].to_numpy()] = part[[f"v{j}" for j in range(k)]].to_numpy()
        start = new[0][0] + 0.1
        move = new[1] + 0.1
        share = new[2].sum(1, keepdims=True) + 0.5  # a state's counts, a little towards all states' shares
        emit = new[2] + 20 * share / share.sum() + 1e-3
        start, move, emit = start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)
    return start, move, emit


def first_guess(sample: DataFrame) -> tuple:
    """Sticky moves, and shares of symbols blurred at random, from a fixed seed."""
    rng, size = np.random.default_rng(5), SYMBOLS + CLASSES
    emit = rng.gamma(1.0, 1.0, (size, STATES)) + 0.2
    emit = emit / emit.sum(0)
    move = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
    return np.full(STATES, 1 / STATES), move, emit


def scored(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, train (boolean). Returns doc_id, train, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    python_ready(spark)
    counts = stored(token_counts(docs.where("train")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = frequent(counts, DICTIONARY)
    known = spark.sparkContext.broadcast(Dictionary(top))
    rows = stored(encoded(docs, known), "lm-encoded")

    thin = min(1.0, 4 * SAMPLE_DOCS / max(1, rows.where("train").count()))  # so that no task sorts more than a few of all rows
    mark = F.xxhash64("doc_id", "symbols")  # of the rows themselves, so that other files give the same sample
    sample = stored(rows.where(F.col("train") & (F.pmod(mark, F.lit(1 << 20)) < int(thin * (1 << 20)) + 1)).orderBy(mark).limit(SAMPLE_DOCS).select("symbols").repartition(8), "lm-sample")
    model = baum_welch(sample, first_guess(sample), SAMPLE_PASSES)
    model = baum_welch(rows.where("train"), model, FULL_PASSES)
    ending = F.crc32(F.substring("token", -3, 3)) % CLASSES
    within = counts.join(F.broadcast(spark.createDataFrame([(t,) for t, _ in top[:SYMBOLS]], "token binary")), "token", "left_anti")
    sizes = {r["c"]: r["m"] for r in within.groupBy(ending.alias("c")).agg((F.sum("n") + F.count("*") + 1).alias("m")).collect()}
    class_log = np.log10(np.array([sizes.get(c, 1) for c in range(CLASSES)], float))
    sent = spark.sparkContext.broadcast((*model, class_log))

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, move, emit, logs = sent.value
        for b in batches:
            seqs = [np.frombuffer(x, np.uint16).astype(np.int32) for x in b["symbols"]]
            like = log_likelihood(seqs, start, move, emit) / np.log(10)
            inside = [float(logs[s[s >= SYMBOLS] - SYMBOLS].sum()) for s in seqs]
            yield b.drop(columns="symbols").assign(like=like - inside)

    told = rows.select("uid", "doc_id", "train", "n_tokens", "n_here", "log_here", "log_class", "symbols")
    told = told.mapInPandas(forward, told.drop("symbols").withColumn("like", F.lit(0.0)).schema)
    rare = rows.where(F.size("rare") > 0).select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("uid", F.col("r.rare").alias("token"), F.col("r.rare_n").alias("k"))
    least = top[-1][1] if top else 1 << 62  # the dictionary holds all tokens of this count or more
    met = rare.join(counts.where(F.col("n") < least), "token", "left")
    c = F.coalesce("n", F.lit(0))
    met = met.groupBy("uid").agg(F.sum(F.col("k") * F.log10(c + 1)).alias("log_rare"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("n_rare"))
    here = lambda name: F.coalesce(F.col(name), F.lit(0))
    return told.join(met, "uid", "left").select(
        "doc_id", "train", "n_tokens", (F.col("n_here") + here("n_rare")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_here") + here("log_rare") - F.col("n_tokens") * F.lit(float(np.log10(float(total + distinct + 1))))).alias("base_score"),
        (F.col("like") + F.col("log_class") + here("log_rare")).alias("score"),
    )
