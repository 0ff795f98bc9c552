"""Benchmark decontamination by the CGK embedding and bit-sampling LSH, with exact edit verification.

Texts are word sequences (lower-cased runs of word characters). The CGK random walk reads a sequence and writes
another: at each step it writes the current word and moves on if that word's random bit for the step is set. Few
edits between two sequences become few differing positions of what is written, so sampled positions agree
often. Benchmark items are embedded once by several independent walks, with several samples of BITS positions
each; the windows of a document that start at any word and are as long as the items of a length class are
embedded likewise, and those that share a sample with an item are candidates. A match is an item whose word edit
distance to some part of the text is at most (1 - similarity) of its length.

Before a window is embedded it has to hold as many word pairs of the benchmark as so few edits must leave
(the q-gram lemma, q = 2): that loses no match. Items go to the tasks in blocks of at most BLOCK_WORDS words;
a larger benchmark takes further passes over the documents, one block at a time.

Defined cases: null or empty texts match nothing; items under min_words words take no part; equal items are
found each; repeated documents are found each; of equally near places in a text the first counts; an empty benchmark or table finds
nothing; further columns are passed through, but for one named leaks, which is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, stored

BLOCK_WORDS = 1 << 20
WALKS, SAMPLES, BITS = 10, 4, 3
LEAK = "array<struct<item_id:long,start_word:int,n_words:int,edits:int,similarity:double>>"
_WORD = re.compile(r"\w+")
_CHUNK = 1 << 20


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def embedded(ids: np.ndarray, at: np.ndarray, bits: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """(len(at), len(wanted)): what a CGK walk from each start writes at the wanted steps. bits: steps by 256 words."""
    out, i, k, last = np.empty((len(at), len(wanted)), np.int64), at.copy(), 0, len(ids) - 1
    for step in range(int(wanted[-1]) + 1):
        word = ids[np.minimum(i, last)]
        if wanted[k] == step:
            out[:, k] = word
            k += 1
        i += bits[step, word & 255]
    return out


def best_part(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the part of text that is nearest to item; the shortest one that ends first."""

    def last_row(a, b, free: bool):
        index = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else index.copy()
        for i, w in enumerate(a):
            new = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + (b != w)]))
            row = np.minimum.accumulate(new - index) + index
        return row

    ends = last_row(item, text, True)
    end = int(ends.argmin())
    starts = last_row(item[::-1], text[:end][::-1], False)
    return int(ends[end]), end - int(starts.argmin()), end


class Block:
    """Some items, ready to be looked for. seed fixes the walks."""

    def __init__(self, items: list[tuple[int, list[str]]], similarity: float, seed: int = 17):
        self.similarity, self.ids = similarity, [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
        self.pairs = np.zeros(1 << 22, bool)
        for x in self.items:
            self.pairs[self._pair(x[:-1], x[1:])] = True
        by_class = defaultdict(list)
        for k, x in enumerate(self.items):
            by_class[int(np.log(len(x)) / np.log(1.2))].append(k)
        rng, self.classes = np.random.default_rng(seed), []
        for _, members in sorted(by_class.items()):
            low, high = (f(len(self.items[k]) for k in members) for f in (min, max))
            walks = []
            for _ in range(WALKS):
                steps = max(BITS, int(1.7 * low))
                bits = rng.integers(0, 2, (steps, 256))
                samples = [np.sort(rng.choice(steps, BITS, replace=False)) for _ in range(SAMPLES)]
                wanted = np.unique(np.concatenate(samples))
                found = defaultdict(list)
                for k in members:
                    padded = np.concatenate([self.items[k], np.full(steps, -1)])
                    wrote = embedded(padded, np.zeros(1, np.int64), bits, wanted)
                    for s, sample in enumerate(samples):
                        found[int(self._key(wrote[:, np.searchsorted(wanted, sample)], s)[0])].append(k)
                keys = np.array(sorted(found), np.int64)
                walks.append((bits, samples, wanted, keys, [found[int(x)] for x in keys]))
            lengths = [len(self.items[k]) for k in members]
            least = min(n - 1 - 2 * self.allowed(n) for n in lengths)  # falls where allowed() steps up, so not always that of low
            self.classes.append((low, high + self.allowed(high), max(1, least), walks))
        self.least = min((c[2] for c in self.classes), default=0)

    def allowed(self, n: int) -> int:
        return int((1 - self.similarity) * n + 1e-9)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & (len(self.pairs) - 1)

    @staticmethod
    def _key(wrote: np.ndarray, salt: int) -> np.ndarray:
        key = np.full(len(wrote), salt + 1, np.int64)
        for j in range(wrote.shape[1]):
            key = (key * 1_000_003) ^ (wrote[:, j] * 0x9E3779B1)
        return key

    def leaks(self, texts) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        part, size = [], 0
        for d, text in enumerate(texts):
            ws = words(text)
            if len(ws) > 1:
                ids = np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.int64, len(ws))
                part.append((d, ids))
                size += len(ids)
            if size > _CHUNK:
                self._search(part, out)
                part, size = [], 0
        if part:
            self._search(part, out)
        return out

    def _search(self, part: list, out: list) -> None:
        known = []
        for d, ids in part:  # most documents hold too few of the pairs to be looked at
            hit = (ids[:-1] > 0) & (ids[1:] > 0)
            hit[hit] = self.pairs[self._pair(ids[:-1][hit], ids[1:][hit])]
            if hit.sum() >= self.least:
                known.append((d, ids, hit))
        if not known:
            return
        ids = np.concatenate([np.append(x, 0) for _, x, _ in known])
        hits = np.concatenate([[0], np.cumsum(np.concatenate([np.append(h, [False, False]) for _, _, h in known]))])
        edge = np.concatenate([[0], np.cumsum([len(x) + 1 for _, x, _ in known])])
        found = defaultdict(list)
        for low, span, least, walks in self.classes:
            start = np.arange(max(0, len(ids) - 1))
            window = hits[np.minimum(start + span, len(hits) - 1)] - hits[start]
            start = start[window >= least]
            if not len(start):
                continue
            for bits, samples, wanted, keys, items in walks:
                wrote = embedded(ids, start, bits, wanted)
                for s, sample in enumerate(samples):
                    key = self._key(wrote[:, np.searchsorted(wanted, sample)], s)
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    for i in np.flatnonzero(keys[at] == key):
                        for k in items[at[i]]:
                            found[k, int(np.searchsorted(edge, start[i], side="right")) - 1].append(int(start[i]))
        for (k, doc), starts in found.items():
            best, item = None, self.items[k]
            most = self.allowed(len(item))
            starts = np.unique(starts)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > len(item)) + 1):
                a, b = max(edge[doc], run[0] - most), min(edge[doc + 1] - 1, run[-1] + len(item) + most)
                whole = next((int(x) for x in run if np.array_equal(ids[x : x + len(item)], item)), None)
                if whole is None and np.isin(ids[a:b], item).sum() < len(item) - most:
                    continue  # too few of its words are there
                edits, x, y = best_part(item, ids[a:b]) if whole is None else (0, whole - a, whole - a + len(item))
                if edits <= most and (best is None or edits < best[0]):
                    best = (edits, int(a + x - edge[doc]), int(y - x))
                if edits == 0:
                    break
            if best is not None:
                out[known[doc][0]].append({"item_id": self.ids[k], "start_word": best[1], "n_words": best[2], "edits": best[0], "similarity": 1 - best[0] / len(item)})


def blocks(benchmark: DataFrame, similarity: float, min_words: int, block_words: int) -> Iterator[Block]:
    """The items of item_id, text in blocks of bounded size, read one after the other."""
    part, size = [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).toLocalIterator():
        ws = words(row["text"])
        if len(ws) < min_words:
            continue
        part.append((row["item_id"], ws))
        size += len(ws)
        if size >= block_words:
            yield Block(part, similarity)
            part, size = [], 0
    if part:
        yield Block(part, similarity)


def _looker(sent):
    def look(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series(sent.value.leaks(texts.tolist()), dtype=object)

    return F.pandas_udf(look, LEAK)


def with_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, min_words: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with `leaks`: for each benchmark item found in the text, where it is nearest.

    A benchmark of one block takes one scan without a shuffle. Of a larger one, a block at a time is in the tasks: each pass writes what it
    found, and its broadcast is released before the next."""
    spark, none = docs.sparkSession, F.array().cast(LEAK)
    python_ready(spark)
    some = blocks(benchmark, similarity, min_words, block_words)
    first, second = next(some, None), next(some, None)
    if first is None:
        return docs.withColumn("leaks", none)
    if second is None:
        return docs.withColumn("leaks", F.concat(none, _looker(spark.sparkContext.broadcast(first))("text")))
    rows = stored(docs.drop("leaks").withColumn("__tm_uid", F.monotonically_increasing_id()), "leak-docs")
    found = []
    for block in chain((first, second), some):
        sent = spark.sparkContext.broadcast(block)
        found.append(stored(rows.select("__tm_uid", _looker(sent)("text").alias("leaks")).where(F.size("leaks") > 0), "leaks"))
        sent.unpersist()
    all_found = reduce(DataFrame.unionByName, found).groupBy("__tm_uid").agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    return rows.join(stored(all_found, "leaks"), "__tm_uid", "left").select(*[rows[c] for c in rows.columns if c != "__tm_uid"], F.coalesce("leaks", none).alias("leaks"))
