"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its sequence of lower-cased words. Its k-mers (five words) are labelled with their occurrence number; each
of SKETCHES permutations picks the two smallest and keeps them in text order, so that a shared sketch value says
that both the words and their order agree. Texts with a sketch value in common are candidates; they are linked
if the word edit distance is at most (1 - similarity) of the longer one. Before their texts are fetched and aligned, candidates
must pass a bound that no edit distance undercuts: the words counted in BINS bins by hash, where one edit lowers the surplus of
either side by one at most. Classes are the connected components.

Exact copies (equal word sequences) are one text from the start. A bucket's members are first compared with one
leader each, the text of the bucket whose own buckets hold most others (of a group of near copies, their original), then with both ends of
every bucket that still holds two components. A group of thousands of copies costs one alignment a copy. What is still apart then (texts
that share one common passage, say) goes by an exact bound instead of all pairs of a bucket: a word edit changes two word pairs at most, so
texts of similarity 0.8 have one of the rarest 0.4 n + 1 of their word pairs in common, and passages that many texts share are not
among the rarest. Texts meet in these pairs of words, those of a pair's largest component with others only; where very many meet in one, they
meet in their rarest 0.2 n + 1 words instead (an edit changes one word at most).

Defined cases: null, empty or word-less texts are classes of their own; texts under five words are linked to equal
ones only (as are any that have no two five-word runs in common); rows of one doc_id are one document; rows without doc_id have a null class; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import aligned_within
from .common import forget, python_ready, stored
from .graph import components

SKETCHES, KMER = 64, 5
#: Bins of the word counts; a bin holds 255 at most, which only loosens the bound.
BINS = 256
#: A word pair among the rarest of more texts than this is crowded: its texts meet in their rarest words instead.
CROWD = 32
#: So many rarer grams stand beside each, to tell whether two texts have met before (words only).
LOOK_BACK = 64
#: Pair lists of up to so many rows are sent to the tasks instead of shuffling all texts.
BROADCAST_PAIRS = 500_000
#: So are other tables of up to so many rows of a few numbers each, with a shuffle join beyond.
BROADCAST_ROWS = 1_000_000
#: And word counts (BINS bytes a row) of up to so many rows.
BROADCAST_COUNTS = 250_000
_WORD = re.compile(r"\w+")
_rng = np.random.default_rng(23)
_XOR = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHash(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sketch(words: np.ndarray) -> np.ndarray:
    """The SKETCHES Order MinHash values of a sequence of word hashes; none if it is shorter than a k-mer."""
    n = len(words) - KMER + 1
    if n < 1:
        return np.zeros(0, np.int64)
    kmer = words[:n].copy()
    for i in range(1, KMER):
        kmer = mixed(kmer) + words[i : i + n]
    order = np.argsort(kmer, kind="stable")
    same = np.concatenate([[False], kmer[order][1:] == kmer[order][:-1]])
    if same.any():  # the i-th occurrence of a k-mer is a k-mer of its own
        run = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        label = np.empty(n, np.uint64)
        label[order] = run
        kmer = kmer + mixed(label * np.uint64(0xC2B2AE3D27D4EB4F))
    out = np.empty(SKETCHES, np.uint64)
    rows = max(1, (1 << 17) // n)
    for at in range(0, SKETCHES, rows):
        part = slice(at, min(SKETCHES, at + rows))
        value = (kmer[None, :] ^ _XOR[part, None]) * _MUL[part, None]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0x9E3779B97F4A7C15)
        line = np.arange(len(value))
        one = value.argmin(1)
        if n > 1:
            value[line, one] = np.uint64(0xFFFFFFFFFFFFFFFF)
            two = value.argmin(1)
        else:
            two = one
        first, second = np.minimum(one, two), np.maximum(one, two)
        out[part] = mixed(mixed(kmer[first]) * np.uint64(3) + kmer[second]) + _XOR[part]
    return mixed(out).view(np.int64)


def binned(words: np.ndarray) -> bytes:
    """How many of the word hashes fall in each bin."""
    return np.minimum(np.bincount((words % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distances of texts whose counts are the rows of x and y."""
    more = x.astype(np.int32) - y
    return np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (of the word sequence; null without words), n_words, counts (a byte for each bin), sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        for b in batches:
            rows = []
            for text in b["text"]:
                ws = _WORD.findall(text.lower()) if text else []
                h = np.array([cache[w] for w in ws], np.uint64)
                d = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64) if ws else (None, None)
                rows.append((*d, len(ws), binned(h), sketch(h)))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["h1", "h2", "n_words", "counts", "sketch"]).astype({"h1": "Int64", "h2": "Int64"})], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, h1 long, h2 long, n_words int, counts binary, sketch array<long>")


def plausible(pairs: DataFrame, counts: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) that the counts (doc, n, counts) do not rule out; unknown counts rule out nothing."""
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_COUNTS else counts
    met = pairs.join(counts.select(F.col("doc").alias("a"), F.col("n").alias("an"), F.col("counts").alias("x")), "a")
    met = met.join(counts.select(F.col("doc").alias("b"), F.col("n").alias("bn"), F.col("counts").alias("y")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = bytes(BINS)
        for b in batches:
            known = (b["x"].notna() & b["y"].notna()).to_numpy()
            x, y = (np.frombuffer(b"".join(v if k else nothing for v, k in zip(b[c], known, strict=True)), np.uint8).reshape(-1, BINS) for c in ("x", "y"))
            most = ((1 - similarity) * np.maximum(b["an"], b["bn"]) + 1e-9).astype(int).to_numpy()
            yield b.loc[apart(x, y) <= most, ["a", "b"]]

    return met.select("a", "b", "an", "bn", "x", "y").mapInPandas(check, pairs.schema)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose texts (doc_id, text) align well enough."""
    n, sides = pairs.count(), pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    if n == 0:
        return pairs
    met = texts.join(F.broadcast(sides) if n <= BROADCAST_PAIRS else sides, "doc_id")
    both = met.groupBy("a", "b").agg(F.max(F.when(F.col("doc_id") == F.col("a"), F.col("text"))).alias("x"), F.max(F.when(F.col("doc_id") == F.col("b"), F.col("text"))).alias("y"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"], strict=True):
                p, q = (_WORD.findall((t or "").lower()) for t in (x, y))
                keep.append(aligned_within(p, q, int((1 - similarity) * max(len(p), len(q)) + 1e-9)))
            yield b.loc[keep, ["a", "b"]]

    return both.mapInPandas(check, pairs.schema)


def _small(df: DataFrame) -> DataFrame:
    """df, marked to be sent to the tasks if it is a stored table of few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class _Linking:
    """Labels of texts (doc, comp), refined by rounds of verified pairs."""

    def __init__(self, counts: DataFrame, texts: DataFrame, similarity: float):
        self.counts, self.labels = counts, stored(counts.select("doc", F.col("doc").alias("comp")), "near-labels")
        self.texts, self.similarity, self.tried, self.links = texts, similarity, None, None

    def round(self, pairs: DataFrame) -> None:
        """pairs: a, b, of like length."""
        todo = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            todo = todo.join(self.tried, ["a", "b"], "left_anti")
        todo = stored(todo, "near-pairs")
        self.tried = todo if self.tried is None else self.tried.unionByName(todo)
        close = stored(plausible(todo, self.counts, self.similarity), "near-close")
        links = stored(verified(close, self.texts, self.similarity), "near-links")
        self.links = links if self.links is None else self.links.unionByName(links)
        labels = _small(self.labels)
        ends = links.join(labels.select(F.col("doc").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("doc").alias("b"), F.col("comp").alias("cb")), "b")
        roots = stored(components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("comp", "root"), "near-roots")
        self.labels = stored(self.labels.join(_small(roots), F.col("comp") == F.col("node"), "left").select("doc", F.coalesce("root", "comp").alias("comp")), "near-labels")

    def open(self, rows: DataFrame) -> DataFrame:
        """rows (bucket, doc) with comp and size, of the buckets where components still differ."""
        rows = rows.join(_small(self.labels), "doc")
        held = rows.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).where("c0 <> c1")
        return stored(rows.join(_small(stored(held.select("bucket", "size"), "near-open")), "bucket"), "near-open-rows")


def _ends(rows: DataFrame) -> DataFrame:
    """bucket, lo, hi: the buckets (bucket, doc, n, weight and perhaps comp) of two documents or more, their heaviest document and the lightest one
    (doc, n and comp each)."""
    own = [c for c in ("doc", "n", "comp") if c in rows.columns]
    end = F.struct("weight", (-F.col("doc")).alias("later"), *own)
    ends = rows.groupBy("bucket").agg(F.max(end).alias("lo"), F.min(end).alias("hi")).where("lo.doc <> hi.doc")
    return ends.select("bucket", *[F.struct(*[f"{c}.{x}" for x in own]).alias(c) for c in ("lo", "hi")])


def _stars(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: each row of a bucket with the bucket's ends of like length and of another component."""
    met = rows.select("bucket", "doc", "n", "comp").join(_small(stored(_ends(rows), "near-ends")), "bucket")
    others = F.filter(F.array("lo", "hi"), lambda e: (e["comp"] != F.col("comp")) & (F.least(e["n"], "n") >= similarity * F.greatest(e["n"], "n")))
    met = met.select(F.col("doc").alias("a"), F.col("n").alias("an"), F.explode(others).alias("e"))
    return _alike(met.select("a", F.col("e.doc").alias("b"), "an", F.col("e.n").alias("bn")), similarity)


def _alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """a, b: those of pairs (a, b, an, bn) of like length."""
    return pairs.where(F.least("an", "bn") >= similarity * F.greatest("an", "bn")).select("a", "b")


def near_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, class_id (the smallest doc_id of the class), n_words, n_links (verified links of the text to others)."""
    python_ready(docs.sparkSession)
    all_rows = stored(sketched(docs), "near-sketches")
    named = all_rows.where("doc_id is not null and h1 is not null")
    firsts = stored(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc")), "near-texts")
    reps = named.join(_small(firsts), ["h1", "h2"]).where("doc = doc_id").select("doc", F.col("n_words").alias("n"), "counts", "sketch")
    members = reps.select("doc", "n", F.explode("sketch").alias("bucket"))
    buckets = stored(members.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1"), "near-buckets")
    shared = stored(members.join(_small(buckets), "bucket"), "near-members")  # only buckets of two or more
    weights = stored(shared.groupBy("doc").agg(F.sum("held").alias("weight")), "near-weights")
    shared = stored(shared.select("bucket", "doc", "n").join(_small(weights), "doc"), "near-weighed")
    one = F.when(F.min("counts") == F.max("counts"), F.max("counts"))  # unknown for a doc_id with several texts
    counts = reps.join(_small(stored(shared.select("doc").distinct(), "near-docs")), "doc", "left_semi").groupBy("doc").agg(F.max("n").alias("n"), one.alias("counts"))
    counts = stored(counts, "near-counts")
    linking = _Linking(counts, docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), similarity)

    # each text against the leader with which it shares most buckets
    led = shared.join(_small(stored(_ends(shared).select("bucket", "lo"), "near-leaders")), "bucket").where("doc <> lo.doc")
    votes = led.groupBy("doc", "n", "lo").agg(F.count("*").alias("votes"))
    best = votes.groupBy(F.col("doc").alias("a"), F.col("n").alias("an")).agg(F.max_by("lo", F.struct("votes", -F.col("lo.doc"))).alias("b"))
    linking.round(_alike(best.select("a", F.col("b.doc").alias("b"), "an", F.col("b.n").alias("bn")), similarity))
    # then against both ends of every bucket that still holds different components
    rows = linking.open(shared)
    linking.round(_stars(rows, similarity))
    # then all that is left by its rarest word pairs
    left = stored(linking.open(rows.select("bucket", "doc")).select("doc", "comp").distinct(), "near-left")
    if not left.isEmpty():
        _by_rare_grams(linking, left, similarity)

    degree = linking.links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n_links"))
    found = firsts.join(_small(linking.labels), "doc", "left").join(_small(stored(degree, "near-degrees")), "doc", "left")
    found = stored(found.select("h1", "h2", F.coalesce("comp", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "near-classes")
    out = all_rows.select("doc_id", "h1", "h2", "n_words").join(_small(found), ["h1", "h2"], "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", mine.alias("class_id"), "n_words", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """The runs of `size` (1 or 2) words of a text's word hashes, hashed; the i-th occurrence is a gram of its own."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    gram, at = np.sort(words if size == 1 else mixed(words[:-1]) + words[1:]), np.arange(len(words) - size + 1)
    nth = at - np.maximum.accumulate(np.where(np.concatenate([[True], gram[1:] != gram[:-1]]), at, 0))
    return mixed(gram + mixed(nth.astype(np.uint64)))


def _rarest(texts: DataFrame, left: DataFrame, size: int, similarity: float) -> DataFrame:
    """gram, doc, n, earlier (rarer ones), comp: of each text of left (doc, comp), those of its rarest grams that others have too.

    An edit changes `size` grams at most, so similar texts have all but size (1 - similarity) n of the longer one's grams in common, and in any
    order of all grams their first size (1 - similarity) n + 1 meet. Grams of one text only come first; they are counted, not sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                h = np.array([cache[w] for w in _WORD.findall(text.lower())] if text else [], np.uint64)
                yield pd.DataFrame({"doc": doc, "n": len(h), "gram": grams(h, size).view(np.int64)})

    kind = texts.schema["doc_id"].dataType.simpleString()
    some = texts.join(_small(left.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi").select("doc_id", "text")
    every = stored(some.mapInPandas(run, f"doc {kind}, n int, gram long"), "near-grams")
    often = stored(every.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "near-frequent")
    own = Window.partitionBy("doc", "n")
    w = own.orderBy("df", "gram")
    alone = F.col("n") - (size - 1) - F.count("*").over(own)
    earlier = F.collect_list("gram").over(w.rowsBetween(-LOOK_BACK, -1)) if size == 1 else F.array().cast("array<long>")
    first = every.join(often, "gram").withColumns({"rank": alone + F.row_number().over(w), "earlier": earlier}).where(F.col("rank") <= size * (1 - similarity) * F.col("n") + 1 + 1e-9)
    out = stored(first.select("gram", "doc", "n", "earlier").join(_small(left), "doc"), "near-rare")
    for df in (every, often):
        forget(df)
    return out


def _met(rare: DataFrame, similarity: float) -> DataFrame:
    """a, b: texts of different components and of like length that meet in a gram, the first they share (as far as LOOK_BACK sees). Of a gram's
    texts only those outside its most frequent component ask."""
    held = rare.groupBy("gram", "comp").agg(F.count("*").alias("held")).groupBy("gram")
    most = held.agg(F.max_by("comp", F.struct("held", -F.col("comp"))).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    asks = stored(rare.join(most, "gram").where("comp <> most").select("gram", F.col("doc").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("an"), F.col("earlier").alias("ea"), "most"), "near-asking")
    answers = rare.select("gram", F.col("doc").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("bn"), F.col("earlier").alias("eb"))
    return answers.join(asks, "gram").where(~F.arrays_overlap("ea", "eb") & (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("most")) | (F.col("a") < F.col("b"))) & (F.least("an", "bn") >= similarity * F.greatest("an", "bn"))).select("a", "b")


def _crowded(rare: DataFrame) -> DataFrame:
    """gram, b, bn, cb: of the grams that more than CROWD texts of several components hold, the shortest text (doc, n, comp)."""
    held = rare.groupBy("gram").agg(F.count("*").alias("held"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct("n", "doc", "comp")).alias("s"))
    return held.where((F.col("held") > CROWD) & (F.col("c0") != F.col("c1"))).select("gram", F.col("s.doc").alias("b"), F.col("s.n").alias("bn"), F.col("s.comp").alias("cb"))


def _shortest(crowd: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """a, b: of each gram's texts (gram, doc, n, comp, b, bn, cb), those of like length outside the shortest one's component, then and by the labels
    of now, with the shortest one."""
    labels = _small(labels)
    pairs = crowd.where((F.col("comp") != F.col("cb")) & (F.col("bn") >= similarity * F.col("n"))).select(F.col("doc").alias("a"), "b").distinct()
    now = pairs.join(labels.select(F.col("doc").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("doc").alias("b"), F.col("comp").alias("cb")), "b")
    return now.where("ca <> cb").select("a", "b")


def _by_rare_grams(linking: _Linking, left: DataFrame, similarity: float) -> None:
    """Links what may be similar among the texts of left (doc, comp). Texts meet in their rarest word pairs. Those that meet in a crowded one (a
    passage that makes up most of many texts) are compared with the shortest text there, which is most of the passage alone; what is still
    apart must have one of its rarest words in common as well, and meets in that instead. Each row is marked once with what its gram is."""
    rare = _rarest(linking.texts, left, 2, similarity)
    marked = stored(rare.join(_small(stored(_crowded(rare), "near-crowded")), "gram", "left"), "near-marked")
    forget(rare)
    linking.round(_met(marked.where("b is null").drop("b", "bn", "cb"), similarity))
    crowd = marked.where("b is not null")
    if crowd.isEmpty():
        return
    linking.round(_shortest(crowd, linking.labels, similarity))
    many = stored(crowd.select("doc").distinct().join(_small(linking.labels), "doc"), "near-crowd")
    linking.round(_met(_rarest(linking.texts, many, 1, similarity), similarity))
