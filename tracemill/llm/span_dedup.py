"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (end marks with what follows them up to white space, end marks of scripts without blanks, or line
breaks). From every sentence, and to every sentence, goes the shortest run that has `several` sentences, or `few` sentences with
`min_words` words in all (so that a passage of long sentences is seen too); pieces without words (rulers, table bars) are passed over and do not count. Runs are hashed by their lower-cased words and joined over all documents; a run is repeated if another document holds it, or the same
document holds it earlier. Sentences covered by a repeated run are removed, except in the document of the smallest id that
holds the run, where its first occurrence stays.

Defined cases: null and empty texts have no sentences; runs that reach the end of a text too short are no runs; repeated rows (one
doc_id, one text) are cut alike; texts of one doc_id keep each other's runs; rows without doc_id are left alone; an empty table gives an empty result; further columns are passed through.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, stored

_SENTENCE = re.compile(r".*?(?:[.!?…؟۔।॥։።]+[^\w\s]*(?=\s|$)|[。！？｡]+[^\w\s]*|\n|$)\s*", re.S)
_WORD = re.compile(r"\w+")
RUN_SCHEMA = "doc_id long, rid long, pos int, n int, first boolean, h1 long, h2 long"


def sentences(text: str | None) -> list[str]:
    """Pieces that add up to the text."""
    return [s for s in _SENTENCE.findall(text) if s] if text else []


def runs(pieces: list[str], several: int, few: int, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, pieces, key) of the shortest long enough run from each sentence and to each sentence, by start.

    Pieces without words are no sentences: runs pass over them, so runs of different starts never stand for the same words."""
    words = [_WORD.findall(s.lower()) for s in pieces]
    at = [i for i, w in enumerate(words) if w]
    keys, counts = [" ".join(words[i]) for i in at], [len(words[i]) for i in at]
    upto = [0, *itertools.accumulate(counts)]
    found = set()
    for i in range(len(at)):
        forward = (n for n in range(few, several + 1) if i + n <= len(at) and (n == several or upto[i + n] - upto[i] >= min_words))
        backward = (n for n in range(few, several + 1) if i + 1 - n >= 0 and (n == several or upto[i + 1] - upto[i + 1 - n] >= min_words))
        if n := next(forward, 0):
            found.add((i, i + n))
        if n := next(backward, 0):
            found.add((i + 1 - n, i + 1))
    return [(at[i], at[j - 1] - at[i] + 1, " ".join(keys[i:j]).encode("utf-8", "replace")) for i, j in sorted(found)]


def all_runs(docs: DataFrame, several: int, few: int, min_words: int) -> DataFrame:
    """RUN_SCHEMA: rid tells apart texts of the same doc_id; first: not seen earlier in the same text."""

    def run(batches):
        for batch in batches:
            ids, rids, texts = (batch[c].to_pylist() for c in ("doc_id", "rid", "text"))
            col: list[list] = [[] for _ in range(5)]
            digests = []
            for doc, rid, text in zip(ids, rids, texts, strict=True):
                seen = set()
                for start, n, key in runs(sentences(text), several, few, min_words):
                    digest = hashlib.blake2b(key, digest_size=16).digest()
                    for c, v in zip(col, (doc, rid, start, n, digest not in seen), strict=True):
                        c.append(v)
                    seen.add(digest)
                    digests.append(digest)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            arrays = [pa.array(c, k) for c, k in zip(col, kinds, strict=True)] + [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "rid", "pos", "n", "first", "h1", "h2"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "text")
    return rows.mapInArrow(run, RUN_SCHEMA)


def repeated_runs(docs: DataFrame, several: int = 5, few: int = 2, min_words: int = 20) -> DataFrame:
    """doc_id, rid, spans (array of start, n), first_docs: the runs of each document that are to go."""
    found = stored(all_runs(docs, several, few, min_words), "span-runs")
    held = found.where("first").groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last")
    held = stored(held.select("h1", "h2", "keeper"), "span-repeated")
    others = found.where("first").join(held, ["h1", "h2"]).where("doc_id > keeper").select("doc_id", "rid", "pos", "n", "keeper")
    again = found.where("not first").select("doc_id", "rid", "pos", "n", F.col("doc_id").alias("keeper"))
    gone = stored(others.unionByName(again), "span-gone")
    return gone.groupBy("doc_id", "rid").agg(F.collect_list(F.struct(F.col("pos").alias("start"), "n")).alias("spans"), F.array_sort(F.collect_set("keeper")).alias("first_docs"))


def without_repeats(docs: DataFrame, several: int = 5, few: int = 2, min_words: int = 20, only_changed: bool = False) -> DataFrame:
    """docs with kept_text, n_sentences, n_removed and first_docs (who keeps what was removed); only_changed leaves out the others."""
    python_ready(docs.sparkSession)
    gone = stored(repeated_runs(docs, several, few, min_words), "span-docs")
    side = gone.select(F.col("doc_id").alias("__tm_doc"), F.col("rid").alias("__tm_rid"), F.col("spans").alias("__tm_spans"), F.col("first_docs").alias("__tm_first"))
    met = docs.join(side, (F.col("doc_id") == F.col("__tm_doc")) & (F.xxhash64("text") == F.col("__tm_rid")), "inner" if only_changed else "left")

    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in parts:
            rows = []
            for text, gone_ in zip(texts, spans, strict=True):
                pieces = sentences(text)
                drop = {i for s in (gone_ if gone_ is not None else ()) for i in range(s["start"], s["start"] + s["n"])}
                rows.append(("".join(p for i, p in enumerate(pieces) if i not in drop) if drop else text, len(pieces), len(drop)))
            yield pd.DataFrame(rows, columns=["kept_text", "n_sentences", "n_removed"])

    done = F.pandas_udf(cut, "kept_text string, n_sentences long, n_removed long")
    made = ("kept_text", "n_sentences", "n_removed", "first_docs")  # they replace columns of the same name
    out = met.withColumn("__tm_cut", done("text", "__tm_spans"))
    return out.select(*[docs[c] for c in docs.columns if c not in made], *[F.col(f"__tm_cut.{c}").alias(c) for c in made[:3]], F.col("__tm_first").alias("first_docs"))
