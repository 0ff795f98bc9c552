"""Hierarchical language identification: the family first, then linear SVMs for pairs inside the family.

Features are square roots of the shares of hashed letter 2- and 3-grams of the whole text (unit length).
Every decision is a squared-hinge linear support vector machine: one for each pair of families, then one
for each pair of languages of a family. All are fitted side by side, one Spark group a pair, on a bounded
sample: at most SAMPLE_PER_LANG texts a language (each also as a short excerpt, so that short texts are learned).

Defined cases: a null text or one without a letter is `und` with score 0; without any labelled text
everything is `und`; with one label only, that label has score 1; rows without lang are not learned from;
repeated rows are predicted alike; further columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, stored

#: Bound on the texts of a language that the classifiers are fitted on.
SAMPLE_PER_LANG = 1024
DIM = 2048
RIDGE = 1e-4
#: Turns an SVM margin into a share between 0 and 1.
SLOPE = 3.0

#: ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tr tk uz",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "sino-tibetan": "my zh",
    "austronesian": "id jv mg ms tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


_IS_LETTER: list[np.ndarray] = []


def features(text: str) -> np.ndarray:
    """The unit-length vector of a text's hashed letter 2- and 3-grams, and 1 for the bias; other characters part words."""
    if not _IS_LETTER:
        _IS_LETTER.append(_letters())
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = np.where(code < 0x10000, _IS_LETTER[0][np.minimum(code, 0xFFFF)], True)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    keep[0] = True
    code = np.where(letter, code, np.uint32(32))[keep]
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F)
    gram = np.concatenate([two, three])
    counts = np.bincount(((gram ^ (gram >> np.uint32(16))) * np.uint32(0x7FEB352D)) >> np.uint32(32 - 11), minlength=DIM)
    return np.append(np.sqrt(counts / max(1, counts.sum())), 1).astype(np.float32)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 12) -> np.ndarray:
    """Weights of a squared-hinge linear SVM, by Newton steps with conjugate gradients; x is never copied."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = share * (slack > 0)
        grad = ridge * w - 2 * (x.T @ (on * y * slack))
        if np.linalg.norm(grad) < 1e-5:
            break
        step, r = np.zeros_like(w), -grad
        p, rr = r.copy(), float(r @ r)
        for _ in range(30):
            hp = ridge * p + 2 * (x.T @ (on * (x @ p)))
            alpha = rr / max(float(p @ hp), 1e-30)
            step, r = step + alpha * p, r - alpha * hp
            new = float(r @ r)
            if new < 1e-4 * float(grad @ grad):
                break
            p, rr = r + new / rr * p, new
        w = w + step
    return w


def excerpt(text: str) -> str:
    """A few words from the middle."""
    words = text.split()
    at, n = len(words) // 3, 2 + len(words) % 7
    return " ".join(words[at : at + n]) or text


def share_of(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-SLOPE * margins))


class Model:
    """The fitted pairs; small (pairs * DIM numbers) and sent to every task."""

    def __init__(self, pairs: list[tuple[str, str, str]], weights: np.ndarray, langs: list[str]):
        self.pairs, self.weights, self.langs = pairs, weights, langs

    def _among(self, names: list[str], group: str, margins: np.ndarray) -> np.ndarray:
        """Shares (rows, names): how clearly each name wins its pairs."""
        votes = np.zeros((len(margins), len(names)))
        for k, (g, a, b) in enumerate(self.pairs):
            if g == group:
                p = share_of(margins[:, k])
                votes[:, names.index(a)] += p
                votes[:, names.index(b)] += 1 - p
        return votes / max(1, len(names) - 1) if len(names) > 1 else np.ones((len(margins), 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margins = x @ self.weights.T if len(self.pairs) else np.zeros((len(x), 0))
        families = sorted({FAMILY_OF.get(c, c) for c in self.langs})
        shares = self._among(families, "", margins)
        best = shares.argmax(1)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for f, family in enumerate(families):
            at = np.flatnonzero(best == f)
            names = [c for c in self.langs if FAMILY_OF.get(c, c) == family]
            inside = self._among(names, family, margins[at])
            lang[at] = np.array(names, object)[inside.argmax(1)]
            score[at] = shares[at, f] * inside.max(1, initial=0)
        return lang, np.clip(score, 0, 1)


def train(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """labelled: text, lang. Fits on at most sample_per_lang texts a language, chosen by a hash of the text."""
    python_ready(labelled.sparkSession)
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("text").alias("h"))
    # about four times as many different texts as wanted pass a bound on the hash; copies are one text
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    share = {r["lang"]: min(1.0, 4 * sample_per_lang / max(1, r["n"])) for r in sizes}
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(v * (1 << 30)))) for k, v in share.items()]) if share else F.lit(0)
    thin = known.where(F.pmod(F.col("h"), F.lit(1 << 30)) < bound).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    sample = thin.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_per_lang).select("lang", "text")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": np.repeat(b["lang"].to_numpy(object), 2), "x": [features(v).tobytes() for t in b["text"] for v in (t, excerpt(t))]})

    rows = stored(sample.mapInPandas(featured, "lang string, x binary"), "lang-sample")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    families = sorted({FAMILY_OF.get(c, c) for c in langs})
    pairs = [("", a, b) for a, b in combinations(families, 2)]
    pairs += [(f, a, b) for f in families for a, b in combinations([c for c in langs if FAMILY_OF.get(c, c) == f], 2)]
    if not pairs:
        return Model([], np.zeros((0, DIM + 1), np.float32), langs)
    sides = [(k, c, 1.0 if name == a else -1.0) for k, (g, a, b) in enumerate(pairs) for c in langs for name in ((FAMILY_OF.get(c, c),) if g == "" else (c,)) if name in (a, b)]
    problem = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c"), F.lit(y).alias("y")) for k, c, y in sides]))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group["x"]), np.float32).reshape(len(group), DIM + 1)
        return pd.DataFrame({"k": [int(group["k"].iloc[0])], "w": [fitted(x, group["y"].to_numpy(np.float32)).tobytes()]})

    dealt = rows.select("lang", "x", problem.alias("p")).where("p.c = lang").select("p.k", "p.y", "x")
    got = {r["k"]: np.frombuffer(r["w"], np.float32) for r in dealt.groupBy("k").applyInPandas(fit, "k int, w binary").collect()}
    return Model(pairs, np.stack([got[k] for k in range(len(pairs))]), langs)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, from the whole text alone."""
    spark = docs.sparkSession
    python_ready(spark)
    out = docs.withColumn("__tm_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if not model.langs:
        return out.drop("__tm_letter").withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    sent = spark.sparkContext.broadcast(model)

    def guess(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, letter in batches:
            lang, score = np.full(len(text), "und", object), np.zeros(len(text))
            at = np.flatnonzero(letter.to_numpy(bool))
            for part in np.array_split(at, len(at) // 256 + 1):
                if len(part):
                    lang[part], score[part] = sent.value.predict(np.stack([features(text.iloc[i]) for i in part]))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    said = F.pandas_udf(guess, "lang_pred string, score double")
    return out.withColumn("__tm_said", said("text", "__tm_letter")).withColumn("lang_pred", F.col("__tm_said.lang_pred")).withColumn("score", F.col("__tm_said.score")).drop("__tm_letter", "__tm_said")
