"""Nearest neighbours against brute force."""

import numpy as np

from tracemill.llm.neighbours import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank string"


def by_hand(ids, x, k=10):
    out = {}
    for i, q in enumerate(ids):
        if q % 100 == 0:
            s = np.sqrt(((x - x[i]) ** 2).sum(1))
            out[q] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, s)) if ids[j] != q][:k]
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in neighbours(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_recall_with_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[500:1500] = x[500]  # a third are copies
    ids = rng.permutation(3000)
    got = found(spark, [(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)])
    want = by_hand(ids, x.astype(float))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(hits) >= 9
    for q in want:
        if q in set(ids[500:1500].tolist()):
            assert got[q] == want[q]  # the smallest ids of the copies
        assert got[q] == sorted(got[q], key=lambda t: (t[1], t[0]))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (1, [0.0, 1.0], "x"), (2, [0.0, 0.0], "x"), (3, None, "x"), (4, [nan, 1.0], "x"), (5, [inf, 1.0], "x"), (6, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (7, [1.0], "x"), (100, [1.0, 0.0], "x"), (200, [0.0, 0.0], "x"), (300, [2.0], "x"), (8, [], "x"), (1, [0.0, 1.0], "x")]
    got = found(spark, rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [100, 1], 100: [0, 1], 300: [7]}
    df = spark.createDataFrame([], SCHEMA)
    assert neighbours(df, df).count() == 0
