"""The pipeline against plain Python, stage by stage in effect."""

import random
import re

from test_text_operators import lines_by_hand, prose, targets_by_hand

import corpus_pipeline
from tracemill.llm.align import plain_distance


def by_hand(rows, items):
    """Documents (doc_id, source, text) that reach the mix."""
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[2] or "")]
    kept = lines_by_hand([(d, t) for d, _, t in rows])
    rows = [(d, s, kept[d][2]) for d, s, t in rows if kept[d][1] == 0 or kept[d][2].strip()]
    words = {d: re.findall(r"\w+", t.lower()) for d, _, t in rows}
    first, out = {d: d for d, _, _ in rows}, []

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for a in words:
        for b in words:
            n = max(len(words[a]), len(words[b]))
            if a < b and min(len(words[a]), len(words[b])) >= 0.8 * n and plain_distance(words[a], words[b]) <= 0.2 * n + 1e-9:
                first[max(find(a), find(b))] = min(find(a), find(b))
    for d, s, t in rows:
        joined = " ".join(words[d])
        if find(d) == d and not any(" ".join(re.findall(r"\w+", i.lower())) in joined for i in items):
            out.append((d, s, t))
    return out


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    items = [prose(rng, 30) for _ in range(3)]
    rows, shared = [], "a line that many documents hold"
    for i in range(90):
        text = prose(rng, rng.randint(25, 60))
        if i % 9 == 1:
            text = " ".join(w if rng.random() > 0.04 else "other" for w in rows[-1][2].split("\n")[-1].split())
        if i % 9 == 3:
            text += " " + items[i % 3] + " " + prose(rng, 5)
        if i % 9 == 5:
            text = shared + "\n" + text
        rows.append((i, ["b", "a", None, "c"][i % 4], text))
    rows += [(90, "a", None), (91, "a", "123 456"), (92, "b", shared), (93, "c", rows[0][2]), (94, "a", f"{shared}\n\n\t\n{shared}")]
    docs = spark.createDataFrame([(d, t, None if d % 7 == 0 else ("en" if d % 2 else "de"), s, len(t or "")) for d, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
        left = spark.createDataFrame(left.collect(), docs.schema)
    want = by_hand(rows, items)
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted((d, t) for d, _, t in want)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes, size_of = {}, {d: len(t.split()) for d, _, t in want}
    for d, s, _ in want:
        sizes[s] = sizes.get(s, 0) + size_of[d]
    targets = targets_by_hand(sizes)
    assert {r["doc_id"] for r in got} <= set(size_of) and all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * size_of[r["doc_id"]] for r in got)
    for s in sizes:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - targets[s]) <= 60
