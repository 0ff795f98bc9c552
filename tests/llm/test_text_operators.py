"""Small cases of the text operators: nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, language_id, line_dedup, lm_score, mixing, near_dedup, pii, quote_linking, span_dedup
from tracemill.llm.align import aligned_within, banded_distance, plain_distance
from tracemill.llm.cuckoo import CuckooFilter, buckets_for
from tracemill.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __doc string, h1 long"


def docs(spark, texts, lang="en", source="a"):
    rows = [(i, t, lang, source, len(t) if t is not None else None, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


WORDS = "alpha beta gamma delta rho sigma tau omega kappa lambda theta iota zeta pi phi chi psi nu mu xi".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


# -- alignment, filters, graphs --------------------------------------------------------------------


def test_banded_distance_equals_plain():
    rng = random.Random(1)
    for _ in range(800):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 22))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randrange(5)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(6))
        most = rng.randrange(9)
        true = plain_distance(a, b)
        assert banded_distance(a, b, most) == min(true, most + 1)
        assert aligned_within(a, b, most) == (true <= most)


def test_cuckoo_filter_forgets():
    import numpy as np

    rng = np.random.default_rng(0)
    h = rng.integers(-(1 << 62), 1 << 62, 4000)
    f = CuckooFilter(buckets_for(len(h)))
    assert f.insert(h) and f.contains(h).all()
    f.delete(h[:2000])
    assert f.contains(h[2000:]).all()
    assert f.contains(h[:2000]).mean() < 0.01
    assert not CuckooFilter(4).insert(h[:100])


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 4), (20, 10), (10, 30), (5, 5)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 8, 20: 10, 30: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- line dedup ------------------------------------------------------------------------------------


def lines_by_hand(rows):
    held = {}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) != d)]
        out[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": -1, "part_lines": 2, "shards": 3}])
def test_line_dedup_insert_and_delete(spark, limits):
    """Filters sent to all tasks, and filters that meet their shard's lines (shards of over two lines in parts)."""
    texts = [None, "", "same line here\nown one\n", "x\n SAME line HERE \nsame line here", "short\nshort", "K same line here", "Same Line Here\t\nÄhnliche Zeile", "ähnliche zeile", "long " * 30000 + "\nsame line here"]
    df = docs(spark, texts)
    dedup = line_dedup.LineDedup(spark, **limits)
    dedup.insert(df)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup.clean(df).collect()}
    assert got == lines_by_hand(rows)
    # without document 2 the line belongs to document 3; and back again
    dedup.delete(spark.createDataFrame([(2,)], "doc_id long"))
    left = df.where("doc_id <> 2")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup.clean(left).collect()}
    assert got == lines_by_hand([r for r in rows if r[0] != 2])
    dedup.insert(df.where("doc_id = 2"))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup.clean(df).collect()}
    assert got == lines_by_hand(rows)


def test_line_dedup_edges(spark):
    empty = line_dedup.LineDedup(spark)
    empty.insert(docs(spark, []))
    assert empty.clean(docs(spark, [])).count() == 0
    twice = docs(spark, ["a line of text\nother text line", "A LINE of text"]).union(docs(spark, ["a line of text\nother text line"]))
    twice = twice.union(spark.createDataFrame([(None, "a line of text", None, None, None, None, None)], DOCS))
    dedup = line_dedup.LineDedup(spark)
    dedup.insert(twice)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_dropped"]) for r in dedup.clean(twice).collect())
    assert got == [(-1, 0), (0, 0), (0, 0), (1, 1)]
    assert set(dedup.clean(twice).columns) == set(twice.columns) | {"n_lines", "n_dropped", "kept_text"}


def test_line_filters_pass_few_others(spark):
    """Asked either way, the filters keep every repeated line and hardly any other."""
    texts = ["\n".join(f"line number {i} of {d % 40 if i % 10 == 0 else d}" for i in range(50)) for d in range(80)]
    kept = []
    for limits in ({}, {"broadcast_bytes": -1, "part_lines": 100}):
        dedup = line_dedup.LineDedup(spark, shards=4, **limits)
        dedup.insert(docs(spark, texts))
        lines, filters = line_dedup.lines_of(docs(spark, texts), 10), dedup._read("filters")
        asked = dedup._asked_by_shard(dedup._sharded(lines), filters) if limits else dedup._asked(lines, {r["shard"]: (r["n_buckets"], r["data"]) for r in filters.collect()})
        kept.append({(r["doc_id"], r["pos"]) for r in asked.collect()})
    want = {(d, i) for d in range(80) for i in range(50) if i % 10 == 0}
    assert want <= kept[0] and kept[0] == kept[1] and len(kept[0] - want) < 20


# -- language --------------------------------------------------------------------------------------


def test_language_id(spark):
    base = {
        "en": "the cat and the dog were with their friends in that house this morning",
        "de": "der hund und die katze waren mit ihren freunden heute morgen nicht im haus",
        "fr": "le chat et les chiens étaient avec leurs amis dans cette maison ce matin",
        "es": "el gato y los perros estaban con sus amigos en aquella casa esta mañana",
    }
    rng, rows = random.Random(2), []
    for lang, text in base.items():
        ws = text.split()
        rows += [(" ".join(rng.choices(ws, k=rng.randint(3, 12))), lang) for _ in range(40)]
    rows += [("nothing", None), (None, "en"), ("123 !!", "de")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    said = language_id.identified(docs(spark, [*base.values(), None, "", "12 %% 3", "der Hund", "A"]), model)
    got = [(r["lang_pred"], r["score"]) for r in said.orderBy("doc_id").collect()]
    assert [x[0] for x in got[:4]] == list(base) and [x[0] for x in got[4:7]] == ["und"] * 3 and got[7][0] == "de"
    assert all(0 <= s <= 1 for _, s in got) and all(s == 0 for _, s in got[4:7])
    assert set(said.columns) == set(DOCS.replace(" long", "").replace(" string", "").split(", ")) | {"lang_pred", "score"}


def test_language_sample_takes_copies_once(spark):
    """One text makes up most rows of a language: the sample still holds the others."""
    rng = random.Random(3)
    rows = [("the same old text of many copies", "en")] * 400 + [(prose(rng, 12), "en") for _ in range(60)] + [(f"ein kurzer satz nummer {i} mit worten und dem rest {prose(rng, 3)}", "de") for i in range(60)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"), sample_per_lang=40)
    got = [r["lang_pred"] for r in language_id.identified(spark.createDataFrame([(1, prose(rng, 14), 0), (2, "noch ein kurzer satz mit worten", 0), (3, prose(rng, 30000), 0), (3, None, 0)], "doc_id long, text string, lang_pred int"), model).orderBy("doc_id", "text").collect()]
    assert got == ["en", "de", "und", "en"]
    assert language_id.identified(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_language_id_without_or_with_one_label(spark):
    none = language_id.train(spark.createDataFrame([("a b", None)], "text string, lang string"))
    assert [r["lang_pred"] for r in language_id.identified(docs(spark, ["a"]), none).collect()] == ["und"]
    one = language_id.train(spark.createDataFrame([("a b", "xx")], "text string, lang string"))
    assert [(r["lang_pred"], r["score"]) for r in language_id.identified(docs(spark, ["a", "7"]), one).orderBy("doc_id").collect()] == [("xx", 1.0), ("und", 0.0)]


# -- language model --------------------------------------------------------------------------------


def test_forward_is_exact_and_training_helps():
    import itertools

    import numpy as np

    from tracemill.llm.hmm import expected_counts, log_likelihood

    rng = np.random.default_rng(3)
    start, move, emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T
    seqs = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 4, 3, 6)]
    by_hand = []
    for s in seqs:
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = start[path[0]] * emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= move[path[t - 1], path[t]] * emit[s[t], path[t]]
            total += p
        by_hand.append(np.log(total))
    assert np.allclose(log_likelihood(seqs, start, move, emit), by_hand)
    a, b, c, log = expected_counts(seqs, start, move, emit)
    assert np.isclose(log, sum(by_hand), rtol=1e-4) and np.isclose(c.sum(), 14, rtol=1e-4) and np.isclose(b.sum(), 10, rtol=1e-4)
    new = log_likelihood(seqs, a / a.sum(), b / b.sum(1, keepdims=True), c / c.sum(0))
    assert new.sum() > sum(by_hand)


def test_lm_scores(spark):
    import collections
    import math

    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(60)] + [None, "", "Unseen WORDS unseen", prose(rng, 3000)]
    train = [i % 7 != 2 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, train, strict=True)), "doc_id long, text string, train boolean")
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [None]
    counts = collections.Counter(w for t, on in zip(texts, train, strict=True) if on for w in tok(t))
    n, v = sum(counts.values()), len(counts)
    for r in lm_score.scored(df).collect():
        ws = tok(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    none = lm_score.scored(df.withColumn("train", F.lit(False)))
    assert all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none.collect())


# -- mixing ----------------------------------------------------------------------------------------


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        level = rest / max(sum(w[s] for s in names if s not in full), 1e-12)
        over = {s for s in names if s not in full and level * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def test_mixing(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for source, n in (("b", 400), ("a", 60), (None, 90), ("ä", 30), ("Z", 10), ("", 25), ("none", 3)):
        for _ in range(n):
            rows.append((i, source, None if source == "none" or i % 50 == 0 else prose(rng, rng.randint(0, 80)), "x"))
            i += 1
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    got = mixing.mixed(df).collect()
    sizes = {}
    for _, s, t, _x in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets_by_hand(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 for r in mine)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 80
    again = mixing.mixed(df.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mixed(df.limit(0)).count() == 0


# -- near duplicates -------------------------------------------------------------------------------


def test_near_classes(spark):
    rng = random.Random(6)
    base = [prose(rng, n).split() for n in (50, 120, 300)]
    texts = []
    for ws in base:
        for rate in (0, 0, 0.03, 0.06, 0.1):
            texts.append(" ".join(w if rng.random() >= rate else rng.choice(WORDS) for w in ws))
    texts += [None, "", "...", "one two", "One, two!", "one three", prose(rng, 150), prose(rng, 9000)]
    df = docs(spark, texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(df).collect()}
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = words[i], words[j]
            if a and b and (a == b or min(len(a), len(b)) >= 5 and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and plain_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in range(len(texts))}
    assert near_dedup.near_classes(df.limit(0)).count() == 0


def test_near_classes_of_a_large_group(spark):
    rng = random.Random(7)
    passage = prose(rng, 60)
    family = prose(rng, 80).split()
    texts = [" ".join(w if rng.random() > 0.02 else rng.choice(WORDS) for w in family) for _ in range(60)]
    texts += [f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs(spark, texts)).collect()}
    assert {got[i] for i in range(60)} == {0} and all(got[i] == i for i in range(60, 100))


# -- decontamination -------------------------------------------------------------------------------


def test_near_pairs_of_large_buckets(spark):
    """Texts of one template, all far apart but for pairs that share the buckets of the template only."""
    rng = random.Random(31)
    template, texts = prose(rng, 40), []
    for i in range(300):
        own = [f"t{i}w{k}" for k in range(80)]
        texts.append(f"{template} {' '.join(own)}")
        if i % 20 == 0:
            texts.append(f"{template} {' '.join('x' + w if k % 5 == 2 else w for k, w in enumerate(own))}")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs(spark, texts)).collect()}
    first = {}
    assert got == {i: first.setdefault(t.split()[40], i) for i, t in enumerate(texts)}


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate((6, 15, 30, 60))] + [(9, "too few words"), (10, None), (11, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts, want = [], []
    for i, t in items[:4]:
        ws = t.split()
        for edits in (0, len(ws) // 10, len(ws) // 6):
            copy = list(ws)
            for k in rng.sample(range(len(copy)), edits):
                copy[k] = "changed"
            texts.append(prose(rng, 50).upper() + " " + ", ".join(copy) + " " + prose(rng, 20))
            want.append([i])
    texts += [None, "", prose(rng, 500), items[3][1][: len(items[3][1]) // 2], items[0][1]]
    want += [[], [], [], [], [0]]
    got = [sorted(x["item_id"] for x in r["leaks"]) for r in decontaminate.with_leaks(docs(spark, texts), bench).orderBy("doc_id").collect()]
    assert got == want
    blocks = decontaminate.with_leaks(docs(spark, texts), bench, block_words=20).orderBy("doc_id").collect()
    assert [sorted(x["item_id"] for x in r["leaks"]) for r in blocks] == want
    assert all(r["leaks"] == [] for r in decontaminate.with_leaks(docs(spark, texts), bench.limit(0)).collect())


def leaks_by_hand(text, items, similarity=0.8):
    """(item_id, edits) for each item with a part of the text within its bound: plain edit distance with free ends in the text."""
    words, out = re.findall(r"\w+", (text or "").lower()), set()
    for i, item in items:
        want = re.findall(r"\w+", (item or "").lower())
        if len(want) < 5:
            continue
        row = [0] * (len(words) + 1)
        for k, w in enumerate(want, 1):
            new = [k]
            for j, v in enumerate(words, 1):
                new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
            row = new
        if min(row) <= int((1 - similarity) * len(want) + 1e-9):
            out.add((i, min(row)))
    return out


def test_decontamination_against_plain_python(spark):
    rng = random.Random(28)
    items = [(i, prose(rng, 5 + 3 * i)) for i in range(14)] + [(20, "a b"), (21, prose(rng, 5))]
    items.append((22, items[3][1]))
    texts = []
    for i, t in items * 4:
        ws = t.split()
        for _ in range(rng.randint(0, max(1, len(ws) // 6))):
            k = rng.randrange(len(ws))
            ws[k : k + 1] = rng.choice(([], [rng.choice(WORDS)], [ws[k], rng.choice(WORDS)]))
        texts.append(f"{prose(rng, rng.randint(0, 60))} {' '.join(ws)} {prose(rng, rng.randint(0, 60))}")
    texts += [None, "", prose(rng, 20000) + " " + items[9][1], texts[5], items[6][1] + " " + items[6][1]]
    df = docs(spark, texts).withColumn("leaks", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: leaks_by_hand(t, items) for i, t in enumerate(texts)}
    for words in (1 << 20, 60):
        got = {r["doc_id"]: {(x["item_id"], x["edits"]) for x in r["leaks"]} for r in decontaminate.with_leaks(df, bench, block_words=words).collect()}
        missed = sum(len({i for i, _ in want[d]} - {i for i, _ in got[d]}) for d in want)
        assert set(got) == set(want) and missed <= 0.02 * sum(map(len, want.values()))
        assert all({i for i, _ in got[d]} <= {i for i, _ in want[d]} for d in want)  # nothing else
        assert all(got[d] == want[d] for d in (len(texts) - 5, len(texts) - 4, len(texts) - 3, len(texts) - 1))
    assert decontaminate.with_leaks(df.limit(0), bench).count() == 0


def test_decontamination_of_neighbouring_lengths():
    rng = random.Random(21)
    for short, long in ((9, 10), (14, 15), (19, 20)):
        items = [[f"w{n}x{i}" for i in range(n)] for n in (short, long)]
        block = decontaminate.Block(list(enumerate(items)), 0.8)
        assert len(block.classes) == 1 and block.allowed(long) == block.allowed(short) + 1
        copy = list(items[1])
        for i in range(block.allowed(long)):
            copy[2 + 4 * i] = f"changed{i}"
        texts = [" ".join([f"a{rng.random()}" for _ in range(30)] + copy + [f"b{rng.random()}" for _ in range(30)]) for _ in range(3)]
        assert [[x["item_id"] for x in found] for found in block.leaks(texts)] == [[1]] * 3


# -- spans -----------------------------------------------------------------------------------------


def test_span_dedup(spark):
    rng = random.Random(9)
    passage = ". ".join(prose(rng, 11).capitalize() for _ in range(5)) + "."
    texts = [
        f"{prose(rng, 12)}. {passage} {prose(rng, 12)}.",
        f"{prose(rng, 9)} {passage} {prose(rng, 12)}.",
        passage.lower(),
        f"{passage} {passage}",
        prose(rng, 200),
        None, "", "Short. Short. Short.",
    ]
    got = {r["doc_id"]: r for r in span_dedup.without_repeats(docs(spark, texts)).collect()}
    assert got[0]["n_removed"] == 0 and got[0]["kept_text"] == texts[0]
    assert got[1]["n_removed"] == 4 and got[1]["first_docs"] == [0]
    assert got[2]["kept_text"].strip() == "" and got[3]["kept_text"].strip() == ""
    assert all(got[i]["kept_text"] == texts[i] and got[i]["n_removed"] == 0 for i in (4, 5, 6, 7))
    changed = {r["doc_id"] for r in span_dedup.without_repeats(docs(spark, texts), only_changed=True).collect()}
    assert changed == {1, 2, 3}
    clash = span_dedup.without_repeats(docs(spark, texts).withColumns({"first_docs": F.lit(1), "n_removed": F.lit("x")}))
    assert {r["doc_id"]: r["n_removed"] for r in clash.collect()} == {i: r["n_removed"] for i, r in got.items()}
    assert "".join(span_dedup.sentences(texts[0])) == texts[0]
    assert span_dedup.without_repeats(docs(spark, [])).count() == 0


def test_span_dedup_rulers_and_tails(spark):
    rng = random.Random(12)
    s = [prose(rng, 12).capitalize() + "." for _ in range(8)]
    tail = " ".join(s[4:7]) + " So it goes. That was all."
    texts = [
        f"---\n{s[0]}\n{s[1]}\n{s[2]}",
        f"***\n|\n{s[3]}\n---\n{prose(rng, 12)}.",
        f"{prose(rng, 12)}. {tail} {prose(rng, 12)}.",
        f"{prose(rng, 12)}. {tail} {s[7]}",
        f"{prose(rng, 12)}. {s[1]}\n---\n{s[2]}",
    ]
    got = {r["doc_id"]: r for r in span_dedup.without_repeats(docs(spark, texts)).collect()}
    assert all(got[i]["kept_text"] == texts[i] and got[i]["n_removed"] == 0 for i in (0, 1, 2))
    assert got[3]["kept_text"] == texts[3].replace(tail + " ", "") and got[3]["first_docs"] == [2]
    assert got[4]["kept_text"] == texts[4][: texts[4].index(s[1])] and got[4]["n_removed"] == 3
    assert span_dedup.sentences("你好。再见！好吗？क्या। हाँ") == ["你好。", "再见！", "好吗？", "क्या। ", "हाँ"]


def spans_by_hand(texts, several=5, few=2, min_words=20):
    """kept text of each document; doc_id is the position."""
    cut, held = {}, {}
    for d, t in enumerate(texts):
        pieces = span_dedup.sentences(t)
        words = [re.findall(r"\w+", p.lower()) for p in pieces]
        at = [i for i, w in enumerate(words) if w]
        enough = lambda ids: len(ids) >= several or len(ids) >= few and sum(len(words[i]) for i in ids) >= min_words
        found = set()
        for i in range(len(at)):
            for run in (next((at[i:j] for j in range(i + 1, len(at) + 1) if enough(at[i:j])), None), next((at[j : i + 1] for j in range(i, -1, -1) if enough(at[j : i + 1])), None)):
                if run:
                    found.add(tuple(run))
        cut[d] = (pieces, [(run, tuple(w for i in run for w in words[i])) for run in sorted(found)])
        for _, key in cut[d][1]:
            held.setdefault(key, d)
    out = []
    for d, (pieces, found) in cut.items():
        seen, gone = set(), set()
        for run, key in found:
            if held[key] < d or key in seen:
                gone |= set(range(run[0], run[-1] + 1))
            seen.add(key)
        out.append("".join(p for i, p in enumerate(pieces) if i not in gone) if gone else texts[d])
    return out


def test_span_dedup_against_plain_python(spark):
    rng = random.Random(41)
    pool = [prose(rng, rng.choice((1, 2, 3, 8, 12, 15))).capitalize() + rng.choice(".!?") for _ in range(40)]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.7 else "\n---\n" for _ in range(rng.randint(0, 14))) for _ in range(50)]
    texts += [None, " ".join(pool[:3]), "Yes. No. Maybe. A. B.", "So. Yes. No. Maybe. A. B. Then", " ".join(pool) * 60, texts[3], texts[3]]
    got = {r["doc_id"]: r["kept_text"] for r in span_dedup.without_repeats(docs(spark, texts)).collect()}
    assert got == dict(enumerate(spans_by_hand(texts)))
    assert got[52] == "Yes. No. Maybe. A. B." and got[53] == "So. Then"


def test_span_dedup_odd_rows(spark):
    passage = "One two three. Four five six. Seven eight nine. Ten. Eleven."
    rows = [(3, passage), (3, passage), (None, passage), (1, passage + " And more."), (1, "Other text. " + passage)]
    got = span_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))).collect()
    assert sorted(((r["doc_id"] or 0), r["n_removed"]) for r in got) == [(0, 0), (1, 0), (1, 0), (3, 5), (3, 5)]


# -- personal data ---------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_by_hand(text):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
            return 14 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    spans = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if ok(k, m.group())]
    return ",".join(f"{list(PLAIN)[i]}:{a}:{b}" for a, i, b in sorted(spans))


def test_pii_base_spans(spark):
    rng = random.Random(10)
    texts = [None, "", "é a.b@c.de 1.2.3.4 001.002.003.255 1.2.3.256 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111111111111111 4111-1111-1111-1112", "+1 (743) 555-3824 +12 +1234567890123456 x@y z@q.r.@s.t 𝔸 j@k.lm", "a" * 50000, "1" * 30000, "1." * 5000, "@" * 1000 + "a@b.c"]
    texts += ["".join(rng.choice("01239 .-+()@ab") for _ in range(120)) for _ in range(150)]
    got = {r["doc_id"]: pii_written(r["base"]) for r in pii.found(docs(spark, texts)).collect()}
    assert got == {i: pii_by_hand(t or "") for i, t in enumerate(texts)}
    assert pii.found(docs(spark, [])).count() == 0


def pii_written(spans):
    return ",".join(f"{pii.NAMES[s['kind']]}:{s['start']}:{s['end']}" for s in spans)


def looks_by_hand(v):
    look = "at" if "@" in v else "plus" if v[0] == "+" else "mixed" if re.search("[A-Za-z]", v) else "dotted" if re.fullmatch(r"[0-9]+(\.[0-9]+)+", v) else "groups" if " " in v else "number"
    return look + str(-(-len(v) // 4))


def patterns_by_hand(text, start, end):
    before, after = text[max(0, start - 64) : start].lower(), text[end : end + 64].lower()
    words, follow = list(re.finditer(r"\w+", before)), re.match(r"[^\w]*(\w+)", after)
    if not words:
        return []
    word = words[-1].group()
    made = ["word " + re.sub(r"\s+", " ", before[words[-1].start() :]).strip(), f"shape {word} {looks_by_hand(text[start:end])}"]
    made += [f"two {words[-2].group()} {word}"] if len(words) > 1 else []
    return made + ([f"both {word} _ {follow.group(1)}"] if follow else [])


def bootstrap_by_hand(texts, rounds=3, accept=0.8, min_support=3):
    """All spans of each text, with dictionaries in place of joins."""
    places = []
    for i, t in enumerate(texts):
        base = [(int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in pii_by_hand(t or "").split(",") if x]
        places += [(i, a, b, k) for a, b, k in base]
        for m in re.finditer(pii.CANDIDATE, t or ""):
            if not any(a < m.end() and b > m.start() for a, b, _ in base):
                places.append((i, m.start(), m.end(), "secret" if re.match(pii.SECRET_SEED, m.group()) else None))
    conf, held, seen = {}, {}, []
    for i, a, b, k in places:
        value = texts[i][a:b]
        if k:
            conf[k, value] = 1.0
        seen.append((i, a, b, k, value, patterns_by_hand(texts[i], a, b)))
        for q in seen[-1][5]:
            held.setdefault(q, set()).add(value)
    for _ in range(rounds):
        score = {}
        for q, values in held.items():
            for kind in pii.NAMES:
                good = [conf[kind, v] for v in values if (kind, v) in conf]
                if len(good) >= min_support:
                    score[q, kind] = sum(good) / (len(values) + 1)
        grown = {}
        for _, _, _, k, v, qs in seen:
            for q in qs if k is None else ():
                for kind in pii.NAMES:
                    if score.get((q, kind), 0) >= accept and (kind, v) not in conf:
                        grown[kind, v] = max(grown.get((kind, v), 0), score[q, kind])
        conf |= grown
        if not grown:
            break
    out = [[] for _ in texts]
    for i, a, b, k, _v, qs in seen:
        if k and k != "secret":
            out[i].append((a, pii.NAMES.index(k), b))
        else:
            best = max(((score[q, x], -j) for q in qs for j, x in enumerate(pii.NAMES) if score.get((q, x), 0) >= accept), default=None)
            if best:
                out[i].append((a, -best[1], b))
    return [",".join(f"{pii.NAMES[k]}:{a}:{b}" for a, k, b in sorted(x)) for x in out]


def test_pii_bootstrapping(spark):
    texts = [f"note {i} please mail user{i}@host{i}.org today" for i in range(20)]
    texts += ["now mail (someone@localhost), please", "now mail other@intranet please", "the sum 12345678 is not personal", "odd@thing here"]
    texts += [f"call +1 (55{i}) 555-010{i} soon" for i in range(8)] + ["call 555-0199 soon", "year 2024-1999 passed"]
    texts += [f'token = "{hashlib.sha1(bytes([i])).hexdigest()}" and so on' for i in range(12)] + ['TOKEN = "9233A8ECF7C5B09F" then', "hash 5d41402abc4b2a76b9719d911017c592 of a file", "plate AB12 34567 seen"]
    texts += [f"account number 40{i} 22{i} 1{i}3 closed, " * 3 for i in range(4)] + [None, "", texts[0], "1234 5678 " * 2000]
    df = docs(spark, texts).withColumns({"kind": F.lit("x"), "patterns": F.lit(1)})
    got = {r["doc_id"]: r for r in pii.found(df).collect()}
    assert {i: pii_written(r["spans"]) for i, r in got.items()} == dict(enumerate(bootstrap_by_hand(texts)))
    assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in got.values())
    assert pii_written(got[20]["spans"]) == "email:10:27" and got[20]["base"] == [] and pii_written(got[21]["spans"]) == "email:9:23"
    assert pii_written(got[32]["spans"]) == "phone:5:13" and pii_written(got[34]["spans"]) == "secret:9:49" and pii_written(got[46]["spans"]) == "secret:9:25"
    assert all(got[i]["spans"] == [] for i in (22, 23, 33, 47, 48))


def test_pii_odd_rows(spark):
    rows = [(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd"), (2, None)]
    got = pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, pii_written(r["spans"])) for r in got) == [(0, "email:0:6"), (1, "email:0:6"), (1, "email:0:6"), (2, "")]


# -- quotes ----------------------------------------------------------------------------------------


def test_quote_linking(spark):
    rows = [
        (1, 0, "a", "How do I merge two tables\nin one query?\n\nThanks a lot"),
        (1, 1, "b", "On Monday a wrote:\n> How do I merge two tables\n> in one query?\nUse a join.\nOr a union of both"),
        (1, 2, "a", "b wrote:\n>> How do I merge two tables\n>> in one query?\n> Use a join.\n> Or a union of both\nThat worked well"),
        (2, 0, "c", "> That worked well\nsame for me here"),
        (2, 1, "d", None), (2, 1, "d", "x"), (3, None, "z", "q"), (None, 1, "z", "q"),
        (3, 5, None, "> never said anywhere before\nok then"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("root_conv", F.lit("x"))
    got = {(r["conv_id"], r["turn"]): r for r in quote_linking.chat(quote_linking.linked(df)).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 5)}
    assert [(got[k]["parent_conv"], got[k]["parent_turn"], got[k]["depth"]) for k in ((1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 5))] == [(None, None, 0), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 4), (None, None, 0)]
    assert [(got[k]["root_conv"], got[k]["root_turn"], got[k]["position"]) for k in sorted(got)] == [(1, 0, i) for i in range(1, 6)] + [(3, 5, 1)]
    assert [got[k]["quoted"] for k in sorted(got)] == [False, True, True, True, False, False]
    assert got[1, 1]["own_text"] == "Use a join.\nOr a union of both" and got[1, 2]["own_text"] == "That worked well" and got[1, 2]["n_quotes"] == 2
    assert got[3, 5]["chat"] == "<|user|>\nok then\n<|end|>"
    assert quote_linking.linked(df.limit(0)).count() == 0


def test_quote_linking_of_deep_and_short_quotes(spark):
    rows = [
        (5, 0, "a", "The build fails on the second machine"),
        (5, 1, "b", "> The build fails on the second machine\nWhich one?"),
        (5, 2, "c", ">> The build fails on the second machine\n> a passage that was edited\nThe old one"),
        (5, 3, "a", "> Which one?\nThe left"),
        (5, 4, "b", ">> Which one?\n> The left\nThanks"),
        (6, 0, "a", "你好吗"), (6, 1, "b", "> 你好吗\n今天的天气真的很好"),
        (7, 0, "e", "> Which one?\nwho knows"), (7, 1, "e", "> 今天的天气真的很好\n是"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quote_linking.linked(df).collect()}
    parents = {k: (r["parent_conv"], r["parent_turn"]) for k, r in got.items() if r["parent_conv"] is not None}
    assert parents == {(5, 1): (5, 0), (5, 2): (5, 0), (5, 3): (5, 1), (5, 4): (5, 3), (6, 1): (6, 0), (7, 1): (6, 1)}
    links = {k: [tuple(x) for x in r["links"]] for k, r in got.items() if r["links"]}
    assert links == {**{k: [(1, *v)] for k, v in parents.items()}, (5, 2): [(2, 5, 0)], (5, 4): [(1, 5, 3), (2, 5, 1)]}
    assert got[5, 4]["depth"] == 3 and got[5, 2]["depth"] == 1


def linked_by_hand(rows):
    """(conv, turn) -> own text, quoted, parent, root, depth, position, with dictionaries in place of joins."""
    norm = lambda t: re.sub(r"[^\w]+|_", " ", t.lower()).strip()
    own, held, said = {}, {}, {}
    for conv, turn, _role, text in rows:
        lines = []
        for line in (text or "").split("\n"):
            marks = re.match(r"(?:[ \t]*>)*[ \t]?" if re.match(r"[ \t]*>", line) else "", line).group()
            lines.append((marks.count(">"), line[len(marks) :]))
        lines = [(lines[i + 1][0] if i + 1 < len(lines) and lines[i + 1][0] > v and re.match(quote_linking.ATTRIBUTION, t) else v, t) for i, (v, t) in enumerate(lines)]
        own[conv, turn] = re.sub(r"\n{3,}", "\n\n", "\n".join(t for v, t in lines if v == 0)).strip(" \t\r\n")
        parts = {(v, norm(t)) for v, t in lines}
        parts |= {(v, norm(" ".join(t for _, t in run))) for v, run in itertools.groupby(lines, key=lambda x: x[0]) for run in [list(run)]}
        held[conv, turn] = {k for v, k in parts if v == 0 and k}
        said[conv, turn] = sorted((v, k) for v, k in parts if v and k)
    out, spot = {}, {}
    for m in sorted(own):
        votes = {}
        for level, key in said[m]:
            near = [x for x in own if x[0] == m[0] and x < m and key in held[x]]
            first = min((x for x in own if key in held[x]), default=None)
            goal = max(near) if near else first if first and first < m and len(key.split()) >= 3 else None
            if goal:
                votes.setdefault(level, {}).setdefault(goal, 0)
                votes[level][goal] += len(key.split())
        before = max((x for x in own if x[0] == m[0] and x < m), default=None)
        parent = max(votes[min(votes)].items(), key=lambda x: (x[1], x[0][0] == m[0], x[0]))[0] if votes else before
        root, depth = (out[parent][3], out[parent][4] + 1) if parent else (m, 0)
        spot[root] = spot.get(root, 0) + 1
        out[m] = (own[m], bool(votes), parent, root, depth, spot[root])
    return out


def test_quote_linking_against_plain_python(spark):
    rng, rows = random.Random(17), []
    for conv in range(25):
        for turn in sorted(rng.sample(range(40), rng.randint(1, 9))):
            lines = [prose(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 4))]
            if rows and rng.random() < 0.6:
                mine = [r for r in rows if r[0] == conv] or rows
                quoted = rng.choice(mine if rng.random() < 0.7 else rows)[3].split("\n")
                part = quoted[: rng.randint(1, len(quoted))]
                lines = ([f"x{turn} wrote:"] if rng.random() < 0.5 else []) + [f">{'' if t.startswith('>') else ' '}{t}" for t in part] + lines
            rows.append((conv, turn, rng.choice("ab"), "\n".join(lines)))
    rows += [(30, t, "a", f"same words every time {t % 3}" if t % 2 else f"> same words every time {t % 3}\nyes {t}") for t in range(300)]
    rows += [(31, 0, "a", "\n".join(f"{'>' * (i % 7)} line {i}" for i in range(3000)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"position": F.lit("x"), "quoted": F.lit(1)})
    done = quote_linking.chat(quote_linking.linked(df.repartition(5)))
    got = {}
    for r in done.collect():
        parent = (r["parent_conv"], r["parent_turn"]) if r["parent_conv"] is not None else None
        got[r["conv_id"], r["turn"]] = (r["own_text"], r["quoted"], parent, (r["root_conv"], r["root_turn"]), r["depth"], r["position"])
    want = linked_by_hand(rows)
    assert got == want
    parts = quote_linking.conversations(done, most=100).collect()
    assert sum(r["n_messages"] for r in parts) == len(rows) and max(r["n_messages"] for r in parts) == 100
    texts = {m: t[0] for m, t in want.items()}
    for r in parts:
        members = sorted((w[5], m) for m, w in want.items() if w[3] == (r["root_conv"], r["root_turn"]) and (w[5] - 1) // 100 == r["part"])
        assert [x.split("\n", 1)[-1] for x in r["text"].split("\n<|end|>")][:-1][0].endswith(texts[members[0][1]]) and r["n_messages"] == len(members)


@pytest.mark.parametrize("text", ["a b  c\t\x0bd", "", None, " \n", "x\x85y\xa0z"])
def test_word_count(spark, text):
    from tracemill.llm.common import word_count

    got = spark.createDataFrame([(text,)], "t string").select(word_count(F.col("t"))).first()[0]
    assert got == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_hash_of_kept_lines():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_word_counts_never_exceed_the_edit_distance():
    rng = random.Random(5)
    for bins in (4, 40):
        for _ in range(200):
            x, y = ([rng.randrange(bins) for _ in range(rng.randrange(0, 40))] for _ in range(2))
            bx, by = (np.frombuffer(near_dedup.binned(np.array(t, np.uint64)), np.uint8)[None, :] for t in (x, y))
            assert near_dedup.apart(bx, by)[0] <= plain_distance(x, y)
    many = np.frombuffer(near_dedup.binned(np.full(1000, 3, np.uint64)), np.uint8)
    assert len(many) == near_dedup.BINS and many[3] == 255  # a full bin loosens the bound only


@pytest.mark.parametrize("crowd", [3, 1000])
def test_texts_around_one_passage(spark, monkeypatch, crowd):
    """Texts that share one long passage and differ around it: classes as by all pairs, whether their word pairs count as crowded or not."""
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rng = random.Random(29)
    passage = prose(rng, 60)
    texts = [f"{prose(rng, rng.randrange(0, 30))} {passage} {prose(rng, rng.randrange(0, 12))}".strip() for _ in range(60)]
    texts += [" ".join(w if rng.random() > 0.06 else rng.choice(WORDS) for w in t.split()) for t in texts[:25]] + [prose(rng, 80) for _ in range(5)]
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        n = max(len(words[i]), len(words[j]))
        if min(len(words[i]), len(words[j])) >= 0.8 * n and plain_distance(words[i], words[j]) <= 0.2 * n + 1e-9:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == label and len(set(label)) > 10
