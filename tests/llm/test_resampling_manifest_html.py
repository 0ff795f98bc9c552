"""Importance resampling, Merkle manifest and main text of pages against plain Python, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracemill.llm import html_text, manifest, resampling
from tracemill.llm.html_text import main_text

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score long, idx int, steps string"


def docs(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(d, t, "en" if d and d % 3 else None, s, len(t or ""), 7, 1, "x") for d, t, s in rows], DOCS)


# -- importance resampling -------------------------------------------------------------------------


def hashes_by_hand(text, n):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def resampled_by_hand(rows, target, n, buckets, seed, min_words, percent):
    s, t, out = [0] * buckets, [0] * buckets, {}
    for counts, texts in ((s, [t for _, t, _ in rows]), (t, target)):
        for text in texts:
            for h in hashes_by_hand(text, n)[1]:
                counts[h % buckets] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    for d, text, _ in rows:
        n_words, found = hashes_by_hand(text, n)
        weight = sum(gain[h % buckets] for h in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((-x[3], d) for d, x in out.items() if x[0] >= min_words)
    for rank, (_, d) in enumerate(able[: len(able) * percent // 100], 1):
        out[d][4] = rank
    return {d: tuple(x) for d, x in out.items()}


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_plain_python(spark, n):
    rng = random.Random(n)
    words = [a + b for a in "kst" for b in ("a", "É", "ü9", "O", "日本", "x-y")]
    rows = [(i, " ".join(rng.choice(words[: 4 + i % 15]) + rng.choice(["", ",", "\t!", "\x00"]) for _ in range(rng.randrange(60))), "s") for i in range(120)]
    rows += [(200, None, None), (201, "", "s"), (202, "...\n", "s"), (203, "Ka " * 400_000, "s"), (204, rows[0][1], "t")]
    target = [" ".join(rng.choice(words[:5]) for _ in range(30)) for _ in range(6)] + [None]
    got = resampling.resampled(docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), n, 997, 5, 20, 30)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == resampled_by_hand(rows, target, n, 997, 5, 20, 30)


def test_pieces_lose_no_word():
    text = ("Abc déf 12-x " * 5000).encode()
    resampling.PIECE, was = 1000, resampling.PIECE
    try:
        by_piece = [h for _, found in resampling.features(text, 3) for h in found]
        assert len(list(resampling.pieces(text))) > 50
    finally:
        resampling.PIECE = was
    assert sorted(by_piece) == sorted(hashes_by_hand(text.decode(), 3)[1])


def test_ranks_with_ties_repeats_and_without_ids(spark):
    rows = [(d, s) for d, s in [(5, 10), (3, 10), (9, 10), (1, -2500), (2, 4000), (2, 4000), (8, 10), (4, -900)]]
    got = resampling.drawn(spark.createDataFrame(rows, "doc_id long, score long"), 5).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got if r["rank"]) == [(1, 2), (2, 2), (3, 3), (4, 5), (5, 8)]
    assert len(got) == 8
    many = docs(spark, [(None, "a b c " * 20, "s"), (1, "a b c " * 20, "s"), (1, "a b c " * 20, "s")])
    target = spark.createDataFrame([], "text string")
    ranks = [(r["doc_id"], r["rank"]) for r in resampling.resampled(many, target, percent=100).collect()]
    assert sorted(ranks, key=str) == [(1, 1), (1, 2), (None, None)]
    assert resampling.resampled(docs(spark, []), target).count() == 0


# -- Merkle manifest -------------------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_by_hand(d, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def tree_by_hand(nodes):
    """(root, steps of each node: list of (left, right))."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 16 * 16 : k // 16 * 16 + 16]
            steps[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            at[i] = k // 16
        level = [sha("".join(level[j : j + 16])) for j in range(0, len(level), 16)]
    return level[0], steps


def manifest_by_hand(rows):
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by_source, out = {}, []
    for d, text, source in rows:
        rest = (source, "en" if d and d % 3 else None, len(text or ""))
        leaf = leaf_by_hand(d, *rest, text)
        bad = leaf_by_hand(d, *rest, lower(text)) if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else leaf
        by_source.setdefault(source, []).append((d if d is not None else -(1 << 62), leaf, bad, d))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_by_hand([x[1] for x in sorted(by_source[s], key=lambda x: x[:2])]) for s in order]
    root, above = tree_by_hand([t[0] for t in trees])
    for s, (sub, steps), up in zip(order, trees, above, strict=True):
        for (_, leaf, bad, d), own in zip(sorted(by_source[s], key=lambda x: x[:2]), steps, strict=True):
            fold = bad
            for left, right in own + up:
                fold = sha(left + fold + right)
            out.append((d, leaf, sub, root, sha("".join(a + b for a, b in own + up)), fold, fold == root))
    return sorted(out, key=str)


def digest(rows):
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof_text(), 256).alias("p"), manifest.folded(F.col("tampered_leaf")).alias("f"))
    return sorted((tuple(r) for r in rows.withColumn("v", F.col("f") == F.col("root")).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, None: 1}, {"a": 17, "b": 16, None: 3, "": 2, "é": 300, "z": 1}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_equals_plain_python(spark, sizes):
    rng, rows = random.Random(3), []
    for s, n in sizes.items():
        rows += [(len(rows) + i, rng.choice([None, "", "Some Text É", "lower"]) if i % 7 else f"T{i}", s) for i in range(n)]
    rng.shuffle(rows)
    assert digest(manifest.manifest(docs(spark, rows))) == manifest_by_hand(rows)


def test_manifest_of_odd_rows(spark):
    """Repeated rows, rows of one id, null ids, a very long text; an empty table."""
    rows = [(1, "A", "s"), (1, "A", "s"), (1, "B", "s"), (None, "C", "s"), (None, "C", "s"), (2, "Long " * 200_000, None), (15, "UP", "s")]
    assert digest(manifest.manifest(docs(spark, rows))) == manifest_by_hand(rows)
    assert manifest.manifest(docs(spark, [])).count() == 0


# -- main text -------------------------------------------------------------------------------------

LONG = "This is a sentence, with commas, that goes on for a while, so that it counts as text of an article."
BODY = "".join(f"<p>Part {i}. {LONG}</p>" for i in range(6))
TEXT = "\n\n".join(f"Part {i}. {LONG}" for i in range(6))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href='/'>Home</a></nav></body></html>", ""),
        (f"<body><header>Site, of, many, things</header><nav><ul><li><a href='/a'>A</a></ul></nav><article><h1>Title</h1>{BODY}</article><footer>c, 2020</footer>", f"Title\n\n{TEXT}"),
        (f"<div id=main><div class='post-header'><h1>Title</h1></div>{BODY}<div class='share-buttons'>Share, this, now</div></div><div class=sidebar><p>{LONG}</p></div>", f"Title\n\n{TEXT}"),
        (f"<article>{BODY}<section class='comments'><p>{LONG * 9}</p></section></article><div id='comments'><article><p>{LONG * 9}</p></article></div>", TEXT),
        (f"<body class='has-sidebar cookie'><div class='cookie-notice'><p>{LONG}</p></div><main><article>{BODY}</article></main></body>", TEXT),
        (f"<form action=/search><input name=q><label>Find, things</label></form><div>{BODY}</div><aside><p>{LONG}</p></aside><div class='ad'>{LONG}</div>", TEXT),
        (f"<form id=aspnet><div><article>{BODY}</article></div></form>", TEXT),
        (f"<div><p>One&nbsp;two<br>three &lt;b&gt; &amp;amp;  four, {LONG}<p>Five &#233;&#x4e2d; six, {LONG}</div>", f"One two three <b> &amp; four, {LONG}\n\nFive é中 six, {LONG}"),
        (f"<script>var t='</p><p>no';</script><style>p{{}}</style><!-- <p>no</p> --><article>{BODY}<p hidden>no, no, no</p><p style='display: none'>no</p></article>", TEXT),
        (f"<section class=part>{BODY}</section><section class=part>{BODY}</section><section class='related'>{BODY}</section>", f"{TEXT}\n\n{TEXT}"),
        (f"<article>{BODY}<ul><li><a href=1>More one</a></li><li><a href=2>More two</a></li></ul><ul><li>A point, of text</li></ul></article>", f"{TEXT}\n\nA point, of text"),
        (f"<table><tr><td class=nav>Menu</td><td>{BODY}</td></tr></table>", TEXT),
        (f"<article>{BODY}<p>tail <b>bold <i>both</p>", f"{TEXT}\n\ntail bold both"),
        (f"a < b <article>{BODY}", TEXT),
        (f"<article>{BODY}<p>tail, of a page <a href='x", f"{TEXT}\n\ntail, of a page"),
        (f"<article>{BODY}<p>tail, of a page <!-- never closed <p>no, no", f"{TEXT}\n\ntail, of a page"),
        (f"<article>{BODY}<p title=\"a > b\">quoted, '>' inside</p><p>Short.</p></article>", f"{TEXT}\n\nquoted, '>' inside\n\nShort."),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_extracted_rows(spark):
    page = f"<html><head><title>T</title></head><body><article>{BODY}</article></body></html>"
    rows = [(1, "u", None), (2, "u", ""), (3, "u", page), (3, "u", page), (4, None, f"<article>{'<p>' + LONG * 3 + '</p>' * 1}" * 3000), (5, "u", "<" * 20_000 + "<a<b" * 5000)]
    table = spark.createDataFrame([(*r, "old", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r for r in html_text.extracted(table).collect()}
    assert (got[1]["text"], got[1]["n_chars"], got[2]["text"]) == ("", 0, "") and got[3]["text"] == TEXT and got[3]["n_chars"] == len(TEXT)
    assert got[4]["text"].count(LONG) == 9000
    assert html_text.extracted(table).count() == 6 and html_text.extracted(table.limit(0)).count() == 0
