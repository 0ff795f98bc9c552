"""The queries of the training-data operators over the driver's tables, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def fold(n: int):
    """crc32 of doc_id as text, modulo n (a null doc_id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    from .decontaminate import with_leaks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identified, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(3) != 1).select("text", "lang"))
    said = identified(docs.select("doc_id", "text"), model)
    return said.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(7) != 2).alias("train"))
    return scored(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import neighbours

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(rows, rows.where(F.col("vec_id") % 100 == 0))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op6_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each message: without quotes, with its parent and its place in the reply order."""
    from .quote_linking import chat, linked

    return chat(linked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import LineDedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dedup = LineDedup(spark)
    dedup.insert(docs)
    return dedup.clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_classes

    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that loses sentences."""
    from .span_dedup import without_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, only_changed=True).select("doc_id", "first_docs", "n_sentences", "n_removed", "kept_text")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, found, of_kind, written

    counts = [of_kind("base", k).alias(f"n_{k}") for k in KINDS]
    docs = found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resampled

    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import folded, manifest, proof_text

    rows = manifest(table(spark, sf_dir, "documents"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(), 256).alias("proof_sha256"), folded(F.col("tampered_leaf")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_lm_score": op3_lm_score,
    "op4_neighbours": op4_neighbours,
    "op5_mixing": op5_mixing,
    "op6_quote_linking": op6_quote_linking,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_span_dedup": op9_span_dedup,
    "op10_pii": op10_pii,
    "op11_resampling": op11_resampling,
    "op12_manifest": op12_manifest,
    "op13_html_text": op13_html_text,
}

#: CTE crc_table: one row with the 256 values of the reflected polynomial of CRC-32, made by its rule.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, bit: xor(c >> 1, 3988292384 * (c & 1))) AS v
    FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) AS r(i)))
)"""


def crc(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes; crcs of crc_table must be in reach."""
    hexed = f"hex(encode({text}))"
    octets = f"[CAST('0x' || {hexed}[2 * i - 1 : 2 * i] AS BIGINT) FOR i IN range(1, length({hexed}) // 2 + 1)]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])))"


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _resampling() -> str:
    words = f"unnest(regexp_extract_all({LOWERED.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word"
    return f"""
WITH {CRC_TABLE}, ours AS (SELECT doc_id, {words} FROM documents), theirs AS (SELECT {words} FROM benchmark),
vocabulary AS (SELECT word, {crc("word")} % 10000 AS bucket FROM (SELECT word FROM ours UNION SELECT word FROM theirs), crc_table),
held AS (SELECT bucket, count(*) AS n FROM ours JOIN vocabulary USING (word) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS n FROM theirs JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM held) + 10000)
         / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM wanted) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM vocabulary) LEFT JOIN held s USING (bucket) LEFT JOIN wanted t USING (bucket)),
sums AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM ours JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scores AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total::DOUBLE / n), 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM documents d LEFT JOIN sums USING (doc_id)),
full_scores AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scores),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM full_scores WHERE n_features >= 20)
SELECT f.doc_id, f.n_features, f.weight, f.score, CASE WHEN r.rank <= 10 * r.n // 100 THEN CAST(r.rank AS BIGINT) END AS rank
FROM full_scores f LEFT JOIN ranks r USING (doc_id)
"""


def _levels(name: str, count: int) -> str:
    """CTEs name0..count (nodes g, idx, h; a lone node goes up unchanged) and name_s0.. (what each level adds to a proof), from name0."""
    return ", ".join(
        f"""{name}_s{k} AS (
  SELECT g, idx, count(*) OVER (PARTITION BY g) AS n,
         coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k}),
{name}{k + 1} AS (
  SELECT g, idx // 16 AS idx, CASE WHEN (SELECT count(*) FROM {name}{k} o WHERE o.g = x.g) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h
  FROM {name}{k} x GROUP BY g, idx // 16)"""
        for k in range(count)
    )


def _folds(name: str, steps: str, count: int, key: str, idx: str) -> str:
    """CTEs name1..count: proof and fold of name0 after each level."""
    return ", ".join(
        f"""{name}{k + 1} AS (
  SELECT f.* REPLACE (f.proof || s.l || s.r AS proof, CASE WHEN s.n > 1 THEN sha256(s.l || f.fold || s.r) ELSE f.fold END AS fold)
  FROM {name}{k} f JOIN {steps}_s{k} s ON s.g = f.{key} AND s.idx = f.{idx} // {16**k})"""
        for k in range(count)
    )


def _manifest() -> str:
    def leaf(text: str) -> str:
        columns = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"

    return f"""
WITH {CRC_TABLE}, leaves AS (
  SELECT doc_id, coalesce('=' || source, '-') AS g, {leaf("text")} AS leaf,
         CASE WHEN {crc("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(LOWERED.format("text"))} ELSE {leaf("text")} END AS tampered
  FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
a0 AS (SELECT g, idx, leaf AS h FROM placed), {_levels("a", 6)},
tops AS (SELECT g AS source_g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS top_idx FROM a6),
b0 AS (SELECT 1 AS g, top_idx AS idx, h FROM tops), {_levels("b", 3)},
f0 AS (SELECT p.doc_id, p.g, p.idx, p.leaf, t.h AS subroot, 1 AS one, t.top_idx, '' AS proof, p.tampered AS fold FROM placed p JOIN tops t ON t.source_g = p.g),
{_folds("f", "a", 6, "g", "idx")},
e0 AS (SELECT * FROM f6), {_folds("e", "b", 3, "one", "top_idx")}
SELECT doc_id, leaf, subroot, (SELECT h FROM b3) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT h FROM b3) AS verified FROM e3
"""


ORACLE = {
    "op7_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)
), counts AS (
  SELECT key, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS min_doc
  FROM lines WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(c.n_docs >= 2 AND l.doc_id <> c.min_doc, false) AS gone
  FROM lines l LEFT JOIN counts c ON l.key = c.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_resampling": _resampling(),
    "op12_manifest": _manifest(),
}
