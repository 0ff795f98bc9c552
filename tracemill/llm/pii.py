"""Personal data by fixed patterns and by bootstrapped contextual extraction, in DataFrame operations only.

Base spans are the matches of four patterns (email, ip, card, phone) that pass their checks. They are the seeds of
the bootstrap, with long hexadecimal words as seeds of a further kind, secret, which has no base spans. Other
identifier-like words (among them groups of digits parted by blanks) are candidates. What stands around a seed makes lexical
patterns: the word before, with what stands between (`token = "`), two words before, the words before and after, each without
regard to what the identifier looks like, and the word before together with the shape (characters and length). Patterns and
instances form a bipartite graph that is scored in rounds, each one join and aggregation:

* confidence of a pattern = confident instances it holds / all instances it holds (shrunk by one unseen miss);
* confidence of an instance of a kind = that of its best pattern of the kind (patterns of one place are nested, so they don't add up);
* instances at or above `accept` join the seeds of the next round.

A pattern counts only with min_support different seed instances. After the last round every candidate (and secret seed) held by an
accepted pattern is a span of the pattern's kind.

Defined cases: null and empty texts have no spans; equal documents get equal spans; a tie between kinds for a candidate goes to
the higher confidence, then the kind listed first; rows without doc_id and repeated rows are reported like others; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: A kind that only the bootstrap finds, and what its seeds look like.
SECRET, SECRET_SEED = len(KINDS), r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,64}$"
NAMES = (*KINDS, "secret")

#: The base patterns. Possessive quantifiers and the look-behind only keep them linear on long runs; matches are
#: those of the plain forms, since a run that fails from its start (or from the last match) fails from every later start.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these characters has no match of the kind: skips the pattern.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
#: An identifier-like word: groups of digits parted by single blanks, or six characters or more with an at sign or four digits;
#: after white space, a bracket or a quote.
CANDIDATE = (
    r"(?<![^\x20\x09-\x0D(\[\"'])(?:[0-9]{2,6}(?:\x20[0-9]{2,6}){1,5}(?![0-9A-Za-z])"
    r"|(?=[^\x20\x09-\x0D]{0,64}@|(?:[^0-9\x20\x09-\x0D]{0,16}[0-9]){4})[A-Za-z0-9+][A-Za-z0-9._%+@()-]{4,126}[A-Za-z0-9])"
)


def _located(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their code point positions: pieces between matches and matches take turns."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.char_length(pair["piece"])
        end = at + F.char_length(pair["value"])
        span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.filter(F.arrays_zip(pieces.alias("piece"), found.alias("value")), lambda p: p["value"].isNotNull())
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))),
        F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)),
    )
    return total % 10 == 0


def _check(kind: str):
    return lambda span: _passes(kind, span["value"])


def of_kind(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind."""
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 4).cast("int") <= 255))
    n = F.char_length(_digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    none = F.array().cast(SPAN)
    parts = []
    for i, kind in enumerate(KINDS):
        found = F.filter(_located(text, PATTERNS[kind], i), _check(kind))
        may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]")
        parts.append(F.when(may, found).otherwise(none))
    return F.array_sort(F.concat(*parts), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def shape(value: Column) -> Column:
    """What an identifier looks like (at, plus, dotted, number, groups; mixed holds letters and is none of these) and its length in fours."""
    look = (
        F.when(F.contains(value, F.lit("@")), "at").when(F.startswith(value, F.lit("+")), "plus")
        .when(value.rlike("[A-Za-z]"), "mixed").when(value.rlike(r"^[0-9]+(?:\.[0-9]+)+$"), "dotted").when(F.contains(value, F.lit(" ")), "groups").otherwise("number")
    )
    return F.concat(look, F.ceil(F.char_length(value) / 4).cast("string"))


def _around(text: Column, start: Column, end: Column) -> Column:
    """Up to 64 characters on both sides of a span, as a struct of lower-cased before and after."""
    before = F.substring(text, F.greatest(F.lit(1), start - 63), F.least(start, F.lit(64)))
    return F.struct(F.lower(before).alias("before"), F.lower(F.substring(text, end + 1, F.lit(64))).alias("after"))


def lexical(before: Column, after: Column, looks: Column) -> Column:
    """The patterns that hold an identifier, as texts; none where no word stands before."""
    word = F.regexp_extract(before, r"([\p{L}\p{N}_]+)[^\p{L}\p{N}_]*$", 1)
    close = F.btrim(F.regexp_replace(F.regexp_extract(before, r"([\p{L}\p{N}_]+[^\p{L}\p{N}_]*)$", 1), r"[\x20\x09-\x0D]+", " "))
    two = F.regexp_replace(F.regexp_extract(before, r"([\p{L}\p{N}_]+[^\p{L}\p{N}_]+[\p{L}\p{N}_]+)[^\p{L}\p{N}_]*$", 1), r"[^\p{L}\p{N}_]+", " ")
    following = F.regexp_extract(after, r"^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)", 1)
    made = F.array(
        F.concat(F.lit("word "), close), F.when(two != "", F.concat(F.lit("two "), two)),
        F.when(following != "", F.concat(F.lit("both "), word, F.lit(" _ "), following)), F.concat(F.lit("shape "), word, F.lit(" "), looks),
    )
    return F.when(word != "", F.array_compact(made)).otherwise(F.array().cast("array<string>"))


def contexts(docs: DataFrame) -> DataFrame:
    """docs (uid, text, base) as one row per seed or candidate: uid, kind (null for candidates), start, end, value, patterns."""

    def rows(spans: Column) -> DataFrame:
        seen = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _around(F.col("text"), s["start"], s["end"]).alias("around")))
        return docs.select("uid", F.explode(seen).alias("s")).select("uid", "s.*")

    clear = F.filter(
        F.when(F.col("text").rlike("@|[0-9]"), _located(F.col("text"), CANDIDATE, -1)).otherwise(F.array().cast(SPAN)),
        lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])),
    )
    kind = F.when(F.col("kind") >= 0, F.col("kind")).when(F.col("value").rlike(SECRET_SEED), F.lit(SECRET))
    return rows(F.concat(F.col("base"), clear)).select("uid", kind.alias("kind"), "start", "end", "value", lexical(F.col("around.before"), F.col("around.after"), shape(F.col("value"))).alias("patterns"))


def bootstrapped(seen: DataFrame, rounds: int = 3, accept: float = 0.8, min_support: int = 3) -> DataFrame:
    """The spans that contexts add: uid, kind, start, end, value. seen: as from contexts()."""
    links = stored(seen.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct(), "pii-links")
    seeds = stored(links.where("kind is not null").select("kind", "value").distinct().withColumn("conf", F.lit(1.0)), "pii-seeds")
    edges = stored(links.select("pattern", "value").distinct(), "pii-edges")
    held = stored(edges.groupBy("pattern").agg(F.count("*").alias("instances")), "pii-held")
    for _ in range(rounds):
        known = edges.join(seeds, "value").groupBy("pattern", "kind").agg(F.sum("conf").alias("good"), F.count("*").alias("support"))
        pattern = stored(known.where(F.col("support") >= min_support).join(held, "pattern").select("pattern", "kind", (F.col("good") / (F.col("instances") + 1)).alias("conf")), "pii-patterns")
        instance = links.where("kind is null").select("pattern", "value").join(pattern, "pattern").groupBy("value", "kind").agg(F.max("conf").alias("conf"))
        grown = instance.where(F.col("conf") >= accept).join(seeds.select("kind", "value"), ["kind", "value"], "left_anti")
        more = stored(seeds.unionByName(grown.select("kind", "value", "conf")), "pii-seeds")
        done, seeds = more.count() == seeds.count(), more
        if done:
            break
    sure = pattern.where(F.col("conf") >= accept).withColumnRenamed("kind", "k")
    place = seen.where((F.col("kind").isNull()) | (F.col("kind") == SECRET)).select("uid", "start", "end", "value", F.explode("patterns").alias("pattern"))
    best = place.join(sure, "pattern").groupBy("uid", "start", "end", "value").agg(F.max_by("k", F.struct("conf", -F.col("k"))).alias("kind"))
    return best.select("uid", "kind", "start", "end", "value")


def found(docs: DataFrame, **options) -> DataFrame:
    """doc_id with base and spans (arrays of kind, start, end, value) for every row of docs (doc_id, text)."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).select("uid", "doc_id", base_spans(F.col("text")).alias("base"), F.when(F.col("text").rlike("@|[0-9]"), F.col("text")).alias("text")), "pii-base")
    seen = stored(contexts(rows.where("text is not null")), "pii-contexts")
    more = bootstrapped(seen, **options).groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("more"))
    both = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    return rows.drop("text").join(stored(more, "pii-more"), "uid", "left").select("doc_id", "base", both.alias("spans"))
