"""Quotation linking: reply-ordered conversations without quotes.

A message's lines carry quote levels (leading > marks, blanks between them allowed). Attribution lines that introduce a quote
("... wrote:") belong to it. Lines of level 0 are the message's own text. Quoted passages (runs of lines of one level), and
every line of them, are normalised (lower-cased words) and hashed, and so are the own passages and lines of all messages; the
hashes are joined, and each level's original is the earlier message that shares most words with it: first within the
conversation, then, for passages found nowhere in it, the first message anywhere that holds them.
The original of the shallowest level that has one is the parent (of level 1, unless that is not found); the originals of all levels
are the links of a message. A message without a resolved quote answers the one before it in its conversation (`quoted` tells the two apart);
a conversation's first message starts a tree. Parents are earlier messages by (conv_id, turn), so replies form trees;
root and depth come from pointer jumping. `position` is the place of a message in its tree by (conv_id, turn), from 1, which is a reply
order: no message stands before the one it answers. Long trees are numbered in ranges, so none has to fit in a task.

Defined cases: null or empty texts have no lines; quotes whose original is not found stay recorded (n_quotes) but link nothing;
several originals tie to the latest earlier turn; passages under min_words words (where scripts have no blanks, two characters count
as a word) link within their conversation only; repeated rows of one (conv_id, turn)
are one message, of which the greatest text counts; rows without conv_id or turn are left out; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, hash128, stored

MARKS = r"^(?:[\x20\t]*>)+[\x20\t]?"
ATTRIBUTION = r"(?i)^.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"


def _norm(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def levelled(messages: DataFrame) -> DataFrame:
    """messages with lines: array of (level, line), attribution lines at the level of the quote they introduce."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        level = F.char_length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.substr(line, F.char_length(marks) + 1).alias("line"))

    parsed = F.transform(lines, parse)

    def attributed(x: Column, i: Column) -> Column:
        after = F.get("__parsed", i + 1)["level"]
        return F.struct(F.when((after > x["level"]) & x["line"].rlike(ATTRIBUTION), after).otherwise(x["level"]).alias("level"), x["line"].alias("line"))

    return messages.withColumn("__parsed", parsed).withColumn("lines", F.transform("__parsed", attributed)).drop("__parsed")


def own_text(lines: Column) -> Column:
    kept = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return F.btrim(F.regexp_replace(kept, r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


def passages(lines: Column) -> Column:
    """Runs of lines of the same level, and each line of a run by itself: array of (level, text)."""
    single = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), x["line"].alias("text")))
    at = F.sequence(F.lit(0), F.size(lines) - 1)  # a text has one line at least
    starts = F.filter(at, lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(lines))
        return F.struct(F.get(lines, start)["level"].alias("level"), F.array_join(F.transform(F.slice(lines, start + 1, end - start), lambda x: x["line"]), " ").alias("text"))

    return F.array_distinct(F.concat(F.transform(starts, run), single))


def _n_words(key: Column) -> Column:
    dense = F.char_length(F.regexp_replace(key, r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]", ""))
    return F.greatest(F.size(F.split(key, " ")), F.floor(dense / 2).cast("int"))


def linked(conversations: DataFrame, min_words: int = 3) -> DataFrame:
    """conversations: conv_id, turn, role, text. Returns conv_id, turn, role, own_text, n_quotes, quoted, parent_conv, parent_turn, root_conv, root_turn, depth, position, links (array of level, conv_id, turn)."""
    known = conversations.where("conv_id is not null and turn is not null")
    one = known.groupBy("conv_id", "turn").agg(F.max("text").alias("text"), F.max_by("role", F.coalesce("text", F.lit(""))).alias("role"))
    rows = stored(levelled(one).select("conv_id", "turn", "role", own_text(F.col("lines")).alias("own_text"), F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("n_levels"), passages(F.col("lines")).alias("passages")), "quote-messages")
    before = in_order(rows.select("conv_id", "turn"), ["conv_id"], ["turn"])
    before = before.select("conv_id", (F.col("position") + 1).alias("position"), F.col("turn").alias("before_turn")).join(before, ["conv_id", "position"])

    hashed = rows.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", _norm(F.col("p.text")).alias("key"))
    hashed = hashed.where(F.col("key") != "").withColumn("words", _n_words(F.col("key")))
    hashed = stored(hashed.select("conv_id", "turn", "level", "words", hash128(F.col("key")).alias("h")).select("conv_id", "turn", "level", "words", "h.h1", "h.h2").distinct(), "quote-hashes")
    quotes = hashed.where("level > 0")
    if quotes.isEmpty():
        best = quotes.select("conv_id", "turn", "level", F.col("conv_id").alias("parent_conv"), F.col("turn").alias("parent_turn"))
    else:
        wanted = quotes.select("h1", "h2").distinct()
        own = stored(hashed.where("level = 0").select("conv_id", F.col("turn").alias("from_turn"), "h1", "h2").join(wanted, ["h1", "h2"], "left_semi"), "quote-originals")
        # the latest earlier turn of the conversation that holds the passage: one row a quote, however common the passage is
        near = quotes.join(own, ["conv_id", "h1", "h2"]).where("from_turn < turn").groupBy("conv_id", "turn", "level", "words", "h1", "h2").agg(F.max("from_turn").alias("parent_turn")).withColumn("parent_conv", F.col("conv_id"))
        near = stored(near, "quote-near")
        first = own.groupBy("h1", "h2").agg(F.min(F.struct(F.col("conv_id").alias("c"), F.col("from_turn").alias("t"))).alias("first"))
        rest = quotes.where(F.col("words") >= min_words).join(near.select("conv_id", "turn", "h1", "h2"), ["conv_id", "turn", "h1", "h2"], "left_anti").join(stored(first, "quote-first"), ["h1", "h2"])
        far = rest.where((F.col("first.c") < F.col("conv_id")) | ((F.col("first.c") == F.col("conv_id")) & (F.col("first.t") < F.col("turn"))))
        both = near.select("conv_id", "turn", "level", "words", "parent_conv", "parent_turn").unionByName(far.select("conv_id", "turn", "level", "words", F.col("first.c").alias("parent_conv"), F.col("first.t").alias("parent_turn")))
        votes = both.groupBy("conv_id", "turn", "level", "parent_conv", "parent_turn").agg(F.sum("words").alias("words"))
        rank = F.struct("words", (F.col("parent_conv") == F.col("conv_id")).cast("int"), "parent_conv", "parent_turn")
        best = votes.groupBy("conv_id", "turn", "level").agg(F.max_by(F.struct("parent_conv", "parent_turn"), rank).alias("p")).select("conv_id", "turn", "level", "p.*")
    links = F.array_sort(F.collect_list(F.struct("level", F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn"))))
    parents = best.groupBy("conv_id", "turn").agg(F.min_by(F.struct("parent_conv", "parent_turn"), "level").alias("p"), links.alias("links")).select("conv_id", "turn", "p.*", "links")
    parents = stored(parents, "quote-parents")
    # without a resolved quote: the turn before
    replies = before.join(parents.drop("links"), ["conv_id", "turn"], "full")
    replies = replies.select("conv_id", "turn", F.coalesce("parent_conv", "conv_id").alias("parent_conv"), F.coalesce("parent_turn", "before_turn").alias("parent_turn"))
    trees = rooted(replies)
    known = rows.select("conv_id", "turn", "role", "own_text", "n_levels").join(trees, ["conv_id", "turn"], "left").join(parents.select("conv_id", "turn", "links"), ["conv_id", "turn"], "left")
    known = stored(
        known.select("conv_id", "turn", "role", "own_text", F.col("n_levels").alias("n_quotes"), F.col("links").isNotNull().alias("quoted"), "parent_conv", "parent_turn",
                     F.coalesce("root_conv", "conv_id").alias("root_conv"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
                     F.coalesce("links", F.array()).alias("links")),
        "quote-linked",
    )
    order = in_order(known.select("root_conv", "root_turn", "conv_id", "turn"), ["root_conv", "root_turn"], ["conv_id", "turn"])
    return known.join(order.select("conv_id", "turn", "position"), ["conv_id", "turn"])


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with position: their place among the rows of their keys by order, from 1. Rows are dealt in ranges, so a long group takes many tasks."""
    dealt = stored(rows.repartitionByRange(*keys, *order).withColumn("range", F.spark_partition_id()), "quote-order")
    upto = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy(*keys, "range").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    here = dealt.withColumn("here", F.row_number().over(Window.partitionBy(*keys, "range").orderBy(*order)))
    return stored(here.join(ahead, [*keys, "range"]).select(*rows.columns, (F.col("here") + F.col("ahead")).alias("position")), "quote-positions")


def rooted(parents: DataFrame) -> DataFrame:
    """parents (conv_id, turn, parent_conv, parent_turn) with root_conv, root_turn and depth: pointers are doubled until all stand on roots.

    Rows that stand on a root leave the rounds, so a root with many replies is not joined again and again."""
    state = stored(parents.withColumns({"root_conv": F.col("parent_conv"), "root_turn": F.col("parent_turn"), "depth": F.lit(1), "open": F.lit(True)}), "quote-trees")
    while True:
        up = state.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("__c"), F.col("root_turn").alias("__t"), F.col("depth").alias("__d"))
        moved = F.col("__c").isNotNull()
        met = state.where("open").join(up, ["root_conv", "root_turn"], "left").select(
            "conv_id", "turn", "parent_conv", "parent_turn", F.coalesce("__c", "root_conv").alias("root_conv"),
            F.when(moved, F.col("__t")).otherwise(F.col("root_turn")).alias("root_turn"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"), moved.alias("open"),
        )
        new = stored(state.where("not open").unionByName(met), "quote-trees")
        forget(state)
        state = new
        if state.where("open").isEmpty():
            return state.drop("open")


def chat(messages: DataFrame) -> DataFrame:
    """linked() rows with chat: each message as a block of a chat template."""
    return messages.withColumn("chat", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("own_text"), F.lit("\n<|end|>")))


def conversations(messages: DataFrame, most: int = 256) -> DataFrame:
    """chat() rows as reply-ordered conversations without quotes: root_conv, root_turn, part, n_messages, text. A part holds at most `most` messages."""
    part = F.floor((F.col("position") - 1) / most).alias("part")
    held = messages.groupBy("root_conv", "root_turn", part).agg(F.array_sort(F.collect_list(F.struct("position", "chat"))).alias("m"))
    return held.select("root_conv", "root_turn", "part", F.size("m").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["chat"]), "\n").alias("text"))
