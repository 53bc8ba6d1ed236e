"""Quotation linking: conversations in reply order, without the quotes that say who answers whom.

Every message is split into its own passages and the passages it quotes, by nested quote level. Normalised passages and
their lines are hashed, and a quote joins the first message that wrote the same words itself. A hash has one original at
most in a conversation, so a common phrase joins each of its quotes once. The shallowest level that finds an original
names the message replied to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, salt_mask, salt_of, salts_in, saved, spread_join

QUOTE = r"^((?:[ \t]*>)+)[ \t]?"
# The lines with which mail programs introduce a quote.
ATTRIBUTION = r"(?i)^[ \t>]*(?:on\b.{4,200}\bwrote|am\b.{4,200}\bschrieb\b.{0,120}|le\b.{4,200}\ba [eé]crit|el\b.{4,200}\bescribi[oó])[ \t]*:[ \t]*$"


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Punct}]+", " "))


def quote_lines(text: Column) -> Column:
    """array<struct<at, level, content>>: the lines with their quote level, 0 for the writer's own."""
    return F.transform(
        F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"),
        lambda line, at: F.struct(
            at.alias("at"), (F.length(F.regexp_extract(line, QUOTE, 1)) - F.length(F.replace(F.regexp_extract(line, QUOTE, 1), F.lit(">"), F.lit("")))).alias("level"),
            F.regexp_replace(line, QUOTE, "").alias("content"),
        ),
    )


def own_text(lines: str = "lines") -> Column:
    """The writer's own lines, without the line that introduces a quote; trimmed, three or more line feeds become two."""
    mine = F.filter(
        F.col(lines),
        lambda x: (x.level == 0)
        & ~(x.content.rlike(ATTRIBUTION) & (F.coalesce(F.get(F.col(lines), x["at"] + 1).level, F.lit(0)) > 0)),
    )
    joined = F.array_join(F.transform(mine, lambda x: x.content), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n"), r"^\s+|\s+$", "")


def _passages(rows: DataFrame) -> DataFrame:
    """From conv, turn, lines: conv, turn, level, words, chars; runs of neighbouring lines of one level, and the lines themselves.

    Passages of any length count; only those empty after normalisation go. A message's own text also counts as one
    passage, as quotes often cover all of it. Work stays within the row and grows with its length.
    """
    line = lambda i: F.get("lines", i)
    n = F.size("lines")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (line(i).level != line(i - 1).level) | (F.trim(line(i).content) == ""))
    rows = rows.where(n > 0).select("conv", "turn", "lines", "own", starts.alias("starts"))
    ends = F.concat(F.slice("starts", 2, n), F.array(n))

    def run(start: Column, end: Column) -> Column:
        text = F.array_join(F.transform(F.slice("lines", start + 1, end - start), lambda x: x.content), "\n")
        return F.struct(line(start).level.alias("level"), text.alias("text"))

    single = F.transform("lines", lambda x: F.struct(x.level.alias("level"), x.content.alias("text")))
    whole = F.array(F.struct(F.lit(0).alias("level"), F.col("own").alias("text")))
    out = rows.select("conv", "turn", F.explode(F.concat(F.zip_with("starts", ends, run), single, whole)).alias("p")).select(
        "conv", "turn", "p.level", normalise(F.col("p.text")).alias("words")
    )
    return out.where(F.length("words") > 0).select("conv", "turn", "level", F.sha2("words", 256).alias("hash"), F.length("words").alias("chars")).distinct()


def reply_links(rows: DataFrame) -> DataFrame:
    """From conv, turn, lines, own: conv, turn, reply_to. Messages that quote nothing known have no row."""
    passages = saved(_passages(rows).withColumn("salt", salt_of(F.col("turn"), F.col("conv"))), "passages")
    quoted = passages.where("level > 0")
    wanted = quoted.groupBy("conv", "hash").agg(salt_mask("salt").alias("mask"))
    first = passages.where("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    originals = first.join(wanted, ["conv", "hash"]).select("conv", "hash", "original", salts_in("mask").alias("salt"))
    found = quoted.join(originals, ["conv", "hash", "salt"]).where("original < turn")
    votes = found.groupBy("conv", "turn", "level", "original").agg(F.sum("chars").alias("chars"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "chars", "original")).alias("best")
    return votes.groupBy("conv", "turn").agg(best).select("conv", "turn", F.col("best.original").alias("reply_to"))


def reply_roots(links: DataFrame) -> DataFrame:
    """From conv, turn, reply_to: conv, turn, thread (the turn of the thread's first message), depth (replies from there).

    Pointer doubling: each round a message asks the furthest message that it knows of for the furthest that this one
    knows. A message answers earlier ones only, so there are no circles, and rounds are the logarithm of the longest
    chain of replies.
    """
    state = saved(links.select("conv", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("depth"), F.lit(False).alias("done")), "threads")
    while not state.where("not done").isEmpty():
        known = state.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        asked = spread_join(state.withColumn("by", F.xxhash64("turn")), known, ["conv", "thread"], "by", "left")
        after = saved(
            asked.select(
                "conv", "turn", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("further").isNull().alias("done"),
            ),
            "threads",
        )
        discard(state)
        state = after
    return state.drop("done")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """One row for each message: conv_id, turn, role, text (own words), reply_to, thread, depth, n_quoted.

    Messages are linked within their conversation. Order by conv_id, thread, turn for the conversation in reply order:
    each thread in one piece, and each message after the one that it answers. `thread` is the turn of the thread's first
    message; a message that quotes nothing known starts a thread at its own turn. A message without conversation or turn
    is not linked, and has no thread. A null text is empty; a message that only quotes keeps an empty text. Rows that
    repeat a turn count as one message when linked and are all returned. Other columns are ignored.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"),
        quote_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"),
    )
    rows = rows.withColumns({"own": own_text(), "n_quoted": F.size(F.filter("lines", lambda x: x.level > 0))})
    placed = rows.where("conv is not null and turn is not null")
    links = saved(reply_links(placed), "replies")
    answered = links.join(reply_roots(links), ["conv", "turn"])
    slim = rows.select("conv", "turn", "role", "own", "n_quoted", F.xxhash64("role", "own").alias("by"))
    return spread_join(slim, answered, ["conv", "turn"], "by", "left").select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("own").alias("text"), "reply_to",
        F.coalesce("thread", F.when(F.col("conv").isNotNull(), F.col("turn"))).alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), "n_quoted",
    )
