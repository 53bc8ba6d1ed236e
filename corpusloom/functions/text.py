"""Text features as column expressions. Texts are always taken whole; ``max_chars`` narrows them on request."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.columns import (
    WHITESPACE,
    WORD_END,
    WORD_START,
    WS,
    ColumnLike,
    choose,
    col,
    has_word,
    let,
    matches,
    non_empty,
    one_of,
    squeeze,
    trim,
    whole_word,
)

# Stop words, one list for each use.
RELATED_STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "from", "into", "your", "you", "are", "was", "were",
    "have", "has", "had", "will", "would", "should", "could", "about", "what", "when", "where", "which",
    "their", "there", "then", "than", "them", "they", "our", "out", "not", "can", "just", "like", "also",
    "note", "notes", "todo", "done", "draft", "untitled", "file", "files",
]
RETRIEVAL_STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "from", "what", "when", "where", "who", "why",
    "how", "your", "my", "are", "was", "were", "is", "can", "could", "would", "should", "please",
    "about", "note", "notes", "tell", "me", "a", "an", "to", "in", "on", "of",
]
FACT_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "being", "been",
    "what", "when", "where", "who", "whom", "why", "how", "my", "your",
    "on", "in", "at", "to", "for", "of", "and", "or", "do", "does", "did",
    "can", "could", "would", "should", "please", "tell", "me",
]
PROBE_STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "when", "what", "where"]

# Counts and weights of the keyword ranking.
KEYWORD_LIMIT = 22
EARLY_TOKENS = 60
EARLY_BONUS = 0.7

MONTHS = (
    "jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august"
    "|sep|september|oct|october|nov|november|dec|december"
)
WEEKDAYS = "today|tomorrow|yesterday|monday|tuesday|wednesday|thursday|friday|saturday|sunday"


def _nfkc(text: Column) -> Column:
    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(normalize, "string")(text)


def sanitize_text(text: ColumnLike) -> Column:
    """Compatibility-normalize, blank control and private-use characters, collapse white space."""
    unwanted = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\uE000-\\uF8FF]"
    return squeeze(F.regexp_replace(_nfkc(col(text)), unwanted, " "))


def content_hash(text: ColumnLike) -> Column:
    """32-bit FNV-1a over UTF-16 units as 8 hex digits."""

    def step(state: Column, unit: Column) -> Column:
        return (state.bitwiseXOR(unit) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))

    def absorb(state: Column, code: Column) -> Column:
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(code < 0x10000, step(state, code)).otherwise(step(step(state, high), low))

    codes = F.transform(non_empty(F.split(col(text), "")), lambda c: F.ascii(c).cast("bigint"))
    return F.lpad(F.lower(F.hex(F.aggregate(codes, F.lit(2166136261).cast("bigint"), absorb))), 8, "0")


# Characters that a text's make-up is told by, as bytes.
_LETTERS, _DIGITS = (bytes(c for c in range(128) if chr(c).isalpha()), bytes(range(48, 58)))


def _make_up(text: Column) -> Column:
    """Counts of a trimmed text: characters, words, distinct words, characters but white space, letters and digits."""

    def counted(texts: pd.Series, lowered: pd.Series) -> pd.DataFrame:
        word = re.compile("[a-z]{2,}")

        def counts(body: str | None, lower: str | None) -> tuple[int | None, ...]:
            if body is None or lower is None:
                return (None,) * 6
            words = word.findall(lower)
            # Letters and digits are ASCII, and no other character's bytes in UTF-8 are.
            raw = body.encode("utf-8", "surrogatepass")
            letters, digits = (len(raw) - len(raw.translate(None, chars)) for chars in (_LETTERS, _DIGITS))
            solid = len(body) - sum(map(body.count, WHITESPACE))
            return len(body), len(words), len(set(words)), solid, letters, digits

        names = ["chars", "words", "distinct", "solid", "letters", "digits"]
        return pd.DataFrame([counts(*row) for row in zip(texts, lowered)], columns=names).astype("Int32")

    schema = "chars int, words int, distinct int, solid int, letters int, digits int"
    return F.pandas_udf(counted, schema)(text, F.lower(text))


def extraction_features(text: ColumnLike) -> Column:
    def features(c: Column) -> Column:
        share = lambda part: F.when(c["solid"] > 0, part / c["solid"]).otherwise(0.0)
        return F.struct(
            c["chars"].alias("chars"),
            c["words"].alias("words"),
            F.when(c["words"] > 0, c["distinct"] / c["words"]).otherwise(0.0).alias("unique_ratio"),
            share(c["letters"]).alias("letter_ratio"),
            share(c["digits"]).alias("digit_ratio"),
            share(c["solid"] - c["letters"] - c["digits"]).alias("punct_ratio"),
        )

    return let(_make_up(trim(text)), features)


def extraction_quality(text: ColumnLike) -> Column:
    """Struct of quality, score and reason, from length and character make-up."""

    def verdict(quality: str, score: float, reason: str) -> Column:
        return F.struct(
            F.lit(quality).alias("quality"), F.lit(score).alias("score"), F.lit(reason).alias("reason")
        )

    def rules(f: Column) -> Column:
        noisy = (
            (f.letter_ratio < 0.38)
            | ((f.digit_ratio > 0.34) & (f.letter_ratio < 0.52))
            | (f.punct_ratio > 0.28)
        )
        return choose(
            ((f.chars < 60) | (f.words < 12), verdict("low", 0.1, "Very little extracted text was available.")),
            (noisy, verdict("low", 0.2, "Extracted text looks noisy, form-like, or poorly structured.")),
            (
                f.unique_ratio < 0.28,
                verdict("medium", 0.48, "Extracted text is repetitive, so foldering should stay conservative."),
            ),
            (
                (f.chars < 240) | (f.words < 45),
                verdict("medium", 0.62, "Extracted text is usable but limited in detail."),
            ),
            otherwise=verdict("high", 0.88, "Extracted text looks detailed enough for file-aware organization."),
        )

    return let(extraction_features(text), rules)


def _window(text: ColumnLike, max_chars: int | None) -> Column:
    return col(text) if max_chars is None else F.substring(col(text), 1, max_chars)


def weighted_tokens(tokens: Column, early: int, early_bonus: float, base: float = 1.0) -> Column:
    """Distinct tokens of one array with weight and first position, without leaving the row.

    Sorting (token, position) pairs puts equal tokens side by side, so each run gives one token.
    """

    def runs(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        starts = F.filter(
            F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (F.get(pairs, i)["token"] != F.get(pairs, i - 1)["token"]),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, k: let(
                    F.coalesce(F.get(s, k + 1), F.size(pairs)) - start,
                    lambda n: F.struct(
                        (
                            n * F.lit(base)
                            + F.lit(early_bonus)
                            * F.size(F.filter(F.slice(pairs, start + 1, n), lambda p: p["pos"] < early))
                        ).alias("weight"),
                        F.get(pairs, start)["pos"].alias("pos"),
                        F.get(pairs, start)["token"].alias("token"),
                    ),
                ),
            ),
        )

    pairs = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("pos"))))
    return let(pairs, runs)


def related_tokens(text: ColumnLike) -> Column:
    return F.filter(matches(F.lower(col(text)), "[a-z0-9]{3,}"), lambda t: ~one_of(t, RELATED_STOP_WORDS))


def top_keywords(text: ColumnLike, limit: int = KEYWORD_LIMIT, max_chars: int | None = None) -> Column:
    """Most weighted tokens, ties by first occurrence; early tokens weigh more."""
    weighted = weighted_tokens(related_tokens(_window(text, max_chars)), EARLY_TOKENS, EARLY_BONUS)
    # Rounding keeps float noise from deciding ties.
    keyed = F.transform(
        weighted, lambda w: F.struct((-F.round(w["weight"], 6)).alias("rank"), w["pos"].alias("pos"), w["token"].alias("token"))
    )
    return F.transform(F.slice(F.sort_array(keyed), 1, limit), lambda w: w["token"])


# What counts as a named entity, in order of precedence.
ENTITY_PATTERNS = [
    "[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,2}",
    "[A-Z]{2,}",
    "(?:Jan|January|Feb|February|Mar|March|Apr|April|May|Jun|June|Jul|July|Aug|August|Sep|September"
    "|Oct|October|Nov|November|Dec|December)\\s+[0-9]{1,2}(?:,\\s*[0-9]{4})?",
    "[0-9]{4}-[0-9]{2}-[0-9]{2}",
]


def entities(text: ColumnLike, limit: int | None = None, max_chars: int | None = None) -> Column:
    """Distinct named entities in pattern order, all of them unless `limit` keeps the first ones."""
    body = _window(text, max_chars)
    found = F.concat(*[matches(body, WORD_START + pattern + WORD_END) for pattern in ENTITY_PATTERNS])
    named = F.filter(F.transform(found, lambda e: F.lower(trim(e))), lambda e: F.length(e) >= 2)
    return first_of(F.array_distinct(named), limit)


def sentences(text: ColumnLike, max_chars: int | None = None) -> Column:
    marked = F.regexp_replace(_window(text, max_chars), "([.?!])" + WS + "+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), squeeze), lambda s: F.length(s) >= 6)


def looks_date_like(value: ColumnLike) -> Column:
    text = col(value)
    numeric = f"{WORD_START}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{WORD_END}"
    short = f"{WORD_START}[0-9]{{1,2}}[/-][0-9]{{1,2}}(?:[/-][0-9]{{2,4}})?{WORD_END}"
    return (
        F.regexp_like(text, F.lit(numeric))
        | F.regexp_like(text, F.lit(short))
        | has_word(text, MONTHS)
        | has_word(text, WEEKDAYS)
    )


# The first digit comes before what may not stand before it, so that most characters fail at once.
_ISO_MONTH = f"(2(?<![A-Za-z0-9_]2)0[0-9]{{2}})[-_/]([0-9]{{1,2}})(?:[-_/]([0-9]{{1,2}}))?{WORD_END}"
_NAMED_MONTH = (
    f"(?i){WORD_START}(january|february|march|april|may|june|july|august|september|october|november|december"
    f"|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec){WORD_END}"
    "[\\s,-]*([0-9]{1,2})?(?:[\\s,-]*(20[0-9]{2}))?"
)


def parse_month(value: ColumnLike) -> Column:
    """Struct of year and month; the year is null when only a month name is given.

    The text is searched once for each form; the parts are taken from what was found.
    """
    text = col(value)

    def dated(found: Column) -> Column:
        year, month = (F.regexp_extract(found, _ISO_MONTH, i).try_cast("int") for i in (1, 2))
        return F.when((found != "") & month.between(1, 12), F.struct(year.alias("year"), month.alias("month")))

    def named(found: Column) -> Column:
        name = F.lower(F.left(F.regexp_extract(found, _NAMED_MONTH, 1), F.lit(3)))
        number = F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), name) + 2) / 3).cast("int")
        year = F.nullif(F.regexp_extract(found, _NAMED_MONTH, 3), F.lit("")).try_cast("int")
        return F.when(found != "", F.struct(year.alias("year"), number.alias("month")))

    return F.coalesce(let(F.regexp_extract(text, _ISO_MONTH, 0), dated), let(F.regexp_extract(text, _NAMED_MONTH, 0), named))


def timeline_date(path: ColumnLike, text: ColumnLike, modified_at: ColumnLike) -> Column:
    """Year and month of a document: from its path, else its text, else its modification time (UTC)."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(col(modified_at)) / 86400).cast("int"))
    own = F.when(
        col(modified_at).isNotNull(), F.struct(F.year(day).alias("year"), F.month(day).alias("month"))
    )
    return let(
        parse_month(path),
        lambda p: F.coalesce(
            F.when(p["year"].isNotNull(), p),
            let(
                parse_month(text),
                lambda t: F.coalesce(
                    F.when(t["year"].isNotNull(), t),
                    F.when(
                        t["month"].isNotNull() & col(modified_at).isNotNull(),
                        F.struct(F.year(day).alias("year"), t["month"].alias("month")),
                    ),
                ),
            ),
            own,
        ),
    )


def excerpt(text: ColumnLike, max_chars: int = 220) -> Column:
    compact = squeeze(text)
    return let(
        compact,
        lambda t: F.when(F.length(t) <= max_chars, t).otherwise(
            F.concat(F.regexp_replace(F.left(t, F.lit(max(1, max_chars - 1))), WS + "+$", ""), F.lit("…"))
        ),
    )


def first_of(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def query_terms(text: ColumnLike, variant: str = "retrieval", limit: int | None = None) -> Column:
    """Search terms of a question, all of them by default. Variants differ in stop words and distinctness."""
    words = matches(F.lower(col(text)), "[a-z0-9]{2,}")
    if variant in ("retrieval", "highlight"):
        return first_of(F.filter(F.array_distinct(words), lambda t: ~one_of(t, RETRIEVAL_STOP_WORDS)), limit)
    if variant == "facts":
        return first_of(F.filter(words, lambda t: ~one_of(t, FACT_STOP_WORDS)), limit)
    if variant == "rerank":
        return first_of(words, limit)
    raise ValueError(f"unknown variant {variant!r}")


def best_snippet(text: ColumnLike, question: ColumnLike, max_chars: int = 220, max_lines: int | None = None) -> Column:
    """The line sharing most terms with the question, cut around the first term when long."""
    lines = non_empty(F.transform(F.split(col(text), "\n"), squeeze))
    if max_lines is not None:
        lines = F.slice(lines, 1, max_lines)

    def pick(body: Column, terms: Column) -> Column:
        def score(line: Column) -> Column:
            return F.aggregate(
                terms,
                F.lit(0),
                lambda acc, t: acc
                + F.when(F.contains(line, t), F.when(F.length(t) >= 5, 2).otherwise(1)).otherwise(0),
            )

        ranked = F.transform(body, lambda line, i: F.struct((-score(F.lower(line))).alias("s"), i.alias("i")))
        return F.get(body, F.array_min(ranked)["i"])

    def shorten(line: Column, terms: Column) -> Column:
        positions = F.filter(F.transform(terms, lambda t: F.instr(F.lower(line), t)), lambda p: p > 0)
        first = F.array_min(positions)
        start = F.greatest(F.lit(0), first - 1 - 70)
        around = F.concat(
            F.when(start > 0, "…").otherwise(""),
            F.substring(line, start + 1, F.lit(max_chars)),
            F.when(start + max_chars < F.length(line), "…").otherwise(""),
        )
        return choose(
            (F.length(line) <= max_chars, line),
            (first.isNotNull(), around),
            otherwise=F.concat(F.regexp_replace(F.left(line, F.lit(max_chars - 1)), WS + "+$", ""), F.lit("…")),
        )

    return let(
        query_terms(question),
        lambda terms: F.coalesce(
            let(let(lines, lambda body: pick(body, terms)), lambda line: shorten(line, terms)), F.lit("")
        ),
    )


def match_snippet(text: ColumnLike, query: ColumnLike) -> Column:
    """Text around the whole query, else around the first query token that occurs, else the beginning."""
    flat = F.replace(col(text), F.lit("\n"), F.lit(" "))

    def place(lowered: Column, needle: Column) -> Column:
        """One-based position of the query or of its first token that occurs; 0 when none does."""
        token = F.get(
            F.filter(non_empty(F.split(needle, WS + "+")), lambda t: F.contains(lowered, t)), F.lit(0)
        )
        return let(
            F.instr(lowered, needle),
            lambda whole: F.when(whole > 0, whole).otherwise(F.coalesce(F.instr(lowered, token), F.lit(0))),
        )

    def cut(body: Column, at: Column) -> Column:
        start = F.greatest(F.lit(0), at - 71)
        return trim(F.when(at == 0, F.left(body, F.lit(180))).otherwise(F.substring(body, start + 1, at + 139 - start)))

    return let(
        flat,
        lambda body: let(
            let(F.lower(trim(query)), lambda needle: let(F.lower(body), lambda lowered: place(lowered, needle))),
            lambda at: cut(body, at),
        ),
    )


def snippet_preview(snippet: ColumnLike, tokens: ColumnLike, max_chars: int = 220) -> Column:
    """A keyword hit's snippet, cut around the first token when longer than ``max_chars``."""

    def cut(line: Column) -> Column:
        positions = F.filter(F.transform(col(tokens), lambda t: F.instr(F.lower(line), t)), lambda p: p > 0)
        first = F.array_min(positions)
        start = F.greatest(F.lit(0), first - 1 - 70)
        head = F.concat(F.regexp_replace(F.left(line, F.lit(max_chars - 3)), WS + "+$", ""), F.lit("..."))
        around = F.concat(
            F.when(start > 0, "...").otherwise(""),
            trim(F.substring(line, start + 1, F.lit(max_chars))),
            F.when(start + max_chars < F.length(line), "...").otherwise(""),
        )
        return choose((F.length(line) <= max_chars, line), (first.isNotNull(), around), otherwise=head)

    return let(squeeze(snippet), cut)


def snippet_probes(snippet: ColumnLike) -> Column:
    """Terms to look a snippet up by: its two longest distinct tokens, then its first six words."""
    clean = squeeze(F.replace(col(snippet), F.lit("…"), F.lit(" ")))

    def probes(text: Column) -> Column:
        tokens = F.array_distinct(
            F.filter(matches(text, "[A-Za-z0-9]{3,}"), lambda t: ~one_of(F.lower(t), PROBE_STOP_WORDS))
        )
        ranked = F.sort_array(
            F.transform(tokens, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("token")))
        )
        longest = F.transform(F.slice(ranked, 1, 2), lambda r: r["token"])
        words = F.slice(non_empty(F.split(text, " ")), 1, 6)
        phrase = F.when(F.size(words) >= 2, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(longest, phrase))

    return let(clean, probes)


def strip_markup(text: ColumnLike) -> Column:
    """Text outside tags, with the five XML entities decoded and white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(col(text), "<[^>]*>", " "), ">", " ")
    bare = F.regexp_replace(bare, "<[^>]*$", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return squeeze(bare)


def compact_lines(text: ColumnLike) -> Column:
    lines = F.split(F.replace(col(text), F.lit("\u0000"), F.lit(" ")), "\r?\n")
    return F.array_join(non_empty(F.transform(lines, trim)), "\n")
