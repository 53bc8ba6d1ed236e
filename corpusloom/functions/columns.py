"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Characters JavaScript's \s and trim() treat as white space.
WHITESPACE = " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
# ASCII word boundaries; Java's own \b is Unicode-aware.
WORD_START = "(?<![A-Za-z0-9_])"
WORD_END = "(?![A-Za-z0-9_])"


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(value: ColumnLike) -> Column:
    return F.btrim(col(value), F.lit(WHITESPACE))


def squeeze(value: ColumnLike) -> Column:
    """Collapse white space to single spaces and trim."""
    return F.btrim(F.regexp_replace(col(value), WS + "+", " "), F.lit(" "))


def whole_word(alternatives: str) -> str:
    """Case-insensitive pattern matching any alternative as whole ASCII words."""
    return f"(?i){WORD_START}(?:{alternatives}){WORD_END}"


def has_word(value: ColumnLike, alternatives: str) -> Column:
    return F.regexp_like(col(value), F.lit(whole_word(alternatives)))


def matches(value: ColumnLike, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(value), F.lit(pattern), F.lit(group))


def non_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def one_of(value: Column, values: list[str]) -> Column:
    return value.isin(*values)


def choose(*branches: tuple[Column, Column | str], otherwise: Column | str | None = None) -> Column:
    """First branch whose condition holds, as one CASE WHEN."""
    chain = None
    for condition, result in branches:
        result = F.lit(result) if not isinstance(result, Column) else result
        chain = F.when(condition, result) if chain is None else chain.when(condition, result)
    if otherwise is not None:
        chain = chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
    return chain


def labels(*pairs: tuple[Column, str]) -> Column:
    """Array of the labels whose conditions hold, in the given order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in pairs]))
