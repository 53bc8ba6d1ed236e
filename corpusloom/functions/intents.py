"""Question intents as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.columns import WORD_END, WORD_START, ColumnLike, choose, col, has_word, matches, one_of, squeeze, trim

# Hint words and phrases.
LOOKUP_HINTS = ["open", "find", "show", "locate", "which", "where", "file", "note", "document", "doc", "path", "folder"]
EXPLORATORY_HINTS = [
    "why", "how", "explain", "summarize", "summary", "compare", "tradeoffs", "tradeoff", "strategy", "plan",
]
CONTEXTUAL_WORDS = "how|why|compare|trade-?offs?|strategy|plan|summar(?:ize|y)|analy[sz]e"
DIRECT_SUBJECTS = "date|day|birthday|anniversary|deadline|interview|meeting|appointment|wedding"
SYNTHESIS_WORDS = "compare|difference|tradeoffs?|trade-offs?|pros|cons|strategy|summarize|summary|how|why|analyze"
SMALL_TALK = [
    "(hi|hey|hello|yo|sup|hola)[!. ]*",
    "(good (morning|afternoon|evening))[!. ]*",
    "(how are you|how's it going|how is it going)[?.! ]*",
    "(thanks|thank you|thx)[!. ]*",
    "(nice to meet you)[!. ]*",
]


def rerank_tokens(query: ColumnLike) -> Column:
    return matches(F.lower(col(query)), "[a-z0-9]{2,}")


def retrieval_intent(query: ColumnLike) -> Column:
    """``lookup`` for questions after one file, else ``exploratory``."""
    q = col(query)
    tokens = rerank_tokens(q)
    some = lambda words: F.exists(tokens, lambda t: one_of(t, words))
    phrase = has_word(q, "open|find|show|locate") | F.regexp_like(
        q, F.lit(f"(?i){WORD_START}(?:where|which){WORD_END}.+{WORD_START}(?:note|file|doc|document|path|folder){WORD_END}")
    )
    quoted = F.regexp_like(q, F.lit("[\"'][^\"']+[\"']"))
    return choose(
        (F.size(tokens) == 0, "exploratory"),
        (phrase | quoted, "lookup"),
        (some(EXPLORATORY_HINTS), "exploratory"),
        (some(LOOKUP_HINTS) & (F.size(tokens) <= 10), "lookup"),
        ((F.size(tokens) <= 5) & has_word(q, "note|file|doc|document"), "lookup"),
        otherwise="exploratory",
    )


def fact_intent(question: ColumnLike) -> Column:
    """``direct`` for questions one fact can answer, else ``contextual``."""
    q = trim(question)
    direct = (
        F.regexp_like(q, F.lit(f"(?i)^(?:when|what|who|where|which|is|are|was|were){WORD_END}"))
        | has_word(q, DIRECT_SUBJECTS)
        | F.regexp_like(q, F.lit(f"(?i){WORD_START}my{WORD_END}.+{WORD_START}(?:is|are|was|were){WORD_END}"))
    )
    return choose((has_word(q, CONTEXTUAL_WORDS), "contextual"), (direct, "direct"), otherwise="contextual")


def is_small_talk(question: ColumnLike) -> Column:
    q = squeeze(question)
    return (F.length(q).between(1, 64)) & F.regexp_like(q, F.lit(f"(?i)^(?:{'|'.join(SMALL_TALK)})$"))


def is_synthesis(question: ColumnLike) -> Column:
    return has_word(question, SYNTHESIS_WORDS)


def asks_when(question: ColumnLike) -> Column:
    return has_word(question, "when")
