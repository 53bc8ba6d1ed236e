"""Extracted facts: extraction, upkeep, and answering questions from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import intents as it
from corpusloom.functions.columns import WORD_START, choose, matches, squeeze, trim
from corpusloom.functions.paths import is_retrievable, normalize_path
from corpusloom.functions.text import looks_date_like, query_terms, sentences
from corpusloom.operators.scoring import best_texts

MIN_MATCH = 0.24

# The sentence shapes that state a fact. Group 1 is the subject, group 2 the value;
# then the confidence when the value looks like a date, and otherwise; last a cheap necessary condition.
EVENT_NOUNS = "day|date|birthday|anniversary|meeting|appointment|deadline|interview|wedding|event|call"
SHAPES = [
    (
        f"(?:my\\s+)?([a-z][a-z0-9\\s]{{1,60}}?(?:{EVENT_NOUNS}))\\s+(?:is|was|will be)\\s+(?:on\\s+)?([^.;\\n]{{2,80}})",
        0.96, 0.82, f"(?:{EVENT_NOUNS})\\s+(?:is|was|will be)\\s",
    ),
    ("my\\s+([a-z][a-z0-9\\s]{1,40})\\s+(?:is|are|was|were)\\s+([^.;\\n]{2,90})", 0.88, 0.76, "my\\s"),
]
LINE_SHAPE = ("^([A-Za-z][A-Za-z0-9 /-]{1,50}):\\s*([^.;\\n]{2,90})$", 0.90, 0.74)
FALLBACK_SHAPE = ("(wedding day)[^a-z0-9]{0,8}([^\\n.;]{2,50})", 0.70, 0.70)


def _stated(sentence: Column, pattern: str, dated: float, other: float) -> Column:
    """Array of (subject, value, confidence when dated, confidence otherwise) for all matches of one shape."""
    return F.zip_with(
        matches(sentence, pattern, 1), matches(sentence, pattern, 2),
        lambda s, v: F.struct(
            F.regexp_replace(squeeze(s), "(?i)^my\\s+", "").alias("subject"), squeeze(v).alias("value"),
            F.lit(dated).alias("dated"), F.lit(other).alias("other"),
        ),
    )


def extract_facts(documents: DataFrame, max_chars: int | None = None, max_facts: int | None = None) -> DataFrame:
    """Facts of each document, one for each subject and value: the most confident statement, first on ties.

    All of them by default; `max_facts` keeps the first ones of each document.
    """
    docs = documents.select(normalize_path("path").alias("path"), "content").filter(is_retrievable("path"))
    lines = docs.select("path", F.posexplode(sentences("content", max_chars)).alias("line", "statement"))
    s = F.col("statement")
    empty = F.array().cast("array<struct<subject:string,value:string,dated:double,other:double>>")
    gated = lambda found, needs: F.when(F.regexp_like(s, F.lit(f"(?i){needs}")), found).otherwise(empty)
    shaped = F.concat(
        *[gated(_stated(s, f"(?i){WORD_START}{shape}", dated, other), needs) for shape, dated, other, needs in SHAPES],
        gated(_stated(s, f"(?i){LINE_SHAPE[0]}", *LINE_SHAPE[1:]), ":"),
    )
    valid = lambda items: F.filter(items, lambda f: (F.length(f["subject"]) >= 2) & (F.length(f["value"]) >= 2))
    rough = F.slice(_stated(s, f"(?i){FALLBACK_SHAPE[0]}", *FALLBACK_SHAPE[1:]), 1, 1)
    wedding = F.regexp_like(s, F.lit("(?i)wedding")) & F.regexp_like(s, F.lit("(?i)day"))
    found = (
        lines.withColumn("shaped", valid(shaped))
        .withColumn("facts", F.when((F.size("shaped") == 0) & wedding, valid(rough)).otherwise(F.col("shaped")))
        .select("path", "line", "statement", F.posexplode("facts").alias("nth", "f"))
        .select("path", "line", "nth", "statement", "f.subject", "f.value", "f.dated", "f.other")
        .withColumn("is_date", looks_date_like("value"))
    )
    facts = found.select(
        "path",
        F.lower("subject").alias("subject_key"), F.lower("value").alias("value_key"),
        F.struct(F.col("line").alias("line"), F.col("nth").alias("nth")).alias("seen"),
        F.struct(
            "subject", "value", "statement", "line",
            F.when(F.col("is_date"), "date").otherwise("attribute").alias("kind"),
            F.when(F.col("is_date"), F.col("dated")).otherwise(F.col("other")).alias("confidence"),
        ).alias("fact"),
    )
    merged = facts.groupBy("path", "subject_key", "value_key").agg(
        F.min("seen").alias("first_seen"),
        F.min_by("fact", F.struct((-F.col("fact.confidence")).alias("c"), F.col("seen").alias("s"))).alias("fact"),
    )
    order = Window.partitionBy("path").orderBy("first_seen")
    numbered = merged.withColumn("position", F.row_number().over(order))
    kept = numbered if max_facts is None else numbered.filter(F.col("position") <= max_facts)
    return kept.select(
        F.concat_ws("::", "path", F.col("fact.line").cast("string"), "subject_key", "value_key").alias("id"),
        "path", "position", "fact.subject", "fact.value", "fact.statement", "fact.kind", "fact.confidence",
    )


def replace_facts(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """Facts after some documents (path, content) changed: theirs are replaced."""
    paths = changed.select(normalize_path("path").alias("path"))
    return facts.join(paths, "path", "left_anti").unionByName(extract_facts(changed))


def clear_facts(facts: DataFrame, paths: DataFrame) -> DataFrame:
    return facts.join(paths.select(normalize_path("path").alias("path")), "path", "left_anti")


def prune_facts(facts: DataFrame, documents: DataFrame) -> DataFrame:
    return facts.join(documents.select(normalize_path("path").alias("path")), "path", "left_semi")


def best_facts(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """The best matching fact of each question, with its score; the first in (path, position) order on ties."""
    asked = questions.filter(trim("query") != "").select(
        "query_id", query_terms("query", "facts").alias("tokens"), F.lower("query").alias("phrase"),
        F.array(F.lit(1.0), it.asks_when("query").cast("double")).alias("wants"),
    )
    keyed = facts.withColumn("key", F.concat_ws("\u0001", "path", F.format_string("%06d", "position")))
    texts = keyed.select(
        "key", F.lower("subject").alias("subject"), F.lower("statement").alias("statement"), F.lower("value").alias("value"),
        F.array(0.1 * F.col("confidence"), F.when(F.col("kind") == "date", 0.2).otherwise(0.0) + F.when(looks_date_like("value"), 0.12).otherwise(0.0)).alias("bonus"),
    )
    top = best_texts(
        asked, texts, {"subject": 0.65, "statement": 0.25, "value": 0.10}, k=1, min_score=0.0, per_token=False
    )
    return top.join(keyed, "key").drop("key", "rank")


def answer_from_facts(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Questions with a direct intent that one fact answers well enough."""
    asked = questions.select(F.col("query_id").cast("string").alias("query_id"), "query")
    joined = best_facts(questions, facts).join(asked, "query_id")
    dated = F.col("kind") == "date"
    good = (
        (F.col("score") >= MIN_MATCH)
        & (it.fact_intent("query") == "direct")
        & (F.col("score") >= F.when(dated, 0.34).otherwise(0.40))
    )
    q = F.lower("query")
    starts = lambda word: F.startswith(q, F.lit(word)) | F.contains(q, F.lit(f" {word} "))
    answer = choose(
        (starts("when"), F.concat("subject", F.lit(" is "), "value", F.lit("."))),
        (starts("what"), F.concat("subject", F.lit(": "), "value", F.lit("."))),
        otherwise=F.concat(F.lit("Based on your note, "), "subject", F.lit(" is "), "value", F.lit(".")),
    )
    return joined.filter(good).select(
        "query_id", answer.alias("answer"), F.col("path").alias("source"), "statement", "kind", "score",
        F.least(F.lit(0.99), F.greatest(F.lit(0.7), F.col("confidence"))).alias("similarity"),
        F.when(dated, "Answered directly from a high-confidence extracted date fact.")
        .otherwise("Answered directly from an extracted note attribute.").alias("match_summary"),
    )
