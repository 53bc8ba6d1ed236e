"""Keyword search, hybrid retrieval, grounding and question routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import intents as it
from corpusloom.functions.columns import WS, ColumnLike, choose, clamp01, col, labels, matches, non_empty, one_of, trim
from corpusloom.functions.paths import drop_extension, file_name, is_retrievable, normalize_path
from corpusloom.functions.text import best_snippet, match_snippet, query_terms
from corpusloom.operators.scoring import best_texts
from corpusloom.operators.vectors import semantic_topk
from corpusloom.session import cut_lineage, stored

# Search weights and thresholds.
PHRASE_WEIGHTS = {"name": 120.0, "path": 60.0, "content": 40.0}
TOKEN_WEIGHTS = {"name": 20.0, "path": 10.0, "content": 4.0}
WEAK_SEMANTIC = 0.36
BOTH_BONUS = 0.06
STRONG_SEMANTIC = 0.72


def search_tokens(query: ColumnLike) -> Column:
    return non_empty(F.split(F.lower(trim(query)), WS + "+"))


def keyword_topk(queries: DataFrame, documents: DataFrame, limit: int = 40) -> DataFrame:
    """Documents holding the whole query or its words in name, path or content, best first."""
    asked = queries.filter(trim("query") != "").select(
        "query_id", search_tokens("query").alias("tokens"), F.lower(trim("query")).alias("phrase")
    )
    texts = documents.select(
        F.col("path").alias("key"),
        F.lower(file_name("path")).alias("name"),
        F.lower("path").alias("path"),
        F.lower("content").alias("content"),
    )
    top = best_texts(asked, texts, TOKEN_WEIGHTS, PHRASE_WEIGHTS, max(1, min(200, limit)))
    return top.select("query_id", F.col("key").alias("path"), F.col("score").cast("int").alias("score"), "rank")


def with_snippets(hits: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Title and snippet of keyword hits. The hits are stored first, so that the planner picks the join by their size."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "query")
    return (
        stored(hits.join(asked, "query_id"))
        .join(documents.select("path", "content"), "path")
        .withColumn("title", drop_extension(file_name("path")))
        .withColumn("snippet", match_snippet("content", "query"))
        .drop("content")
    )


def keyword_similarity(score: Column, best: Column, rank: Column) -> Column:
    """Keyword score as a similarity: share of the best score, less a penalty for the zero-based rank."""
    value = clamp01(F.lit(0.24) + clamp01(score / best) * 0.58 - F.least(F.lit(0.12), rank * 0.015))
    return F.when((score <= 0) | (best <= 0), 0.0).otherwise(value)


def path_overlap_terms(path: ColumnLike, query: ColumnLike) -> Column:
    in_path = matches(F.lower(col(path)), "[a-z0-9]{2,}")
    return F.slice(F.array_intersect(query_terms(query), in_path), 1, 3)


def keyword_results(queries: DataFrame, documents: DataFrame, top_k: int) -> DataFrame:
    """Keyword hits as retrieval results: (query_id, path, similarity, path_terms)."""
    # Out-of-scope documents go first, so that they take no place among the best.
    hits = keyword_topk(queries, documents.filter(is_retrievable(normalize_path("path"))), max(top_k * 4, 12))
    by_query = Window.partitionBy("query_id")
    scored = hits.withColumn(
        "similarity", keyword_similarity(F.col("score"), F.max("score").over(by_query), F.col("rank") - 1)
    )
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "query")
    best = (
        scored.withColumn("path", normalize_path("path"))
        .groupBy("query_id", "path")
        .agg(F.max(F.round("similarity", 9)).alias("similarity"))
    )
    order = by_query.orderBy(F.desc("similarity"), "path")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max(1, top_k))
        .join(asked, "query_id")
        .select("query_id", "path", "similarity", path_overlap_terms("path", "query").alias("path_terms"))
    )


def _quoted(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")


def keyword_rerank(hits: DataFrame) -> DataFrame:
    """Reorder keyword hits (query_id, query, path, title, snippet, score, rank) by direct title, path and text matches."""
    tokens = search_tokens("query")
    n = lambda where: F.size(F.filter(F.col("tokens"), lambda t: F.contains(F.lower(where), t)))
    counted = (
        hits.withColumn("tokens", tokens)
        .withColumn("title_n", n(F.col("title")))
        .withColumn("path_n", n(F.col("path")))
        .withColumn("snippet_n", n(F.col("snippet")))
        .withColumn("joined", F.array_join("tokens", " "))
        .withColumn("exact", (F.col("joined") != "") & (F.lower("title") == F.col("joined")))
        .withColumn("starts", (F.col("joined") != "") & F.startswith(F.lower("title"), F.col("joined")))
    )
    kind = choose(
        ((F.col("title_n") > 0) & (F.col("snippet_n") > 0), "mixed"), (F.col("title_n") > 0, "title"), otherwise="content"
    )
    ranking = (
        F.col("score") + 14 * F.col("title_n") + 5 * F.col("path_n") + 3 * F.col("snippet_n")
        + F.when(F.col("exact"), 40).otherwise(0) + F.when(F.col("starts"), 16).otherwise(0)
    )
    matched = F.slice(
        F.filter("tokens", lambda t: F.contains(F.lower(F.concat_ws(" ", "title", "path", "snippet")), t)), 1, 3
    )
    tags = labels(
        (F.col("exact"), "Exact title"),
        (~F.col("exact") & F.col("starts"), "Title starts with query"),
        (~F.col("exact") & ~F.col("starts") & (F.col("title_n") > 0), "Title match"),
        (F.col("path_n") > 0, "Path match"),
        (F.col("snippet_n") > 0, "Content match"),
    )
    said = lambda text: F.when(F.size("matched") > 0, F.concat(F.lit(f"{text} for "), _quoted(F.col("matched")), F.lit("."))).otherwise(f"{text}.")
    summary = choose(
        (F.col("exact"), "Exact title match for your query."),
        (F.col("starts"), "Title starts with your query, which is usually a strong direct lookup signal."),
        ((F.col("title_n") > 0) & (F.col("snippet_n") > 0), said("Matched in both the note title and content")),
        ((F.col("title_n") > 0) | (F.col("path_n") > 0), said("Strong direct match in the note title or folder path")),
        otherwise=said("Matched the note content"),
    )
    ranked = counted.withColumn("match_kind", kind).withColumn("ranking", ranking).withColumn("matched", matched)
    kind_order = choose((F.col("match_kind") == "mixed", F.lit(0)), (F.col("match_kind") == "title", F.lit(1)), otherwise=F.lit(2))
    order = Window.partitionBy("query_id").orderBy(F.desc("ranking"), kind_order, "rank")
    return ranked.withColumn("new_rank", F.row_number().over(order)).select(
        "query_id", "path", "title", "snippet", "score", "ranking", "match_kind", tags.alias("tags"), summary.alias("summary"), "new_rank"
    )


def retrieval_tags(semantic: Column, keyword: Column, path_terms: Column) -> Column:
    found = (semantic > 0) | (keyword > 0)
    return F.when(
        found,
        labels(
            (semantic > 0, "Semantic match"), (keyword > 0, "Keyword match"), (F.size(path_terms) > 0, "Title/path match")
        ),
    )


def retrieval_summary(semantic: Column, keyword: Column, path_terms: Column) -> Column:
    some = F.size(path_terms) > 0
    both = (semantic > 0) & (keyword > 0)
    return choose(
        (
            both & some,
            F.concat(
                F.lit("Matched both the meaning of your question and direct path keywords like "), _quoted(path_terms), F.lit(".")
            ),
        ),
        (both, "Matched both the meaning of your question and direct keywords from the query."),
        (semantic >= STRONG_SEMANTIC, "Strong semantic match to the meaning of your question."),
        (semantic > 0, "Semantic match to the meaning of your question."),
        (
            (keyword > 0) & some,
            F.concat(
                F.lit("Direct keyword match in the file name or folder path for "), _quoted(path_terms), F.lit(".")
            ),
        ),
        (keyword > 0, "Direct keyword overlap with your question."),
    )


def keyword_gate(queries: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """Queries whose semantic results are too few or too weak, so that keyword search has to help."""
    strength = semantic.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("best"))
    asked = queries.withColumn("query_id", F.col("query_id").cast("string"))
    return (
        asked.join(strength, "query_id", "left")
        .filter((F.coalesce("n", F.lit(0)) < k) | (F.coalesce("best", F.lit(0.0)) < WEAK_SEMANTIC))
        .select(*asked.columns)
    )


def hybrid_merge(semantic: DataFrame, keyword: DataFrame, top_k: int) -> DataFrame:
    """Union of both result lists; a path found by both gains a bonus."""
    best = lambda df, extra: df.groupBy("query_id", "path").agg(F.max_by(F.struct("similarity", extra), "similarity").alias("r"))
    s = best(semantic, "excerpt").select("query_id", "path", F.col("r.similarity").alias("s"), F.col("r.excerpt").alias("content"))
    w = best(keyword, "path_terms").select("query_id", "path", F.col("r.similarity").alias("w"), F.col("r.path_terms").alias("terms"))
    joined = s.join(w, ["query_id", "path"], "full_outer")
    sem, key = F.coalesce("s", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
    terms = F.coalesce("terms", F.array().cast("array<string>"))
    value = F.when((sem > 0) & (key > 0), F.least(F.lit(0.98), F.greatest(sem, key) + BOTH_BONUS)).otherwise(F.greatest(sem, key))
    merged = joined.select(
        "query_id", "path", F.round(value, 9).alias("similarity"), "content",
        retrieval_tags(sem, key, terms).alias("tags"), retrieval_summary(sem, key, terms).alias("summary"),
        F.when(F.size(terms) > 0, terms).alias("path_terms"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "path")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, top_k))


def intent_rerank(results: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """Boost direct title and path matches of lookup queries; other queries keep their order."""
    asked = queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        (it.retrieval_intent("query") == "lookup").alias("lookup"),
        F.filter(it.rerank_tokens("query"), lambda t: ~one_of(t, it.LOOKUP_HINTS)).alias("tokens"),
    )
    title = F.lower(F.regexp_replace(file_name("path"), "(?i)\\.[a-z0-9]+$", ""))
    hits = lambda where: F.size(F.filter(F.col("tokens"), lambda t: F.contains(where, t)))
    counted = (
        results.join(asked, "query_id")
        .withColumn("title_n", hits(title))
        .withColumn("path_n", hits(F.lower("path")))
        .withColumn("exactish", (F.col("title_n") > 0) & F.contains(title, F.array_join("tokens", " ")))
    )
    boosted = F.least(
        F.lit(0.99),
        F.col("similarity") + F.least(F.lit(0.12), F.col("title_n") * 0.035) + F.least(F.lit(0.08), F.col("path_n") * 0.02)
        + F.when(F.col("exactish"), 0.06).otherwise(0.0),
    )
    tagged = F.col("lookup") & ((F.col("title_n") > 0) | (F.col("path_n") > 1) | F.col("exactish"))
    direct = F.array(F.lit("Direct lookup match"))
    order = Window.partitionBy("query_id").orderBy(
        F.when(F.col("lookup"), -F.col("similarity")), F.when(F.col("lookup"), F.col("path")), "rank"
    )
    out = counted.select(
        "query_id", "path", F.round(F.when(F.col("lookup"), boosted).otherwise(F.col("similarity")), 9).alias("similarity"), "content",
        F.when(tagged, F.slice(F.array_distinct(F.concat(direct, F.coalesce("tags", F.array().cast("array<string>")))), 1, 4)).otherwise(F.col("tags")).alias("tags"),
        F.when(
            tagged, "Boosted because this looks like a direct note/file lookup and the title or path matches closely."
        ).otherwise(F.col("summary")).alias("summary"),
        "path_terms", "lookup", "rank",
    )
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, top_k))


def hybrid_search(queries: DataFrame, documents: DataFrame, index: DataFrame, k: int = 3) -> DataFrame:
    """Semantic search, helped by keyword search where it is weak, merged and reranked by intent.

    ``queries(query_id, query, embedding)``, ``documents(path, content)``, ``index(path, embedding[, chunks])``.
    """
    limit = max(2 * k, 8)
    with_vector = queries.filter(F.col("embedding").isNotNull())
    # Read by the gate and by the merge; the search behind it runs once.
    semantic = cut_lineage(semantic_topk(with_vector, index.filter(is_retrievable("path")), limit))
    gated = keyword_gate(queries, semantic, k)
    keyword = keyword_results(gated, documents, limit)
    merged = hybrid_merge(semantic, keyword, limit)
    return intent_rerank(merged, queries, k)


def grounding_plan(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One plan for each query: answer from one document, or combine several."""
    top = lambda rank, value: F.max(F.when(F.col("rank") == rank, value))
    ranked = results.groupBy("query_id").agg(
        top(1, F.col("similarity")).alias("first"),
        F.coalesce(top(2, F.col("similarity")), F.lit(0.0)).alias("second"),
        F.coalesce(top(1, F.array_contains("tags", "Direct lookup match")), F.lit(False)).alias("direct"),
    )
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "query")
    first, second = F.col("first"), F.col("second")
    gap = F.round(first - second, 9)
    lookup = it.retrieval_intent("query") == "lookup"
    mode = choose(
        (first.isNull(), "none"),
        ((lookup & (first >= 0.46) & (F.col("direct") | (gap >= 0.08))) | ((first >= 0.78) & (gap >= 0.12)), "focused-direct"),
        (it.is_synthesis("query") | ((second >= 0.30) & (gap < 0.14)), "synthesized"),
        otherwise="focused",
    )
    plan = asked.join(ranked, "query_id", "left").withColumn("plan", mode)
    return plan.select(
        "query_id",
        F.when(F.col("plan") == "synthesized", "synthesized").otherwise("focused").alias("mode"),
        F.when(F.col("plan") == "synthesized", 2).otherwise(1).alias("max_primary"),
        (F.col("plan") == "synthesized").alias("include_related"),
        choose(
            (F.col("plan") == "none", "No note evidence was strong enough to build a grounded answer plan."),
            (F.col("plan") == "focused-direct", "Focused on one strong note match to answer a direct lookup-style question."),
            (F.col("plan") == "synthesized", "Synthesized across multiple related notes because the question benefits from broader context."),
            otherwise="Focused on the strongest matching note to keep the answer precise.",
        ).alias("grounding_summary"),
    )


def assemble_context(
    results: DataFrame, plans: DataFrame, documents: DataFrame, edges: DataFrame, max_chars: int | None = None
) -> DataFrame:
    """Context text of each query: the planned number of readable sources, then one related document, whole by default.

    ``edges(source, target, score, rank)`` lists related documents. A query has at most three sources.
    """
    by_query = Window.partitionBy("query_id")
    readable = results.filter(F.col("similarity") >= 0.22).join(documents.select("path"), "path", "left_semi")
    primary = (
        readable.join(plans, "query_id")
        .withColumn("n", F.row_number().over(by_query.orderBy("rank")))
        .filter(F.col("n") <= F.col("max_primary"))
        .select("query_id", "path", "similarity", "n", "include_related")
    )
    first = primary.filter((F.col("n") == 1) & F.col("include_related")).select("query_id", F.col("path").alias("source"))
    related = (
        first.join(edges.select("source", F.col("target").alias("path"), F.col("score").alias("similarity"), F.col("rank").alias("edge_rank")), "source")
        .join(primary.select("query_id", "path"), ["query_id", "path"], "left_anti")
        .join(documents.select("path"), "path", "left_semi")
        .withColumn("n", F.row_number().over(by_query.orderBy("edge_rank")))
        .filter(F.col("n") == 1)
        .select("query_id", "path", "similarity", F.lit(99).alias("n"))
    )
    chosen = primary.drop("include_related").unionByName(related)
    with_text = chosen.join(documents.select("path", "content"), "path")
    sources = with_text.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "path", "similarity", (F.col("content") if max_chars is None else F.substring("content", 1, max_chars)).alias("text")))).alias("sources"),
        F.min_by("content", "n").alias("first_content"),
    )
    block = lambda s, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), s["path"], F.lit("]\n"), s["text"])
    return sources.select(
        "query_id",
        F.get("sources", F.lit(0))["path"].alias("source"),
        F.get("sources", F.lit(0))["similarity"].alias("similarity"),
        F.transform("sources", lambda s: s["path"]).alias("source_paths"),
        F.array_join(F.transform("sources", block), "\n\n---\n\n").alias("context"),
        "first_content",
    )


def trust_level(similarity: ColumnLike) -> Column:
    """Struct of answer mode, confidence, provenance and wording prefix."""

    def level(mode: str, confidence: str, provenance: str, prefix: str) -> Column:
        return F.struct(
            F.lit(mode).alias("answer_mode"), F.lit(confidence).alias("confidence"),
            F.lit(provenance).alias("provenance"), F.lit(prefix).alias("prefix"),
        )

    s = col(similarity)
    return choose(
        (s >= 0.62, level("grounded", "high", "Grounded in your notes", "")),
        (s >= 0.38, level("mixed", "medium", "Partially grounded in your notes", "Best matching note-based answer: ")),
        otherwise=level("mixed", "low", "Weak note match", "Possible note-based answer from a weak match: "),
    )


def route_questions(
    questions: DataFrame, fact_answers: DataFrame, results: DataFrame, contexts: DataFrame, plans: DataFrame
) -> DataFrame:
    """Where each question is answered from: small talk and unmatched ones generally, else a fact, else notes."""
    asked = questions.select(F.col("query_id").cast("string").alias("query_id"), "query")
    facts = fact_answers.select(
        "query_id", F.col("source").alias("fact_source"), F.col("statement").alias("fact_snippet"),
        F.col("answer").alias("fact_answer"), F.col("similarity").alias("fact_similarity"), F.col("match_summary"),
    )
    found = results.select("query_id", F.col("path").alias("source"), F.col("content").alias("hit_content"), F.col("summary").alias("retrieval_summary"))
    grounded = (
        contexts.join(found, ["query_id", "source"], "left")
        .join(plans.select("query_id", "grounding_summary"), "query_id", "left")
        .select("query_id", F.col("source").alias("note_source"), F.col("similarity").alias("note_similarity"),
                "hit_content", "first_content", "retrieval_summary", "grounding_summary")
    )
    joined = asked.join(facts, "query_id", "left").join(grounded, "query_id", "left")
    route = choose(
        (it.is_small_talk("query"), "general"), (F.col("fact_source").isNotNull(), "fact"),
        (F.col("note_source").isNotNull(), "note"), otherwise="general",
    )
    routed = joined.withColumn("source_type", route).withColumn("trust", trust_level("note_similarity"))
    fact, note = F.col("source_type") == "fact", F.col("source_type") == "note"
    return routed.select(
        "query_id", "source_type",
        choose((fact, F.col("fact_source")), (note, F.col("note_source"))).alias("source"),
        choose((fact, F.col("fact_similarity")), (note, F.col("note_similarity")), otherwise=F.lit(0.0)).alias("similarity"),
        F.when(fact, F.col("fact_answer")).alias("answer"),
        choose(
            (fact, F.col("fact_snippet")),
            (note, F.coalesce(F.nullif(F.col("hit_content"), F.lit("")), best_snippet("first_content", "query"))),
        ).alias("snippet"),
        choose((fact, "grounded"), (note, F.col("trust.answer_mode")), otherwise="general").alias("answer_mode"),
        choose((fact, "high"), (note, F.col("trust.confidence"))).alias("confidence"),
        choose((fact, "Grounded in extracted facts"), (note, F.col("trust.provenance"))).alias("provenance"),
        choose((fact, F.col("match_summary")), (note, F.col("grounding_summary"))).alias("grounding_summary"),
    )
