"""Corpus-wide checks: which documents count for retrieval, and whether index, facts, graph and links fit the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import is_indexable, is_retrievable, normalize_path
from corpusloom.functions.text import extraction_quality
from corpusloom.operators.facts import prune_facts
from corpusloom.operators.links import broken_references, repair_references
from corpusloom.operators.maintenance import orphan_embeddings, prune_embeddings
from corpusloom.operators.related import prune_related


def retrieval_eligible(documents: DataFrame) -> DataFrame:
    """Distinct paths of (path, kind, content) that may be retrieved: in scope, and images only with text of high quality."""
    readable = (F.col("kind") != "image") | (extraction_quality("content")["quality"] == "high")
    scoped = documents.withColumn("path", normalize_path("path")).filter(is_retrievable("path"))
    return scoped.filter(readable).select("path").distinct()


def consistency_report(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Valid documents, orphaned vectors and broken links, in one row."""
    notes = documents.filter(is_indexable("path"))
    orphans = orphan_embeddings(embeddings, documents).agg(F.count(F.lit(1)))
    broken = broken_references(notes, documents).agg(F.count(F.lit(1)))
    return notes.agg(F.count(F.lit(1)).alias("valid_notes")).select(
        "valid_notes", orphans.scalar().alias("orphan_embeddings"), broken.scalar().alias("broken_references")
    )


def repair_corpus(documents: DataFrame, embeddings: DataFrame, facts: DataFrame, features: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All tables repaired: orphans and stale facts and edges dropped, links rewritten where a title decides."""
    notes = documents.filter(is_indexable("path"))
    fixed = repair_references(notes, documents)
    untouched = documents.join(fixed.select("path"), "path", "left_anti")
    records, links, removed = prune_related(features, edges, notes)
    return {
        "documents": untouched.select("path", "content").unionByName(fixed.select("path", "content")),
        "embeddings": prune_embeddings(embeddings, documents),
        "facts": prune_facts(facts, notes),
        "related_records": records,
        "related_edges": links,
        "removed": removed,
        "repaired_links": fixed.agg(F.coalesce(F.sum("replaced"), F.lit(0)).alias("repaired")),
    }
