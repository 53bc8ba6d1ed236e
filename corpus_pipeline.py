"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
documents, before the next one starts. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import alike, lines, mixing, packing, rules
from corpusloom.llm.common import clear, collected, saved, table


def _stage(work: Callable) -> Callable:
    """Intermediate tables of a stage go when the session's next stage starts: by then its result has been written."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark)
        with collected(spark):
            return work(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the decision list learnt from `labels` rejects go."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; every document stays, if only with an empty text."""
    return lines.delete_repeated_runs(docs).select(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by fingerprints and by shared wording."""
    return alike.keep_first(docs)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are drawn up to 1.5 times as often as the largest one; every document comes once at least."""
    return mixing.mix(docs)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in packed sequences; a document drawn twice is packed twice."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

# The learnt rules, hashes and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    clear(spark)
    return docs
