"""Derived tables with a version: facts, related graph, analysis cache, preferences, undo log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1

# The tables of the engine and their columns.
TABLES = {
    "facts": "id string, path string, position int, subject string, value string, statement string, kind string, confidence double",
    "related_edges": "source string, target string, score double, semantic double, keyword double, title double, entity double, rank int",
    "related_records": "path string, title string, title_tokens array<string>, keywords array<string>, entities array<string>, folder string, top string, second string",
    "analysis_cache": "path string, content_hash string, model string, should_keep boolean, suggested_path string, suggested_title string, is_duplicate boolean, duplicate_of string, reason string",
    "preferences": "kind string, key string, inner_key string, n bigint",
    "undo_log": "op_id bigint, operation string, source_path string, target_path string, trash_path string, reason string",
}


def save_versioned(df: DataFrame, location: str, version: int = VERSION) -> None:
    df.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(location)


def load_versioned(spark: SparkSession, location: str, schema: str, version: int = VERSION) -> DataFrame:
    """The table at a location; an empty one if it is missing, unreadable or of another version."""
    empty = spark.createDataFrame([], schema)
    try:
        stored = spark.read.parquet(location)
    except AnalysisException:
        return empty
    if "version" not in stored.columns or any(c not in stored.columns for c in empty.columns):
        return empty
    return stored.filter(F.col("version") == version).select(*empty.columns)


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return load_versioned(spark, f"{root}/{name}", TABLES[name])


def save_table(df: DataFrame, root: str, name: str) -> None:
    columns = [part.split()[0] for part in TABLES[name].split(", ")]
    save_versioned(df.select(*columns), f"{root}/{name}")
