"""Reading and writing embedding records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import normalize_path

CHUNK = "struct<index:int,start:int,end:int,excerpt:string,embedding:array<double>,content_hash:string>"
SCHEMA = f"note_path string, embedding array<double>, model string, created_at string, content_hash string, chunks array<{CHUNK}>"


def _location_path(root: str):
    base = root.rstrip("/")
    where = F.col("_metadata.file_path")
    below = F.substring(where, F.instr(where, base) + len(base) + 1, F.length(where))
    return F.regexp_replace(F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))), "\\.json$", ".md")


def read_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """All JSON records below a folder; one bad file fails the whole read."""
    raw = spark.read.schema(SCHEMA).json(root, recursiveFileLookup=True, multiLine=True, mode="FAILFAST", pathGlobFilter="*.json")
    named = F.nullif(normalize_path(F.coalesce("note_path", F.lit(""))), F.lit(""))
    return raw.select(
        F.coalesce(named, _location_path(root)).alias("path"),
        F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.coalesce("created_at", F.lit("")).alias("created_at"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        F.coalesce("chunks", F.array().cast(f"array<{CHUNK}>")).alias("chunks"),
    )


def load_vector_index(spark: SparkSession, root: str) -> DataFrame:
    """The searchable vectors below a folder. Bad files are skipped, non-numbers count as 0, records without vectors drop out."""
    # Vectors are read as text first, so that an odd element spoils neither its vector nor its file.
    loose = "note_path string, embedding array<string>, chunks array<struct<index:int,excerpt:string,embedding:array<string>>>, _bad string"
    raw = spark.read.schema(loose).json(
        root, recursiveFileLookup=True, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", pathGlobFilter="*.json"
    ).filter(F.col("_bad").isNull())
    numbers = lambda v: F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    blank = lambda t: F.when(F.trim(t) != "", t)
    chunk = lambda c: F.struct(c["index"].alias("index"), blank(c["excerpt"]).alias("excerpt"), numbers(c["embedding"]).alias("embedding"))
    named = F.nullif(normalize_path(F.coalesce("note_path", F.lit(""))), F.lit(""))
    parts = F.filter(F.transform(F.coalesce("chunks", F.array().cast("array<struct<index:int,excerpt:string,embedding:array<string>>>")), chunk), lambda c: F.size(c["embedding"]) > 0)
    index = raw.select(F.coalesce(named, _location_path(root)).alias("path"), numbers(F.col("embedding")).alias("embedding"), parts.alias("chunks"))
    return index.filter((F.size("embedding") > 0) | (F.size("chunks") > 0))


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old records with those of ``new`` in place of theirs. Records are keyed by full path."""
    return new.select(*old.columns).unionByName(old.join(new.select("path"), "path", "left_anti").select(*old.columns))


def delete_embeddings(old: DataFrame, paths: DataFrame) -> DataFrame:
    return old.join(paths.select(normalize_path("path").alias("path")), "path", "left_anti")


def clear_embeddings(old: DataFrame) -> DataFrame:
    return old.limit(0)


def write_embeddings(records: DataFrame, location: str) -> None:
    """One folder of columnar files; the write replaces the folder as a whole."""
    records.write.mode("overwrite").parquet(location)
