"""Derived views over the supplied tables, so that structure-dependent operators have data to work on.

All views are projections (or flat maps) of whole tables; none of them shuffles the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.columns import choose, one_of

EPOCH_2024_US = 1704067200000000
MINUTE_US = 60000000
# Numbers from here on belong to the texts whose own number has a made question.
TEXT_QUESTIONS = 1_000_000

# File name words that exercise the classification rules.
NAME_WORDS = [
    "offer letter", "service contract", "screenshot", "weekly sync slides", "budget forecast",
    "project proposal", "meeting agenda", "resume", "findings report", "setup guide", "invoice",
    "bank statement", "employee onboarding", "travel itinerary", "kpi dashboard", "personal profile",
    "ledger export", "cover letter", "metrics", "plain thoughts",
]
NAME_EXTENSIONS = ["md", "pdf", "docx", "pptx", "xlsx", "csv", "png", "txt"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(number: Column) -> Column:
    return F.format_string("%05d", number)


def _minute(number: Column) -> Column:
    return F.timestamp_micros(F.lit(EPOCH_2024_US) + number * MINUTE_US)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a folder of notes with headings, links, deadlines, drafts and copies.

    Every document is a note; those whose number ends in 0 also have a copy (a draft, a final version or a plain copy),
    numbered after all documents.
    """
    docs = table(spark, sf_dir, "documents")
    total = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.max("doc_id") + 1).scalar()
    base = F.col("doc_id")
    source = docs.withColumn("n", total)
    ids = F.array_compact(F.array(base, F.when(base % 10 == 0, base + F.col("n"))))
    rows = source.select(F.explode(ids).alias("doc_id"), base.alias("base_id"), "text", "source", "lang", "n")
    b, copied = F.col("base_id"), F.col("doc_id") != F.col("base_id")
    folder = choose(
        (copied & (b % 30 == 10), F.concat_ws("/", "source", "lang", F.lit("exports/"))),
        (~copied & (b % 19 == 0), ""),
        otherwise=F.concat_ws("/", "source", "lang", F.lit("")),
    )
    version = choose((b % 30 == 0, " draft"), (b % 30 == 10, " final"), otherwise=" copy")
    suffix = F.when(copied, version).otherwise("")
    lines = [
        F.concat(F.lit("# Doc "), b.cast("string")), F.lit(""), F.col("text"), F.lit(""), F.lit("## Links"),
        F.concat(F.lit("[[doc "), _padded((b * 7 + 2) % F.col("n")), F.lit("]]")),
        F.concat(F.lit("[ref](missing-"), (b % 5).cast("string"), F.lit(".md)")),
        F.format_string("Deadline: 2024-%02d-%02d", F.lit(1) + b % 12, F.lit(1) + b % 28),
        F.when(copied & (b % 20 == 0), F.lit("Revision appended later")),
    ]
    return rows.select(
        "doc_id",
        F.concat(folder, F.lit("doc "), _padded(b), suffix, F.lit(".md")).alias("path"),
        F.concat_ws("\n", *lines).alias("content"),
        F.lit("text").alias("kind"),
        _minute(F.col("doc_id")).alias("modified_at"),
    )


def note_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records without content hashes, for readers that only want vectors; the notes' texts are not read."""
    return note_embeddings(spark, sf_dir, hashed=False)


def note_embeddings(spark: SparkSession, sf_dir: str, hashed: bool = True) -> DataFrame:
    """Vectors under the path of the note with the same number; numbers without a note keep a path of their own."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("embedding"),
        F.when(F.col("vec_id") % 5 == 0, "m0").otherwise("m1:latest").alias("model"),
        F.format_string("%010d", F.col("vec_id")).alias("created_at"),
    )
    paths = notes(spark, sf_dir).select(
        F.col("doc_id").alias("vec_id"), "path", (tx.content_hash("content") if hashed else F.lit("")).alias("note_hash")
    )
    joined = vectors.join(paths, "vec_id", "left")
    return joined.select(
        "vec_id",
        F.coalesce("path", F.concat(F.lit("gone/vec "), _padded(F.col("vec_id")), F.lit(".md"))).alias("path"),
        "embedding", "model", "created_at",
        F.when(F.col("vec_id") % 3 == 0, F.lit("")).otherwise(F.coalesce("note_hash", F.lit(""))).alias("content_hash"),
    )


def path_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note paths rewritten, by number, to all the shapes the scope rules tell apart."""
    n = notes(spark, sf_dir)
    path, kind = F.col("path"), F.col("doc_id") % 10
    swap = lambda ext: F.regexp_replace(path, "\\.md$", ext)
    return n.select(
        "doc_id",
        choose(
            (kind == 0, path),
            (kind == 1, F.concat(F.lit("/notes/"), path)),
            (kind == 2, F.concat(F.lit("Trash/"), path)),
            (kind == 3, swap(".PDF")),
            (kind == 4, swap(".png")),
            (kind == 5, swap(".zip")),
            (kind == 6, F.concat(F.lit(".vn-system/"), path)),
            (kind == 7, F.concat(F.lit("\\misc\\"), path)),
            (kind == 8, swap("")),
            otherwise=F.concat(F.lit("area/.hidden/"), path),
        ).alias("path"),
    )


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes under telling file names and kinds, to exercise classification."""
    n = notes(spark, sf_dir)
    words = F.array(*[F.lit(w) for w in NAME_WORDS])
    extensions = F.array(*[F.lit(e) for e in NAME_EXTENSIONS])
    word = F.get(words, (F.col("doc_id") % len(NAME_WORDS)).cast("int"))
    ext = F.get(extensions, (F.floor(F.col("doc_id") / len(NAME_WORDS)) % len(NAME_EXTENSIONS)).cast("int"))
    return n.select(
        "doc_id",
        F.concat(F.lit("Area/"), word, F.lit(" "), _padded(F.col("doc_id")), F.lit("."), ext).alias("path"),
        "content",
        choose((one_of(ext, ["pdf", "docx", "pptx", "xlsx", "csv"]), ext), (ext == "png", "image"), otherwise="text").alias("kind"),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries, with the vector of the same number."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding")
    )
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return texts.join(vectors, "query_id", "left")


def fact_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question, and for three in four also a question about deadlines or plans, by number."""
    item = F.col("item_id")
    shaped = choose(
        (item % 4 == 0, F.format_string("When is the deadline 2024-%02d-%02d?", F.lit(1) + item % 12, F.lit(1) + item % 28)),
        (item % 4 == 1, F.format_string("What is my deadline in 2024-%02d?", F.lit(1) + item % 12)),
        (item % 4 == 2, F.format_string("How do we compare plan %d?", item)),
        otherwise=F.col("text"),
    )
    texts = table(spark, sf_dir, "benchmark")
    plain = texts.where(item % 4 != 3).select((item + TEXT_QUESTIONS).alias("query_id"), F.col("text").alias("query"))
    return texts.select(item.alias("query_id"), shaped.alias("query")).union(plain)


# The same views for the reference SQL.
NOTES_SQL = """
notes AS (
  SELECT doc_id, base_id, folder || 'doc ' || printf('%05d', base_id)
      || CASE WHEN doc_id = base_id THEN '' ELSE CASE base_id % 30 WHEN 0 THEN ' draft' WHEN 10 THEN ' final' ELSE ' copy' END END || '.md' AS path,
    '# Doc ' || base_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Links' || chr(10)
      || '[[doc ' || printf('%05d', (base_id * 7 + 2) % n) || ']]' || chr(10)
      || '[ref](missing-' || (base_id % 5) || '.md)' || chr(10)
      || 'Deadline: 2024-' || printf('%02d', 1 + base_id % 12) || '-' || printf('%02d', 1 + base_id % 28)
      || CASE WHEN doc_id <> base_id AND base_id % 20 = 0 THEN chr(10) || 'Revision appended later' ELSE '' END AS content,
    'text' AS kind, 1704067200 + doc_id * 60 AS modified_s
  FROM (
    SELECT doc_id, base_id, text, n,
      CASE WHEN doc_id <> base_id AND base_id % 30 = 10 THEN source || '/' || lang || '/exports/'
           WHEN doc_id = base_id AND base_id % 19 = 0 THEN ''
           ELSE source || '/' || lang || '/' END AS folder
    FROM (SELECT unnest(CASE WHEN d.doc_id % 10 = 0 THEN [d.doc_id, d.doc_id + m.n] ELSE [d.doc_id] END) AS doc_id,
        d.doc_id AS base_id, text, source, lang, m.n FROM documents d, (SELECT max(doc_id) + 1 AS n FROM documents) m))
)"""

PATH_VARIANTS_SQL = NOTES_SQL + """,
path_variants AS (
  SELECT doc_id, CASE doc_id % 10
    WHEN 0 THEN path WHEN 1 THEN '/notes/' || path WHEN 2 THEN 'Trash/' || path
    WHEN 3 THEN regexp_replace(path, '\\.md$', '.PDF') WHEN 4 THEN regexp_replace(path, '\\.md$', '.png')
    WHEN 5 THEN regexp_replace(path, '\\.md$', '.zip') WHEN 6 THEN '.vn-system/' || path
    WHEN 7 THEN '\\misc\\' || path WHEN 8 THEN regexp_replace(path, '\\.md$', '')
    ELSE 'area/.hidden/' || path END AS path
  FROM notes
)"""

NOTE_EMBEDDINGS_SQL = NOTES_SQL + """,
note_embeddings AS (
  SELECT e.vec_id, coalesce(n.path, 'gone/vec ' || printf('%05d', e.vec_id) || '.md') AS path,
    CAST(e.embedding AS DOUBLE[]) AS embedding,
    CASE WHEN e.vec_id % 5 = 0 THEN 'm0' ELSE 'm1:latest' END AS model,
    printf('%010d', e.vec_id) AS created_at,
    CASE WHEN e.vec_id % 3 = 0 OR n.content IS NULL THEN '' ELSE coalesce(lpad(printf('%x', list_reduce(
      list_prepend(2166136261::BIGINT, list_transform(string_split(n.content, ''), lambda c: unicode(c)::BIGINT)),
      lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0'), '') END AS content_hash
  FROM embeddings e LEFT JOIN notes n ON n.doc_id = e.vec_id
)"""

NAMED_FILES_SQL = NOTES_SQL + f""",
named_files AS (
  SELECT doc_id, content, 'Area/' || word || ' ' || printf('%05d', doc_id) || '.' || ext AS path,
    CASE WHEN ext IN ('pdf', 'docx', 'pptx', 'xlsx', 'csv') THEN ext WHEN ext = 'png' THEN 'image' ELSE 'text' END AS kind
  FROM (SELECT doc_id, content,
      list_extract({NAME_WORDS!r}, 1 + doc_id % {len(NAME_WORDS)}) AS word,
      list_extract({NAME_EXTENSIONS!r}, 1 + (doc_id // {len(NAME_WORDS)}) % {len(NAME_EXTENSIONS)}) AS ext
    FROM notes)
)"""

FACT_QUESTIONS_SQL = """
fact_questions AS (
  SELECT item_id AS query_id, CASE item_id % 4
    WHEN 0 THEN 'When is the deadline 2024-' || printf('%02d', 1 + item_id % 12) || '-' || printf('%02d', 1 + item_id % 28) || '?'
    WHEN 1 THEN 'What is my deadline in 2024-' || printf('%02d', 1 + item_id % 12) || '?'
    WHEN 2 THEN 'How do we compare plan ' || item_id || '?'
    ELSE text END AS query
  FROM benchmark
  UNION ALL SELECT item_id + 1000000, text FROM benchmark WHERE item_id % 4 <> 3
)"""


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as embedding attempts: errors are failures, and the user number is the path."""
    e = table(spark, sf_dir, "events")
    waited = (F.col("value") * 1000).cast("bigint")
    finished = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("task_id"),
        F.format_string("user %05d.md", F.col("user_id")).alias("path"),
        F.timestamp_micros(finished - 2000 * waited).alias("queued_at"),
        F.timestamp_micros(finished - 1000 * waited).alias("started_at"),
        F.timestamp_micros(finished).alias("finished_at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("outcome"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        (F.col("user_id") % 2 == 0).alias("active_hit"),
    )


def embedding_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as failed attempts, on the note whose number is the event number's remainder."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.max("doc_id") + 1).scalar()
    paths = notes(spark, sf_dir).select(F.col("doc_id").alias("note"), "path")
    return e.withColumn("note", F.col("event_id") % n).join(paths, "note").select(
        "path", F.col("ts").cast("timestamp").alias("at"), F.col("props").alias("message")
    )


FAILURES_SQL = """
failures AS (SELECT n.path, e.props AS message FROM events e, (SELECT max(doc_id) + 1 AS n FROM documents) m, notes n
  WHERE n.doc_id = e.event_id % m.n AND e.event_type = 'error'
  QUALIFY row_number() OVER (PARTITION BY n.path ORDER BY e.ts DESC, e.props) = 1)"""
