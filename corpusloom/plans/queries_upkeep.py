"""Registered queries: upkeep of vectors, facts and files, and the small decisions behind plans."""

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import naming as nm
from corpusloom.functions.paths import normalize_path
from corpusloom.operators import facts as fa
from corpusloom.operators import maintenance as mt
from corpusloom.operators import planning as pl
from corpusloom.operators import texts as ts
from corpusloom.plans import fixtures as fx
from corpusloom.plans.catalog import Item
from corpusloom.plans.queries_retrieval import _FACTS_CTE, _fact_notes
from corpusloom.plans.queries_vectors import EMBEDDING_WORK_SQL
from corpusloom.sources import files as fl
from corpusloom.sources.record_log import RecordLog
from corpusloom.session import ensure_checkpoint_dir


def decode_text(spark, sf):
    """The documents as files: whole ones, and some with a NUL byte, many control bytes or an invalid byte."""
    raw, kind = F.col("text").cast("binary"), F.col("doc_id") % 10
    data = (
        F.when(kind == 1, F.concat(raw, F.to_binary(F.lit("00"), F.lit("hex"))))
        .when(kind == 2, F.concat(raw, F.repeat(F.lit("\x01"), 1 + F.length("text")).cast("binary")))
        .when(kind == 3, F.concat(raw, F.to_binary(F.lit("FF"), F.lit("hex")))).otherwise(raw)
    )
    files = fx.table(spark, sf, "documents").select("doc_id", data.alias("bytes")).withColumn("size_bytes", F.octet_length("bytes"))
    return fl.decode_text(files).select("doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), "error")


DECODE_SQL = """
SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN md5(text || chr(65533)) ELSE md5(text) END AS content_md5,
  CASE WHEN doc_id % 10 IN (1, 2) THEN 'Unsupported binary file (preview is not available yet).' END AS error FROM documents"""


def _stored(spark, sf):
    """The vectors of the notes as a record log with one base."""
    log = RecordLog(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}", "path string, embedding array<double>, model string, vec_id long")
    log.upsert(fx.note_vectors(spark, sf).select("path", "embedding", "model", "vec_id"))
    log.compact()
    return log


def upsert_embeddings(spark, sf):
    """Every fourth note's vector replaced, in three changes with a compaction between them."""
    log = _stored(spark, sf)
    new = fx.notes(spark, sf).filter("doc_id % 4 = 0").select(
        "path", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), F.lit("m2").alias("model"), (-F.col("doc_id")).alias("vec_id")
    )
    for part in (0, 4, 8):
        log.upsert(new.filter(-F.col("vec_id") % 12 == part))
        if part == 4:
            log.compact()
    return log.read().select("path", "model", "vec_id", F.size("embedding").alias("dim"))


UPSERT_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL},
fresh AS (SELECT path, doc_id FROM notes WHERE doc_id % 4 = 0)
SELECT path, 'm2' AS model, -doc_id AS vec_id, 2 AS dim FROM fresh
UNION ALL SELECT path, model, vec_id, len(embedding) FROM note_embeddings WHERE path NOT IN (SELECT path FROM fresh)"""


def delete_embeddings(spark, sf):
    """Every third note's vector deleted, under another spelling of its path."""
    log = _stored(spark, sf)
    gone = fx.notes(spark, sf).filter("doc_id % 3 = 0").select(F.replace("path", F.lit("/"), F.lit("\\")).alias("path"))
    log.delete(gone.select(normalize_path("path").alias("path")))
    return log.read().select("path", "vec_id")


DELETE_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}
SELECT path, vec_id FROM note_embeddings WHERE path NOT IN (SELECT path FROM notes WHERE doc_id % 3 = 0)"""


def _kept_facts(spark, sf):
    return fa.extract_facts(_fact_notes(spark, sf))


def replace_facts(spark, sf):
    changed = fx.notes(spark, sf).filter("doc_id % 5 = 0").select(
        "path", F.format_string("My deadline is 2024-05-%02d.", F.col("doc_id") % 9 + 1).alias("content")
    )
    return fa.replace_facts(_kept_facts(spark, sf), changed).select("path", "position", "subject", "value", "kind", "confidence")


REPLACE_FACTS_SQL = f"""
WITH {fx.NOTES_SQL}, {_FACTS_CTE}
SELECT path, position, subject, value, kind, confidence FROM facts WHERE path NOT IN (SELECT path FROM notes WHERE doc_id % 5 = 0)
UNION ALL SELECT path, 1, 'deadline', '2024-05-' || printf('%02d', doc_id % 9 + 1), 'date', 0.96::DOUBLE FROM notes WHERE doc_id % 5 = 0"""


def prune_facts(spark, sf):
    left = fx.notes(spark, sf).filter("doc_id % 3 <> 0")
    return fa.prune_facts(_kept_facts(spark, sf), left).select("path", "position", "subject", "value")


PRUNE_FACTS_SQL = f"""
WITH {fx.NOTES_SQL}, {_FACTS_CTE}
SELECT path, position, subject, value FROM facts WHERE path IN (SELECT path FROM notes WHERE doc_id % 3 <> 0)"""


def incremental_embed(spark, sf):
    embed = lambda d: ts.embed(d, model="m1", created_at=F.lit("2024-02-01"))
    return mt.incremental_embed(fx.notes(spark, sf), fx.note_embeddings(spark, sf), "m1", embed)[1]


INCREMENTAL_SQL = f"""
SELECT count(*) AS processed, count(*) FILTER (WHERE state = 'unchanged') AS skipped, count(*) FILTER (WHERE state <> 'unchanged') AS embedded,
  (SELECT count(*) FROM embeddings WHERE vec_id > (SELECT max(doc_id) FROM documents) AND vec_id % 10 <> 0
     OR vec_id > (SELECT max(doc_id) * 2 + 1 FROM documents)) AS pruned
FROM ({EMBEDDING_WORK_SQL})"""


def repair_embeddings(spark, sf):
    """Every fourth note asked for, under another spelling and twice; every twelfth is empty, and some paths are unknown or out of scope."""
    n = fx.notes(spark, sf)
    docs = n.withColumn("content", F.when(F.col("doc_id") % 12 == 0, F.lit(" ")).otherwise(F.col("content")))
    some = n.filter("doc_id % 4 = 0")
    asked = some.select("path").union(some.select(F.replace("path", F.lit("/"), F.lit("\\")))).union(
        some.select(F.explode(F.array(F.concat(F.lit("Trash/"), "path"), F.concat(F.lit("gone/"), "path"))))
    )
    failures = n.filter("doc_id % 8 = 0 or doc_id % 7 = 0").select("path", F.lit(0).cast("timestamp").alias("at"), F.lit("earlier").alias("message"))
    embed = lambda d: ts.embed(d, model="m9", created_at=F.lit("2024-03-01"))
    index, failed = mt.repair_embeddings(asked, docs, fx.note_embeddings(spark, sf), failures, embed, F.lit(60).cast("timestamp"))
    rows = index.select("path", F.col("model").alias("model"), "content_hash", F.lit(None).cast("long").alias("second"), F.lit(None).cast("string").alias("message"))
    none = F.lit(None).cast("string")
    return rows.union(failed.select("path", none, none, F.unix_seconds("at"), "message"))


REPAIR_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL},
hashed AS (SELECT path, doc_id, lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(content, ''), lambda c: unicode(c)::BIGINT)),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0') AS content_hash FROM notes WHERE doc_id % 4 = 0 AND doc_id % 12 <> 0)
SELECT path, model, content_hash, NULL::BIGINT AS second, NULL::VARCHAR AS message FROM note_embeddings WHERE path NOT IN (SELECT path FROM hashed)
UNION ALL SELECT path, 'm9', content_hash, NULL, NULL FROM hashed
UNION ALL SELECT path, NULL, NULL, 60, 'Note is empty, so no embedding was generated.' FROM notes WHERE doc_id % 12 = 0
UNION ALL SELECT 'gone/' || path, NULL, NULL, 60, 'Embedding failed' FROM notes WHERE doc_id % 4 = 0
UNION ALL SELECT path, NULL, NULL, 0, 'earlier' FROM notes WHERE (doc_id % 8 = 0 OR doc_id % 7 = 0) AND doc_id % 4 <> 0"""


def free_names(spark, sf):
    """Files that all want one of seven names, some of which are taken."""
    docs = fx.table(spark, sf, "documents").select("doc_id")
    name = lambda n: F.concat(F.lit("Work/name "), n.cast("string"), F.lit(".md"))
    wanted = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("op_id"), name(F.col("doc_id") % 7).alias("target"))
    taken = docs.filter("doc_id < 3").select(name(F.col("doc_id")).alias("path"))
    second = docs.filter("doc_id < 2").select(F.concat(F.lit("Work/name "), F.col("doc_id").cast("string"), F.lit("-3.md")).alias("path"))
    return pl.free_names(wanted, taken.union(second))


FREE_NAMES_SQL = """
WITH w AS (SELECT doc_id, doc_id % 7 AS k, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id, CAST(doc_id AS VARCHAR)) - 1 AS nth FROM documents),
p AS (SELECT *, nth + CASE WHEN k < 3 THEN 1 ELSE 0 END AS place FROM w)
SELECT CAST(doc_id AS VARCHAR) AS path, 'Work/name ' || k || CASE WHEN place = 0 THEN '' ELSE '-' || (place + 1 + CASE WHEN k < 2 AND place >= 2 THEN 1 ELSE 0 END) END || '.md' AS final FROM p"""


def reconcile_category(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("resume", "general", "image", "learning")])
    groups = F.array(*[F.lit(c) for c in ("Work", "misc", "Career", "Learning", "Notes")])
    rows = fx.table(spark, sf, "documents").select(
        "doc_id", F.get(groups, (F.col("doc_id") % 5).cast("int")).alias("category"), F.when(F.col("doc_id") % 3 == 0, "Sub").alias("sub"),
        F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("kind"),
    )
    both = nm.reconcile_category(F.col("category"), F.col("sub"), F.col("kind"), F.lit("Career"), F.lit("Resumes"))
    return rows.withColumn("r", both).select("doc_id", "r.category", "r.subcategory")


# Generic categories (fixed values of the rule) yield to the inferred one; firm kinds insist on it.
RECONCILE_SQL = """
WITH r AS (SELECT doc_id, ['Work', 'misc', 'Career', 'Learning', 'Notes'][1 + doc_id % 5] AS c, CASE WHEN doc_id % 3 = 0 THEN 'Sub' END AS s,
  ['resume', 'general', 'image', 'learning'][1 + doc_id % 4] AS kind FROM documents),
t AS (SELECT *, c IN ('misc', 'Notes') OR (kind IN ('resume', 'image') AND c <> 'Career') AS take FROM r)
SELECT doc_id, CASE WHEN take THEN 'Career' ELSE c END AS category,
  CASE WHEN take OR (s IS NULL AND c = 'Career') THEN 'Resumes' ELSE s END AS subcategory FROM t"""

ITEMS = {
    "decode_text": Item(decode_text, DECODE_SQL),
    "upsert_embeddings": Item(upsert_embeddings, UPSERT_SQL),
    "delete_embeddings": Item(delete_embeddings, DELETE_SQL),
    "replace_facts": Item(replace_facts, REPLACE_FACTS_SQL),
    "prune_facts": Item(prune_facts, PRUNE_FACTS_SQL),
    "incremental_embed": Item(incremental_embed, INCREMENTAL_SQL),
    "repair_embeddings": Item(repair_embeddings, REPAIR_SQL),
    "free_names": Item(free_names, FREE_NAMES_SQL),
    "reconcile_category": Item(reconcile_category, RECONCILE_SQL),
}
