"""Registered queries: vector search and index upkeep."""

from pyspark.sql import functions as F

from corpusloom.operators import maintenance as mt
from corpusloom.operators import vectors as vx
from corpusloom.plans import fixtures as fx
from corpusloom.plans.catalog import Item


def semantic_topk(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    queries = vectors.select(F.col("vec_id").cast("string").alias("query_id"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    index = vectors.select(F.format_string("vec %010d", "vec_id").alias("path"), "embedding")
    top = vx.semantic_topk(queries, index, 10)
    return top.select("query_id", "path", F.round("similarity", 6).alias("similarity"), "rank")


def _pairs(body: str) -> str:
    return f"""
v AS (SELECT {body}),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
p AS (SELECT a.id AS a_id, b.id AS b_id, a.path AS a_path, b.path AS b_path,
  round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 9) AS s FROM u a CROSS JOIN u b)"""


SEMANTIC_SQL = f"""
WITH {_pairs("vec_id AS id, 'vec ' || printf('%010d', vec_id) AS path, CAST(embedding AS DOUBLE[]) AS e FROM embeddings")},
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY s DESC, b_path) AS rank FROM p WHERE s >= 0)
SELECT CAST(a_id AS VARCHAR) AS query_id, b_path AS path, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10"""


def knn_candidates(spark, sf):
    latest = vx.latest_embeddings(fx.note_vectors(spark, sf))
    found = vx.knn_candidates(latest, latest)
    return found.select("source", "target", F.round("similarity", 6).alias("similarity"), "rank")


KNN_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {_pairs("vec_id AS id, path, embedding AS e FROM note_embeddings")},
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY s DESC, b_path) AS rank FROM p WHERE s >= 0.12 AND a_id <> b_id)
SELECT a_path AS source, b_path AS target, round(s, 6) AS similarity, rank FROM r WHERE rank <= 40"""


def mean_pool(spark, sf):
    vectors = fx.table(spark, sf, "embeddings").select(
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("path"), F.col("vec_id").alias("chunk_index"),
        F.transform("embedding", lambda v: v.cast("double")).alias("embedding"),
    )
    return vx.mean_pool(vectors).select("path", F.posexplode("embedding").alias("pos", "v")).select("path", "pos", F.round("v", 6).alias("value"))


MEAN_POOL_SQL = """
SELECT 'label ' || label AS path, CAST(pos - 1 AS INTEGER) AS pos, round(avg(v), 6) AS value
FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
GROUP BY ALL"""


def latest_embedding(spark, sf):
    """Records of one folder compete for one path, so that the latest has to be chosen."""
    records = fx.note_embeddings(spark, sf).withColumn("path", F.regexp_replace("path", "[^/]+$", "folder.md"))
    return vx.latest_embeddings(records).select("path", "vec_id", "model", "created_at", "content_hash", F.size("embedding").alias("dim"))


LATEST_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL},
r AS (SELECT *, regexp_replace(path, '[^/]*$', 'folder.md') AS p FROM note_embeddings)
SELECT p AS path, vec_id, model, created_at, content_hash, CAST(len(embedding) AS INTEGER) AS dim FROM r
QUALIFY row_number() OVER (PARTITION BY p ORDER BY created_at DESC) = 1"""


def stale_or_missing(spark, sf):
    return mt.stale_or_missing(fx.notes(spark, sf), vx.latest_embeddings(fx.note_vectors(spark, sf)), "M1")


STALE_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}
SELECT n.path, CASE WHEN e.model IS NULL THEN 'missing' ELSE 'stale' END AS state
FROM notes n LEFT JOIN note_embeddings e USING (path) WHERE e.model IS NULL OR e.model = 'm0'"""


def reembed_targets(spark, sf):
    candidates = fx.notes(spark, sf).select("path", (-F.col("doc_id")).alias("position"))
    return mt.reembed_targets(candidates, vx.latest_embeddings(fx.note_vectors(spark, sf)), "m1", 25).select("path", "state")


REEMBED_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}
SELECT n.path, CASE WHEN e.model IS NULL THEN 'missing' ELSE 'stale' END AS state
FROM notes n LEFT JOIN note_embeddings e USING (path) WHERE e.model IS NULL OR e.model = 'm0'
ORDER BY n.doc_id DESC LIMIT 25"""


def orphan_embeddings(spark, sf):
    """The index against the notes outside export folders."""
    docs = fx.notes(spark, sf).filter(~F.contains("path", F.lit("/exports/")))
    return mt.orphan_embeddings(fx.note_vectors(spark, sf), docs)


ORPHANS_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}
SELECT DISTINCT path FROM note_embeddings WHERE path NOT IN (SELECT path FROM notes WHERE NOT contains(path, '/exports/'))"""


def index_health(spark, sf):
    fails = mt.latest_failures(fx.embedding_failures(spark, sf), fx.embedding_failures(spark, sf))
    issues = mt.index_health(fx.notes(spark, sf), vx.latest_embeddings(fx.note_vectors(spark, sf)), fails, "m1")
    return issues.select("path", "type", "reason", "detail", "rank")


INDEX_HEALTH_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {fx.FAILURES_SQL}
SELECT n.path, 'missing' AS type, 'No embedding found for this eligible note' AS reason,
  'Generate or rebuild embeddings so Q&A can use this note.' AS detail, 1 AS rank
FROM notes n WHERE path NOT IN (SELECT path FROM note_embeddings)
UNION ALL SELECT path, 'stale', 'Indexed with m0 instead of m1', 'Current embedding model on file: m0', 2
FROM note_embeddings WHERE model = 'm0' AND path IN (SELECT path FROM notes)
UNION ALL SELECT path, 'failed', 'Last embedding attempt failed', message, 0 FROM failures"""


def index_health_status(spark, sf):
    fails = mt.latest_failures(fx.embedding_failures(spark, sf), fx.embedding_failures(spark, sf))
    return mt.index_health_status(fx.notes(spark, sf), vx.latest_embeddings(fx.note_vectors(spark, sf)), fails, "m1")


HEALTH_STATUS_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {fx.FAILURES_SQL}
SELECT count(*) AS eligible, count(e.path) AS indexed, count(*) FILTER (WHERE e.model = 'm0') AS stale, count(f.path) AS failed
FROM notes n LEFT JOIN note_embeddings e USING (path) LEFT JOIN failures f USING (path)"""


def model_status(spark, sf):
    status = mt.model_status(fx.notes(spark, sf), fx.note_vectors(spark, sf), "m1")
    return status.withColumn("observed_models", F.array_join("observed_models", ","))


MODEL_STATUS_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE model <> 'm0') AS up_to_date, count(*) FILTER (WHERE model = 'm0') AS stale,
  string_agg(DISTINCT model, ',' ORDER BY model) AS observed_models
FROM note_embeddings WHERE path IN (SELECT path FROM notes)"""


def embedding_work(spark, sf):
    return mt.embedding_work(fx.notes(spark, sf), fx.note_embeddings(spark, sf), "m1").select("path", "state", "content_hash")


EMBEDDING_WORK_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL},
h AS (SELECT path, lpad(printf('%x', list_reduce(
      list_prepend(2166136261::BIGINT, list_transform(string_split(content, ''), lambda c: unicode(c)::BIGINT)),
      lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0') AS content_hash FROM notes)
SELECT n.path, CASE WHEN e.path IS NULL THEN 'new' WHEN e.model = 'm0' THEN 'stale'
  WHEN e.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS state, n.content_hash
FROM h n LEFT JOIN note_embeddings e USING (path)"""


def retry_state(spark, sf):
    log = fx.task_log(spark, sf)
    as_of = F.timestamp_micros(F.lit(1706659200000000))
    state = mt.retry_state(log, as_of, 6 * 3600)
    since = mt.failures_since_success(log).select("path", "retries", "message")
    return state.join(since, "path", "left").select("path", "can_retry", F.coalesce("retries", F.lit(0)).alias("retries"), F.coalesce("message", F.lit("")).alias("message"))


RETRY_SQL = """
WITH l AS (SELECT printf('user %05d.md', user_id) AS path, ts, event_type, props FROM events),
s AS (SELECT path, max(ts) FILTER (WHERE event_type = 'error') AS failed_at, max(ts) FILTER (WHERE event_type <> 'error') AS ok_at FROM l GROUP BY path),
r AS (SELECT l.path, count(*) AS retries, arg_max(props, ts) AS message FROM l JOIN s USING (path)
      WHERE event_type = 'error' AND (ok_at IS NULL OR ts > ok_at) GROUP BY l.path)
SELECT s.path, (failed_at IS NULL OR coalesce(ok_at > failed_at, false) OR TIMESTAMP '2024-01-31 00:00:00' > failed_at + INTERVAL 6 HOUR) AS can_retry,
  coalesce(retries, 0) AS retries, coalesce(message, '') AS message
FROM s LEFT JOIN r USING (path)"""


def retry_failed(spark, sf):
    log = fx.task_log(spark, sf).filter(F.col("outcome") == "failed")
    return mt.retry_failed(log.select("path", F.col("finished_at").alias("at"))).select("path")


RETRY_FAILED_SQL = """
SELECT printf('user %05d.md', user_id) AS path FROM events WHERE event_type = 'error'
GROUP BY path ORDER BY max(ts) DESC LIMIT 8"""

ITEMS = {
    "semantic_topk": Item(semantic_topk, SEMANTIC_SQL),
    "knn_candidates": Item(knn_candidates, KNN_SQL),
    "mean_pool": Item(mean_pool, MEAN_POOL_SQL),
    "latest_embedding": Item(latest_embedding, LATEST_SQL),
    "stale_or_missing": Item(stale_or_missing, STALE_SQL),
    "reembed_targets": Item(reembed_targets, REEMBED_SQL),
    "orphan_embeddings": Item(orphan_embeddings, ORPHANS_SQL),
    "index_health": Item(index_health, INDEX_HEALTH_SQL),
    "index_health_status": Item(index_health_status, HEALTH_STATUS_SQL),
    "model_status": Item(model_status, MODEL_STATUS_SQL),
    "embedding_work": Item(embedding_work, EMBEDDING_WORK_SQL),
    "retry_state": Item(retry_state, RETRY_SQL),
    "retry_failed": Item(retry_failed, RETRY_FAILED_SQL),
}
