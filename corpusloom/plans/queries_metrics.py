"""Registered queries: metrics, activity, document structure, chunks and changes."""

from pyspark.sql import functions as F

from corpusloom.operators import metrics as mx
from corpusloom.operators import texts as ts
from corpusloom.plans import fixtures as fx
from corpusloom.plans import queries_text as qt
from corpusloom.plans import sqlparts as q
from corpusloom.plans.catalog import Item
from corpusloom.streaming import changes as ch

METRIC_OF = {"signup": "file_open_ms", "purchase": "keyword_search_ms", "error": "search_retrieval_ms", "view": "vault_tree_load_ms", "click": "sidebar_related_ms"}
SCAN_OF = {"signup": "scan_tree_load", "purchase": "scan_text_read", "error": "scan_ai_doc_read", "view": "scan_keyword_search"}


def _samples(spark, sf):
    e = fx.table(spark, sf, "events")
    named = F.create_map(*[F.lit(v) for pair in METRIC_OF.items() for v in pair])
    return e.select(F.try_element_at(named, F.col("event_type")).alias("metric"), "ts", F.col("event_id").alias("sample_id"), (F.col("value") * 5).alias("elapsed_ms"))


_CASE = lambda m: "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
SUMMARY_CTE = f"""
s AS (SELECT {_CASE(METRIC_OF)} AS metric, ts, event_id, value * 5 AS ms FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS n FROM s QUALIFY n <= 180),
summ AS (SELECT metric, count(*) AS count, floor(max(ms) FILTER (WHERE n = 1) * 10 + 0.5::DOUBLE) / 10 AS last_ms, floor(quantile_disc(ms, 0.5) * 10 + 0.5::DOUBLE) / 10 AS p50_ms,
  floor(quantile_disc(ms, 0.95) * 10 + 0.5::DOUBLE) / 10 AS p95_ms, floor(avg(ms) * 10 + 0.5::DOUBLE) / 10 AS mean_ms FROM l GROUP BY metric)"""


def latency_summary(spark, sf):
    return mx.latency_summary(_samples(spark, sf))


LATENCY_SQL = f"WITH {SUMMARY_CTE} SELECT * FROM summ"


def bottlenecks(spark, sf):
    e = fx.table(spark, sf, "events")
    named = F.create_map(*[F.lit(v) for pair in SCAN_OF.items() for v in pair])
    scans = mx.scan_operations(e.select(F.try_element_at(named, F.col("event_type")).alias("operation"), F.col("value").alias("elapsed_ms")).filter(F.col("operation").isNotNull()))
    return mx.merged_bottlenecks(scans, mx.bottlenecks(mx.latency_summary(_samples(spark, sf))))


def _values(table) -> str:
    return ", ".join(f"('{k}', '{a}', {b}, {c})" for k, (a, b, c) in table.items())


BOTTLENECKS_SQL = f"""
WITH {SUMMARY_CTE},
lt(key, label, watch, slow) AS (VALUES {_values(mx.LIVE_THRESHOLDS)}), st(key, label, watch, slow) AS (VALUES {_values(mx.SCAN_THRESHOLDS)}),
live AS (SELECT key, label, p95_ms AS observed_ms, watch AS threshold_ms, CASE WHEN p95_ms >= slow THEN 'slow' ELSE 'watch' END AS severity, 'live' AS source
  FROM summ JOIN lt ON metric = key WHERE p95_ms >= watch ORDER BY p95_ms DESC, key LIMIT 5),
scan AS (SELECT key, label, floor(m * 10 + 0.5::DOUBLE) / 10 AS observed_ms, watch AS threshold_ms, CASE WHEN m >= slow THEN 'slow' ELSE 'watch' END AS severity, 'scan' AS source
  FROM (SELECT {_CASE(SCAN_OF)} AS op, max(value) AS m FROM events GROUP BY ALL) JOIN st ON op = key WHERE m >= watch)
SELECT * FROM (SELECT * FROM scan UNION ALL SELECT * FROM live) ORDER BY observed_ms DESC, key LIMIT 6"""


def recommendations(spark, sf):
    e = fx.table(spark, sf, "events")
    named = F.create_map(*[F.lit(v) for pair in SCAN_OF.items() for v in pair])
    scans = mx.scan_operations(e.select(F.try_element_at(named, F.col("event_type")).alias("operation"), F.col("value").alias("elapsed_ms")).filter(F.col("operation").isNotNull()))
    return mx.recommendations(scans, mx.bottlenecks(mx.latency_summary(_samples(spark, sf))))


RECOMMENDATIONS_SQL = f"""
WITH {SUMMARY_CTE},
lt(key, label, watch, slow) AS (VALUES {_values(mx.LIVE_THRESHOLDS)}), st(key, label, watch, slow) AS (VALUES {_values(mx.SCAN_THRESHOLDS)}),
answers AS (SELECT count(*) AS n FROM (SELECT metric FROM summ JOIN lt ON metric = key WHERE p95_ms >= watch ORDER BY p95_ms DESC, key LIMIT 5) WHERE metric IN ('qa_multi_ms', 'qa_single_ms')),
sev AS (SELECT key, CASE WHEN m >= slow THEN 'slow' WHEN m >= watch THEN 'watch' ELSE 'good' END AS s
  FROM (SELECT {_CASE(SCAN_OF)} AS op, max(value) AS m FROM events GROUP BY ALL) JOIN st ON op = key),
said(nth, key, worst, advice) AS (VALUES
  (1, 'scan_tree_load', false, 'Tree loading is trending slow: keep folders collapsed and avoid many file operations in a row.'),
  (2, 'scan_text_read', true, 'Text reads are slower than expected: trim or split large notes of one folder.'),
  (3, 'scan_ai_doc_read', false, 'Document extraction is a hotspot: keep very large documents out of active work, or open them once to warm the cache.'),
  (4, 'scan_keyword_search', false, 'Keyword search is a bottleneck: favor narrower searches and let the query cache warm.')),
notes AS (SELECT nth, advice FROM said LEFT JOIN sev USING (key) WHERE CASE WHEN worst THEN s = 'slow' ELSE s IS NULL OR s <> 'good' END
  UNION ALL SELECT 5, 'Answering is one of the slower paths: faster models or smaller contexts help most.' FROM answers WHERE n > 0),
listed AS (SELECT * FROM notes UNION ALL SELECT 9, 'The sampled paths look healthy right now.' WHERE NOT EXISTS (SELECT * FROM notes))
SELECT CAST(row_number() OVER (ORDER BY nth) - 1 AS INTEGER) AS position, advice FROM listed QUALIFY position < 4"""


def task_telemetry(spark, sf):
    tasks = fx.task_log(spark, sf).withColumn("queue", F.col("path"))
    t = mx.task_telemetry(tasks)
    return t.select("queue", *[F.round(c, 6).alias(c) for c in t.columns if c not in ("queue", "hit_samples")], "hit_samples", mx.backlog_tier(F.col("hit_samples") * 4).alias("tier"))


TELEMETRY_SQL = """
WITH t AS (SELECT printf('user %05d.md', user_id) AS queue, event_id, ts, CAST(trunc(value * 1000) AS BIGINT)::DOUBLE AS ms, event_type = 'error' AS failed, user_id % 2 = 0 AS hit FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts DESC, event_id DESC) AS n FROM t QUALIFY n <= 96)
SELECT queue, round(avg(ms) FILTER (WHERE n <= 24), 6) AS avg_task_ms, round(quantile_disc(ms, 0.95) FILTER (WHERE n <= 24), 6) AS p95_task_ms, round(avg(failed::INT) FILTER (WHERE n <= 24), 6) AS failure_rate,
  round(avg(ms), 6) AS avg_wait_ms, round(quantile_disc(ms, 0.95), 6) AS p95_wait_ms, round(avg(hit::INT), 6) AS hit_rate, count(*) AS hit_samples,
  CASE WHEN count(*) * 4 >= 420 THEN 'very_large' WHEN count(*) * 4 >= 180 THEN 'large' WHEN count(*) * 4 >= 80 THEN 'medium' ELSE 'small' END AS tier
FROM r GROUP BY queue"""


def _typing(spark, sf):
    """Events as typing: seconds become milliseconds and users share documents, a thousand events each, so that bursts appear."""
    e = fx.table(spark, sf, "events")
    writers = F.greatest(F.lit(7), F.floor(e.select(F.count(F.lit(1))).scalar() / 1000))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    base = F.lit(fx.EPOCH_2024_US)
    return e.select("event_id", F.pmod("user_id", writers).alias("user_id"), F.timestamp_micros(base + F.floor((us - base) / 1000)).alias("ts"), F.col("value").alias("chars"))


def activity_pressure(spark, sf):
    a = mx.activity_pressure(_typing(spark, sf), bucket_seconds=60)
    return a.select("event_id", "user_id", "chars_in_window", "events_in_window", F.round("chars_per_second", 6).alias("chars_per_second"), "pressure")


ACTIVITY_SQL = """
WITH e AS (SELECT event_id, user_id % (SELECT greatest(7, count(*) // 1000) FROM events) AS user_id, (epoch_us(ts) - 1704067200000000) // 1000 AS us, greatest(1, least(256, CAST(floor(value + 0.5::DOUBLE) AS BIGINT))) AS chars FROM events),
w AS (SELECT *, sum(chars) OVER f AS c, count(*) OVER f AS n FROM e WINDOW f AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3200000 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, CAST(c AS BIGINT) AS chars_in_window, n AS events_in_window, round(c / 3.2::DOUBLE, 6) AS chars_per_second,
  CASE WHEN c / 3.2::DOUBLE >= 8 THEN 'high' WHEN c / 3.2::DOUBLE >= 4 THEN 'medium' ELSE 'low' END AS pressure FROM w"""


def _changes(spark, sf):
    e = _typing(spark, sf).join(fx.table(spark, sf, "events").select("event_id", "event_type", "props"), "event_id")
    return e.select(
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.col("props").alias("content"),
        F.when(F.col("event_type") == "signup", "high").otherwise("normal").alias("priority"), "ts",
    )


def settled_changes(spark, sf):
    s = ch.settled_changes(_changes(spark, sf))
    return s.select("path", "edits", "content", "priority", ((F.unix_micros("last_at") - F.unix_micros("first_at")) / 1000000).alias("seconds"))


SETTLED_SQL = """
WITH e AS (SELECT 'user ' || (user_id % (SELECT greatest(7, count(*) // 1000) FROM events)) || '.md' AS path, (epoch_us(ts) - 1704067200000000) // 1000 AS us, props, event_type = 'signup' AS high FROM events),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY path ORDER BY us) < 2200000 THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY us ROWS UNBOUNDED PRECEDING) AS burst FROM b)
SELECT path, count(*) AS edits, arg_max(props, us) AS content, CASE WHEN bool_or(high) THEN 'high' ELSE 'normal' END AS priority, (max(us) - min(us))::DOUBLE / 1000000 AS seconds
FROM s GROUP BY path, burst"""


def outline(spark, sf):
    n = fx.notes(spark, sf).withColumn("content", F.concat("content", F.lit("\n### Deep\n## Next & last\n####  \n")))
    return ts.outline(n)


OUTLINE_SQL = f"""
WITH {fx.NOTES_SQL},
l AS (SELECT path, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS line FROM (SELECT path, string_split(content || chr(10) || '### Deep' || chr(10) || '## Next & last' || chr(10) || '####  ' || chr(10), chr(10)) AS ls FROM notes)),
h AS (SELECT path, line, length(regexp_extract(raw, '^(#{{1,6}})\\s+(.*)$', 1)) AS level, coalesce(nullif(trim(regexp_extract(raw, '^(#{{1,6}})\\s+(.*)$', 2)), ''), 'Untitled') AS text FROM l WHERE regexp_matches(raw, '^(#{{1,6}})\\s+(.*)$'))
SELECT path, CAST(line AS INTEGER) AS line, CAST(level AS INTEGER) AS level, text, regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g') || '-' || line AS id,
  CAST((SELECT min(o.line) FROM h o WHERE o.path = h.path AND o.line > h.line AND o.level <= h.level) AS INTEGER) AS section_end FROM h"""


def blocks(spark, sf):
    n = fx.notes(spark, sf).withColumn("content", F.concat("content", F.lit("\n\n- [ ] open\n- [x] done\n\n1. one\n2) two\n\n```sql\nselect 1\n```\n> [!todo] Later\n> body\n\n| a | b |\n|---|---|\n| 1 | 2 |\n***\nend")))
    return ts.blocks(n)


# A note is a heading, its text, a heading and its links; the blocks appended to it lie at known lines after its last one.
BLOCKS_SQL = f"""
WITH {fx.NOTES_SQL},
l AS (SELECT path, string_split(content, chr(10)) AS ls FROM notes),
s AS (SELECT path, ls, list_position(ls, '## Links') - 1 AS k, len(ls) AS t FROM l),
tail(type, a, b, text, language, callout, title) AS (VALUES
  ('todo', 1, 2, '- [ ] open' || chr(10) || '- [x] done', NULL, NULL, NULL), ('list', 4, 5, '1. one' || chr(10) || '2) two', NULL, NULL, NULL),
  ('code', 7, 9, 'select 1', 'sql', NULL, NULL), ('callout', 10, 11, 'body', NULL, 'todo', 'Later'),
  ('table', 13, 15, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |', NULL, NULL, NULL),
  ('rule', 16, 16, '***', NULL, NULL, NULL), ('paragraph', 17, 17, 'end', NULL, NULL, NULL)),
b AS (
  SELECT path, 'heading' AS type, 0 AS x, 0 AS y, ls[1][3:] AS text, NULL AS language, NULL AS callout, NULL AS title FROM s
  UNION ALL SELECT path, 'paragraph', 2, k - 2, array_to_string(ls[3:k - 1], chr(10)), NULL, NULL, NULL FROM s
  UNION ALL SELECT path, 'heading', k, k, 'Links', NULL, NULL, NULL FROM s
  UNION ALL SELECT path, 'paragraph', k + 1, t - 1, array_to_string(ls[k + 2:t], chr(10)), NULL, NULL, NULL FROM s
  UNION ALL SELECT path, type, t + a, t + b, text, language, callout, title FROM s, tail)
SELECT path, type, CAST(x AS INTEGER) AS start_line, CAST(y AS INTEGER) AS end_line, text, language, callout, title FROM b"""


def occurrences(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return ts.find_occurrences(d, " The ")


OCCURRENCES_SQL = """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(lower(text), 'the') AS p FROM documents WHERE contains(lower(text), 'the')),
e AS (SELECT path, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS nth, len(p) AS n FROM d),
s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY path ORDER BY nth) + nth * 3 AS start FROM e)
SELECT path, CAST(nth AS INTEGER) AS nth, CAST(start AS BIGINT) AS start, CAST(start + 3 AS BIGINT) AS "end" FROM s WHERE nth < n - 1"""


def chunks(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return ts.chunk(d)


# Chunks end after the last separator between the least and the target length, else at the target.
CHUNKS_CTE = f"""
clean AS (SELECT CAST(doc_id AS VARCHAR) AS path, {qt.SANITIZE} AS t FROM documents),
sized AS (SELECT path, t, length(t) AS size FROM clean WHERE t <> ''),
places AS (SELECT path, size, unnest(range(size)) AS st, t FROM sized WHERE size > {ts.CHUNK_THRESHOLD}),
breaks AS (SELECT path, st, st + CASE WHEN substr(t, st + 1, 1) = chr(10) AND substr(t, st + 2, 1) <> chr(10) THEN 1 ELSE 2 END AS en FROM places
  WHERE substr(t, st + 1, 1) = chr(10) OR (substr(t, st + 1, 1) IN ('.', '!', '?', ';', ',') AND substr(t, st + 2, 1) = ' ')),
spans AS (
  SELECT path, size, 0 AS n, 0::BIGINT AS b, size AS e, true AS one FROM sized WHERE size <= {ts.CHUNK_THRESHOLD}
  UNION ALL
  SELECT path, size, 0, 0, (SELECT coalesce(max(en), {ts.CHUNK_TARGET}) FROM breaks k WHERE k.path = sized.path AND st BETWEEN {ts.CHUNK_MIN} AND {ts.CHUNK_TARGET}), false
  FROM sized WHERE size > {ts.CHUNK_THRESHOLD}
  UNION ALL
  SELECT path, size, n + 1, f, CASE WHEN f + {ts.CHUNK_TARGET} >= size THEN size ELSE
    (SELECT coalesce(max(en), f + {ts.CHUNK_TARGET}) FROM breaks k WHERE k.path = s.path AND st BETWEEN f + {ts.CHUNK_MIN} AND f + {ts.CHUNK_TARGET}) END, false
  FROM (SELECT *, greatest(b + 1, e - {ts.CHUNK_OVERLAP}) AS f FROM spans WHERE e < size AND NOT one) s),
pieces AS (SELECT path, n, b, e, trim(substr(t, b + 1, e - b), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM spans JOIN sized USING (path))"""

CHUNKS_SQL = f"""
WITH RECURSIVE {CHUNKS_CTE}
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS INTEGER) AS chunk_index, CAST(b AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", text
FROM pieces WHERE text <> ''"""

EMBED_SQL = f"""
WITH RECURSIVE {CHUNKS_CTE},
counted AS (SELECT CAST(doc_id AS VARCHAR) AS path, count(pieces.text) FILTER (WHERE pieces.text <> '') AS n FROM documents LEFT JOIN pieces ON path = CAST(doc_id AS VARCHAR) GROUP BY doc_id)
SELECT path, CASE WHEN n > 0 THEN 64 END AS dim, CASE WHEN n > 1 THEN n ELSE 0 END AS chunks, 'hashing' AS model,
  CASE WHEN n = 0 THEN 'Cannot generate embedding for empty content' END AS error FROM counted"""


def embed(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    made = ts.embed(d, created_at=F.lit("2024-01-01"))
    return made.select("path", F.size("embedding").alias("dim"), F.size("chunks").alias("chunks"), "model", "error")


ITEMS = {
    "latency_summary": Item(latency_summary, LATENCY_SQL),
    "bottlenecks": Item(bottlenecks, BOTTLENECKS_SQL),
    "recommendations": Item(recommendations, RECOMMENDATIONS_SQL),
    "task_telemetry": Item(task_telemetry, TELEMETRY_SQL),
    "activity_pressure": Item(activity_pressure, ACTIVITY_SQL),
    "settled_changes": Item(settled_changes, SETTLED_SQL),
    "outline": Item(outline, OUTLINE_SQL),
    "blocks": Item(blocks, BLOCKS_SQL),
    "find_occurrences": Item(occurrences, OCCURRENCES_SQL),
    "chunk": Item(chunks, CHUNKS_SQL),
    "embed": Item(embed, EMBED_SQL),
}
