"""Registered queries: links and neighbours."""

from pyspark.sql import functions as F

from corpusloom.operators import consistency as cs
from corpusloom.operators import links as lk
from corpusloom.plans import fixtures as fx
from corpusloom.plans import sqlparts as q
from corpusloom.plans.catalog import Item
from corpusloom.session import stored


def linked_notes(spark, sf):
    """Notes with links of every kind: aliased, anchored, relative, ambiguous, external and broken."""
    n = fx.notes(spark, sf)
    name = F.format_string("%05d", (F.col("doc_id") * 3) % 97 + 100)
    more = F.concat(
        F.lit("\n[[Doc "), name, F.lit("#Links|the "), name, F.lit("]] ![pic](doc "), name, F.lit(") [web](https://example.com/x) [here](#top) [[doc "),
        F.format_string("%05d", F.col("doc_id") % 20), F.lit(" final]] [self](./"), "path", F.lit(") [[index]]"),
    )
    extra = F.when(F.col("doc_id") % 50 == 7, F.regexp_replace("path", "[^/]+$", "index.md")).otherwise(F.col("path"))
    return n.select("doc_id", extra.alias("path"), F.concat("content", more).alias("content"))


LINKED_SQL = f"""{fx.NOTES_SQL},
linked AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN regexp_replace(path, '[^/]+$', 'index.md') ELSE path END AS path,
  content || chr(10) || '[[Doc ' || nm || '#Links|the ' || nm || ']] ![pic](doc ' || nm || ') [web](https://example.com/x) [here](#top) [[doc '
  || printf('%05d', doc_id % 20) || ' final]] [self](./' || path || ') [[index]]' AS content
  FROM (SELECT *, printf('%05d', (doc_id * 3) % 97 + 100) AS nm FROM notes)),
files AS (SELECT DISTINCT path AS file FROM linked)"""


def extract_links(spark, sf):
    return lk.extract_links(linked_notes(spark, sf)).select("path", "kind", "target", "label", "full")


_W, _M = lk.WIKI_LINK, lk.MARKDOWN_LINK
LINKS_CTE = f"""
lx AS (SELECT path, 'wiki' AS kind, unnest(regexp_extract_all(content, '{_W}', 0)) AS "full", unnest(regexp_extract_all(content, '{_W}', 1)) AS t, unnest(regexp_extract_all(content, '{_W}', 2)) AS l FROM linked
  UNION ALL SELECT path, 'markdown', unnest(regexp_extract_all(content, '{_M}', 0)), unnest(regexp_extract_all(content, '{_M}', 2)), unnest(regexp_extract_all(content, '{_M}', 1)) FROM linked),
links AS (SELECT path, kind, trim(t) AS target, coalesce(trim(l), '') AS label, "full" FROM lx
  WHERE kind = 'wiki' OR NOT (regexp_matches(trim(t), '(?i)^https?://') OR starts_with(trim(t), '#')))"""
LINKS_SQL = f"WITH {LINKED_SQL}, {LINKS_CTE} SELECT path, kind, target, label, \"full\" FROM links"

_EXT = q.quoted(lk.LINK_EXTENSIONS)
RESOLVE_CTE = f"""{LINKS_CTE},
tg AS (SELECT target, trim(regexp_replace({q.norm_path("regexp_replace(target, '#.*$', '')")}, '^\\./', '')) AS nrm FROM (SELECT DISTINCT target FROM links)),
ky AS (SELECT target, lower(k) AS k, i FROM (SELECT target, unnest([nrm, st] || list_transform([{_EXT}], lambda e: st || e)) AS k,
   unnest(range(0, 17)) AS i FROM (SELECT *, regexp_replace(nrm, '\\.[^.]+$', '') AS st FROM tg WHERE nrm <> ''))),
ex AS (SELECT target, arg_min(file, i) AS file FROM ky JOIN files ON lower(file) = k GROUP BY target),
ti AS (SELECT lower(regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^.]+$', '')) AS title, list(file ORDER BY file) AS fs FROM files GROUP BY ALL),
res AS (SELECT tg.target, CASE WHEN ex.file IS NOT NULL THEN ex.file WHEN nrm <> '' AND len(fs) = 1 THEN fs[1] END AS resolved,
   CASE WHEN ex.file IS NOT NULL THEN 'exact' WHEN nrm = '' OR fs IS NULL THEN 'missing' WHEN len(fs) = 1 THEN 'title' ELSE 'ambiguous' END AS reason,
   CASE WHEN ex.file IS NOT NULL THEN [ex.file] WHEN nrm = '' OR fs IS NULL THEN [] ELSE fs[1:8] END AS candidates
   FROM tg LEFT JOIN ex USING (target) LEFT JOIN ti ON title = lower(regexp_replace(regexp_extract(nrm, '[^/]*$'), '\\.[^.]+$', '')))"""


def resolve_targets(spark, sf):
    n = linked_notes(spark, sf)
    return lk.resolve_targets(lk.extract_links(n), n).withColumn("candidates", F.array_join("candidates", "|"))


RESOLVE_SQL = f"WITH {LINKED_SQL}, {RESOLVE_CTE} SELECT target, resolved, reason, coalesce(array_to_string(candidates, '|'), '') AS candidates FROM res"


def broken_references(spark, sf):
    n = linked_notes(spark, sf)
    return lk.broken_references(n, n).select("path", "kind", "target", "reason", F.array_join("candidates", "|").alias("candidates"))


BROKEN_SQL = f"""
WITH {LINKED_SQL}, {RESOLVE_CTE}
SELECT path, kind, target, reason, coalesce(array_to_string(candidates, '|'), '') AS candidates FROM links JOIN res USING (target) WHERE resolved IS NULL"""


def repair_references(spark, sf):
    n = linked_notes(spark, sf)
    fixed = stored(lk.repair_references(n, n))
    broken_after = lk.broken_references(fixed, n).groupBy("path").count()
    return (
        fixed.join(broken_after, "path", "left")
        .select("doc_id", "path", "replaced", F.coalesce("count", F.lit(0)).alias("still_broken"),
                F.array_join(lk.matches("content", lk.WIKI_LINK, 0), "|").alias("wiki_links"))
    )


REPAIR_SQL = f"""
WITH {LINKED_SQL}, {RESOLVE_CTE},
j AS (SELECT * FROM links JOIN res USING (target)),
c AS (SELECT path, count(*) FILTER (WHERE reason = 'title') AS replaced, count(*) FILTER (WHERE resolved IS NULL) AS broken FROM j GROUP BY path),
d AS (SELECT doc_id, path, content, unnest(regexp_extract_all(content, '{_W}', 0)) AS "full", unnest(regexp_extract_all(content, '{_W}', 1)) AS t,
   unnest(regexp_extract_all(content, '{_W}', 2)) AS l, generate_subscripts(regexp_extract_all(content, '{_W}', 0), 1) AS i FROM linked),
w AS (SELECT doc_id, string_agg(CASE WHEN reason = 'title' THEN '[[' || resolved || CASE WHEN coalesce(trim(l), '') = '' THEN '' ELSE '|' || trim(l) END || ']]' ELSE d."full" END, '|' ORDER BY i) AS wiki_links
   FROM d JOIN res ON res.target = trim(d.t) GROUP BY doc_id)
SELECT linked.doc_id, path, replaced, broken AS still_broken, wiki_links
FROM linked JOIN c USING (path) JOIN w USING (doc_id) WHERE replaced > 0"""


def remove_wiki_links(spark, sf):
    n = linked_notes(spark, sf)
    removals = n.select("path", F.concat(F.lit("notes/any/Doc "), F.format_string("%05d", F.col("doc_id") % 20), F.lit(" final.md")).alias("target_path"))
    return lk.remove_wiki_links(n, removals.distinct()).select("doc_id", "path", "replaced", F.md5(F.col("content").cast("binary")).alias("content_md5"))


REMOVE_SQL = f"""
WITH {LINKED_SQL},
r AS (SELECT DISTINCT path, doc_id % 20 AS k FROM linked),
h AS (SELECT linked.doc_id, path, content, list_sort(list_distinct(list('[[doc ' || printf('%05d', k) || ' final]]' ORDER BY k))) AS swaps
  FROM linked JOIN r USING (path) GROUP BY ALL),
x AS (SELECT doc_id, path, content, s, (length(content) - length(replace(content, s, ''))) // length(s) AS times FROM (SELECT *, unnest(swaps) AS s FROM h)),
y AS (SELECT path, sum(times) AS replaced FROM x GROUP BY path)
SELECT doc_id, path, CAST(replaced AS BIGINT) AS replaced, md5(regexp_replace(content, '\\[\\[(doc ' || printf('%05d', doc_id % 20) || ' final)\\]\\]', '\\1', 'g')) AS content_md5
FROM linked JOIN y USING (path) WHERE replaced > 0"""


def mention_backlinks(spark, sf):
    return lk.mention_backlinks(fx.notes(spark, sf))


MENTIONS_SQL = f"""
WITH {fx.NOTES_SQL},
t AS (SELECT path, lower(trim(regexp_replace(regexp_extract(path, '[^/]*$'), '(?i)\\.md$', ''))) AS title FROM notes),
d AS (SELECT path AS source, lower(content) AS c, lower(path) AS p, lower(regexp_extract(path, '[^/]*$')) AS n FROM notes),
f AS (SELECT t.path, d.source, title, c, p, n FROM t JOIN d ON contains(c, title) AND regexp_matches(c, '\\b' || regexp_escape(title) || '\\b') AND t.path <> d.source),
s AS (SELECT *, CASE WHEN contains(n, title) THEN 120 ELSE 0 END + CASE WHEN contains(p, title) THEN 60 ELSE 0 END + 40
  + list_sum(list_transform(string_split(title, ' '), lambda w: CASE WHEN contains(n, w) THEN 20 ELSE 0 END + CASE WHEN contains(p, w) THEN 10 ELSE 0 END + CASE WHEN contains(c, w) THEN 4 ELSE 0 END)) AS score FROM f)
SELECT path, source, CAST(score AS INTEGER) AS score, row_number() OVER (PARTITION BY path ORDER BY score DESC, source) AS rank FROM s QUALIFY rank <= 20"""


def _suggestion_inputs(spark, sf):
    n = fx.notes(spark, sf)
    name = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), "\\.md$", "")
    edges = n.select(
        F.col("path").alias("target"), F.col("doc_id"), name.alias("name"), (F.col("doc_id") + 1).alias("src_id"),
    ).join(n.select(F.col("doc_id").alias("src_id"), F.col("path").alias("source")), "src_id").select(
        "source", "target", F.when(F.col("doc_id") % 2 == 0, "high").otherwise("medium").alias("confidence"),
        (F.lit(0.6) + (F.col("doc_id") % 40) / 100).alias("score"), F.lit("r").alias("reason"), F.lit(1).alias("rank"), "name", "src_id",
    )
    docs = n.join(edges.select(F.col("source").alias("path"), "name"), "path").select(
        "path",
        F.concat(
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("See [[x "), "name", F.lit(" y]] and ")))
            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("About "), F.upper("name"), F.lit(". ")))
            .otherwise(F.concat(F.lit("Has [["), "name", F.lit("]]. "), "name", F.lit(" "))), "content",
        ).alias("content"),
    )
    shown = F.lower(F.regexp_replace("target", "\\.md$", ""))
    dismissed = edges.filter(F.col("src_id") % 7 == 0).select("source", F.concat_ws("::", shown, F.lower("name")).alias("id"))
    rejections = n.filter(F.col("doc_id") % 4 == 0).select(F.col("path").alias("target"), (F.col("doc_id") % 12 / 4 + 1).cast("int").alias("n"))
    return edges, docs, dismissed, rejections


def link_suggestions(spark, sf):
    return lk.link_suggestions(*_suggestion_inputs(spark, sf)).select("source", "target", "title", F.round("score", 6).alias("score"), "confidence", "n")


SUGGESTIONS_SQL = f"""
WITH {fx.NOTES_SQL},
e AS (SELECT b.path AS source, a.path AS target, a.doc_id AS id, b.doc_id AS sid, regexp_replace(regexp_extract(a.path, '[^/]*$'), '\\.md$', '') AS name,
   CASE WHEN a.doc_id % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, 0.6::DOUBLE + (a.doc_id % 40)::DOUBLE / 100 AS score,
   CASE WHEN a.doc_id % 4 = 0 THEN CAST((a.doc_id % 12) // 4 + 1 AS INTEGER) ELSE 0 END AS rejected FROM notes a JOIN notes b ON b.doc_id = a.doc_id + 1)
SELECT source, target, CASE WHEN regexp_matches(c.content, '^About ') THEN upper(name) ELSE name END AS title, round(score, 6) AS score, confidence, 1 AS n
FROM e, LATERAL (SELECT CASE sid % 3 WHEN 0 THEN 'See [[x ' || name || ' y]] and ' WHEN 1 THEN 'About ' || upper(name) || '. ' ELSE 'Has [[' || name || ']]. ' || name || ' ' END AS content) c
WHERE (confidence = 'high' OR score >= 0.72) AND NOT (rejected >= 3 AND score < 0.86) AND NOT (rejected >= 2 AND confidence <> 'high') AND sid % 3 = 1 AND sid % 7 <> 0"""


def nearby_siblings(spark, sf):
    n = fx.notes(spark, sf)
    return lk.nearby_siblings(n, n.filter(F.contains("path", F.lit(" draft"))))


SIBLINGS_SQL = f"""
WITH {fx.NOTES_SQL},
p AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, contains(path, ' draft') AS open,
   row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY lower(regexp_extract(path, '[^/]*$')), path) AS pos FROM notes)
SELECT a.path, b.path AS sibling, row_number() OVER (PARTITION BY a.path ORDER BY abs(b.pos - a.pos), b.pos > a.pos) AS rank
FROM p a JOIN p b ON a.folder = b.folder AND a.path <> b.path AND NOT b.open QUALIFY rank <= 5"""


def recent_documents(spark, sf):
    n = fx.table(spark, sf, "documents").select(F.max("doc_id") + 1).scalar()
    e = fx.table(spark, sf, "events").withColumn("note", F.col("user_id") % n)
    e = e.join(fx.notes(spark, sf).select(F.col("doc_id").alias("note"), "path"), "note")
    return lk.recent_documents(e.select("path", "ts")).select("path", F.col("ts").cast("string").alias("ts"))


RECENT_SQL = f"""
WITH {fx.NOTES_SQL}
SELECT path, CAST(max(ts) AS VARCHAR) AS ts FROM events JOIN notes ON doc_id = user_id % (SELECT max(doc_id) + 1 FROM documents) GROUP BY path ORDER BY max(ts) DESC, path LIMIT 5"""

def retrieval_eligible(spark, sf):
    return cs.retrieval_eligible(fx.named_files(spark, sf))


_T = q.strip("content")
ELIGIBLE_SQL = f"""
WITH {fx.NAMED_FILES_SQL},
t AS (SELECT path, kind, {_T} AS t, regexp_extract_all(lower({_T}), '[a-z]{{2,}}') AS w FROM named_files),
f AS (SELECT *, length(regexp_replace(t, '{q.WS}+', '', 'g')) AS n, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS a, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS d FROM t)
SELECT DISTINCT path FROM f WHERE kind <> 'image' OR (length(t) >= 240 AND len(w) >= 45 AND a::DOUBLE / n >= 0.38 AND NOT (d::DOUBLE / n > 0.34 AND a::DOUBLE / n < 0.52)
  AND (n - a - d)::DOUBLE / n <= 0.28 AND len(list_distinct(w))::DOUBLE / len(w) >= 0.28)"""


def consistency_report(spark, sf):
    return cs.consistency_report(linked_notes(spark, sf), fx.note_vectors(spark, sf))


CONSISTENCY_SQL = f"""
WITH {LINKED_SQL}, {RESOLVE_CTE}
SELECT (SELECT count(*) FROM linked) AS valid_notes,
  (SELECT count(*) FROM (SELECT DISTINCT coalesce(n.path, 'gone/vec ' || printf('%05d', vec_id) || '.md') AS p FROM embeddings LEFT JOIN notes n ON n.doc_id = vec_id) WHERE p NOT IN (SELECT path FROM linked)) AS orphan_embeddings,
  (SELECT count(*) FROM links JOIN res USING (target) WHERE resolved IS NULL) AS broken_references"""

ITEMS = {
    "retrieval_eligible": Item(retrieval_eligible, ELIGIBLE_SQL),
    "consistency_report": Item(consistency_report, CONSISTENCY_SQL),
    "extract_links": Item(extract_links, LINKS_SQL),
    "resolve_targets": Item(resolve_targets, RESOLVE_SQL),
    "broken_references": Item(broken_references, BROKEN_SQL),
    "repair_references": Item(repair_references, REPAIR_SQL),
    "remove_wiki_links": Item(remove_wiki_links, REMOVE_SQL),
    "mention_backlinks": Item(mention_backlinks, MENTIONS_SQL),
    "link_suggestions": Item(link_suggestions, SUGGESTIONS_SQL),
    "nearby_siblings": Item(nearby_siblings, SIBLINGS_SQL),
    "recent_documents": Item(recent_documents, RECENT_SQL),
}
