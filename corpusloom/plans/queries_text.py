"""Registered queries: paths and text features."""

from pyspark.sql import functions as F

from corpusloom.functions import paths as pt
from corpusloom.functions import text as tx
from corpusloom.plans import fixtures as fx
from corpusloom.plans import sqlparts as q
from corpusloom.plans.catalog import Item


def path_scope(spark, sf):
    p = fx.path_variants(spark, sf)
    return p.select(
        "doc_id",
        pt.normalize_path("path").alias("normalized"),
        pt.lower_extension("path").alias("extension"),
        pt.is_indexable("path").alias("indexable"),
        pt.is_document_readable("path").alias("readable"),
        pt.is_visual("path").alias("visual"),
        pt.is_reorganizable("path").alias("reorganizable"),
        pt.is_indexable("path", include_trash=True, include_system=True).alias("indexable_all"),
        pt.is_skipped_by_analysis("path").alias("skipped"),
        pt.looks_uncategorized("path").alias("uncategorized"),
        pt.is_structured("path").alias("structured"),
        pt.document_kind(pt.lower_extension("path")).alias("document_kind"),
        pt.source_label("path").alias("source_label"),
        F.array_join(pt.candidate_paths("path"), "|").alias("candidates"),
    )


def _scope_sql() -> str:
    scoped = f"regexp_replace(lower({q.strip(q.norm_path('path'))}), '^notes/', '')"
    inside = (
        "scoped <> '' AND NOT starts_with(scoped, 'trash/') AND NOT regexp_matches(scoped, '(^|/)\\.') "
        f"AND {q.file_name('scoped')} NOT IN ({q.quoted(pt.INTERNAL_NAMES)})"
    )
    inside_all = (
        "scoped <> '' AND NOT regexp_matches(regexp_replace(scoped, '^\\.vn-system(/|$)', ''), '(^|/)\\.') "
        f"AND {q.file_name('scoped')} NOT IN ({q.quoted(pt.INTERNAL_NAMES)})"
    )
    e = q.ext("scoped")
    text, docs, visual = (q.quoted(v) for v in (pt.TEXT_EXTENSIONS, pt.DOCUMENT_EXTENSIONS, pt.VISUAL_EXTENSIONS))
    norm = q.norm_path("path")
    rel = f"regexp_replace({norm}, '(?i)^notes/', '')"
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pt.SOURCE_LABELS.items())
    last_ext = "regexp_extract(lower(regexp_extract(path, '[^/]*$')), '\\.([^.]*)$', 1)"
    return f"""
WITH {fx.PATH_VARIANTS_SQL}, s AS (SELECT *, {scoped} AS scoped FROM path_variants)
SELECT doc_id, {norm} AS normalized, {q.ext('path')} AS extension,
  ({inside} AND {e} IN ('', {text})) AS indexable,
  ({inside} AND {e} IN ('', {text}, {docs})) AS readable,
  ({inside} AND {e} IN ({visual})) AS visual,
  ({inside} AND {e} IN ('', {text}, {docs}, {visual})) AS reorganizable,
  ({inside_all} AND {e} IN ('', {text})) AS indexable_all,
  ({q.file_name(rel)} IN ('index.json', 'embeddings.json') OR {q.ext(rel)} = 'base'
    OR regexp_matches({rel}, '^(Trash|Recovered|\\.vn-system)/')) AS skipped,
  {q.uncategorized('path')} AS uncategorized, {q.structured('path')} AS structured,
  CASE WHEN {q.ext('path')} IN ({docs}) THEN {q.ext('path')}
       WHEN {q.ext('path')} IN ({q.quoted(pt.OCR_EXTENSIONS)}) THEN 'image' ELSE 'text' END AS document_kind,
  CASE {last_ext} {labels} ELSE CASE WHEN {last_ext} IN ({q.quoted(pt.IMAGE_SOURCE_EXTENSIONS)}) THEN 'Image file' ELSE 'Note file' END END AS source_label,
  {norm} || '|' || CASE WHEN starts_with({norm}, 'notes/') THEN regexp_replace({norm}, '^(notes/)+', '') ELSE 'notes/' || {norm} END AS candidates
FROM s"""


def path_parts(spark, sf):
    return fx.notes(spark, sf).select(
        "doc_id",
        pt.file_name("path").alias("name"),
        pt.stem("path").alias("stem"),
        pt.parent("path").alias("parent"),
        pt.top_level("path").alias("top"),
        pt.second_level("path").alias("second"),
        pt.folder_depth("path").alias("depth"),
        pt.suggest_path_from_name("path").alias("suggested"),
        pt.normalize_suggested_path(F.concat(F.lit(" /notes/notes/New Area/"), pt.file_name("path"), F.lit(".md")), "path").alias("cleaned"),
        pt.suggestion_level("path", F.concat(F.lit("src1/"), pt.file_name("path"))).alias("level"),
        pt.relative_path("path", F.lit("src1/en/target.md")).alias("relative"),
    )


PATH_PARTS_SQL = f"""
WITH {fx.NOTES_SQL}, p AS (SELECT doc_id, path, string_split(path, '/') AS s FROM notes)
SELECT doc_id, s[-1] AS name, regexp_replace(s[-1], '\\.[^.]*$', '') AS stem,
  array_to_string(s[1:len(s) - 1], '/') AS parent, s[1] AS top, coalesce(s[2], '') AS second,
  CAST(len(s) - 1 AS INTEGER) AS depth, 'Unsorted/' || s[-1] AS suggested, 'New Area/' || s[-1] AS cleaned,
  {q.level("path", "'src1/' || s[-1]")} AS level,
  CASE WHEN s[1] = 'src1' AND s[2] = 'en' AND len(s) > 2 THEN repeat('../', CAST(len(s) - 3 AS INT)) || 'target.md'
       WHEN s[1] = 'src1' AND len(s) > 1 THEN repeat('../', CAST(len(s) - 2 AS INT)) || 'en/target.md'
       ELSE repeat('../', CAST(len(s) - 1 AS INT)) || 'src1/en/target.md' END AS relative
FROM p"""


def content_hashes(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.content_hash("text").alias("content_hash"))


CONTENT_HASH_SQL = """
SELECT doc_id, lpad(printf('%x', list_reduce(
    list_prepend(2166136261::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)),
    lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0') AS content_hash
FROM documents"""


def sanitized(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(tx.sanitize_text("text").cast("binary")).alias("clean_md5"))


SANITIZE = q.squeeze("regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{009F}\\x{E000}-\\x{F8FF}]', ' ', 'g')")

SANITIZED_SQL = f"""
SELECT doc_id, md5({SANITIZE}) AS clean_md5
FROM documents"""


def extraction_quality(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        "doc_id", tx.extraction_features("text").alias("f"), tx.extraction_quality("text").alias("v")
    )
    return docs.select(
        "doc_id", "f.chars", "f.words", *[F.round(f"f.{c}", 6).alias(c) for c in ("unique_ratio", "letter_ratio", "digit_ratio", "punct_ratio")],
        F.col("v.quality").alias("quality"), F.col("v.score").alias("score"), F.col("v.reason").alias("reason"),
    )


EXTRACTION_QUALITY_SQL = f"""
WITH t AS (SELECT doc_id, {q.strip('text')} AS t FROM documents),
f AS (SELECT doc_id, length(t) AS chars, regexp_extract_all(lower(t), '[a-z]{{2,}}') AS w,
        length(regexp_replace(t, '{q.WS}+', '', 'g')) AS n,
        length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS letters,
        length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digits FROM t),
g AS (SELECT doc_id, chars, len(w) AS words,
        CASE WHEN len(w) > 0 THEN len(list_distinct(w))::DOUBLE / len(w) ELSE 0.0::DOUBLE END AS u,
        CASE WHEN n > 0 THEN letters::DOUBLE / n ELSE 0.0::DOUBLE END AS a,
        CASE WHEN n > 0 THEN digits::DOUBLE / n ELSE 0.0::DOUBLE END AS d,
        CASE WHEN n > 0 THEN (n - letters - digits)::DOUBLE / n ELSE 0.0::DOUBLE END AS p FROM f),
k AS (SELECT *, CASE WHEN chars < 60 OR words < 12 THEN 1
        WHEN a < 0.38 OR (d > 0.34 AND a < 0.52) OR p > 0.28 THEN 2
        WHEN u < 0.28 THEN 3 WHEN chars < 240 OR words < 45 THEN 4 ELSE 5 END AS rule FROM g)
SELECT doc_id, chars, words, round(u, 6) AS unique_ratio, round(a, 6) AS letter_ratio,
  round(d, 6) AS digit_ratio, round(p, 6) AS punct_ratio,
  ['low', 'low', 'medium', 'medium', 'high'][rule] AS quality,
  CAST([0.1, 0.2, 0.48, 0.62, 0.88][rule] AS DOUBLE) AS score,
  ['Very little extracted text was available.',
   'Extracted text looks noisy, form-like, or poorly structured.',
   'Extracted text is repetitive, so foldering should stay conservative.',
   'Extracted text is usable but limited in detail.',
   'Extracted text looks detailed enough for file-aware organization.'][rule] AS reason
FROM k"""


def top_keywords(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(tx.top_keywords("text"), " ").alias("keywords"))


def keywords_sql(table: str, key: str, body: str) -> str:
    """CTE body: the ranked keywords of each text as a list."""
    return f"""
  SELECT {key}, list(token ORDER BY rk) AS keywords FROM (
    SELECT {key}, token, row_number() OVER (PARTITION BY {key} ORDER BY round(w, 6) DESC, first_pos) AS rk FROM (
      SELECT {key}, token, sum(CASE WHEN pos <= 60 THEN 1.7::DOUBLE ELSE 1.0::DOUBLE END) AS w, min(pos) AS first_pos FROM (
        SELECT {key}, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM (
          SELECT {key}, list_filter(regexp_extract_all(lower({body}), '[a-z0-9]{{3,}}'),
            lambda t: t NOT IN ({q.quoted(tx.RELATED_STOP_WORDS)})) AS tokens FROM {table}))
      GROUP BY ALL)) WHERE rk <= 22 GROUP BY {key}"""


TOP_KEYWORDS_SQL = f"""
WITH k AS ({keywords_sql('documents', 'doc_id', 'text')})
SELECT doc_id, coalesce(array_to_string(keywords, ' '), '') AS keywords FROM documents LEFT JOIN k USING (doc_id)"""


def entities(spark, sf):
    notes = fx.notes(spark, sf)
    return notes.select("doc_id", F.array_join(tx.entities("content"), "|").alias("entities"))


def entities_sql(body: str) -> str:
    found = " || ".join(f"regexp_extract_all({body}, '\\b{p}\\b')" for p in tx.ENTITY_PATTERNS)
    kept = f"list_filter(list_transform({found}, lambda e: lower(trim(e))), lambda e: length(e) >= 2)"
    first = f"list_filter({kept}, lambda e, i: list_position({kept}, e) = i)"
    return first


ENTITIES_SQL = f"""
WITH {fx.NOTES_SQL},
found AS (SELECT doc_id, list_filter(list_transform({" || ".join(f"regexp_extract_all(content, '\\b{p}\\b')" for p in tx.ENTITY_PATTERNS)},
            lambda e: lower(trim(e))), lambda e: length(e) >= 2) AS es FROM notes),
ranked AS (SELECT doc_id, e, min(i) AS i FROM (SELECT doc_id, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM found) GROUP BY ALL),
top AS (SELECT doc_id, e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rk FROM ranked)
SELECT doc_id, coalesce(string_agg(e, '|' ORDER BY rk), '') AS entities
FROM notes LEFT JOIN top USING (doc_id) GROUP BY doc_id"""


def sentences(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(tx.sentences("text")).alias("position", "sentence"))
    return docs


SENTENCES_SQL = f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.?!]){q.WS}+', '\\1' || chr(10), 'g'), chr(10)),
    lambda x: {q.squeeze('x')}), lambda x: length(x) >= 6) AS ss FROM documents)
SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS position, unnest(ss) AS sentence FROM s"""


def timeline_dates(spark, sf):
    notes = fx.notes(spark, sf)
    when = tx.timeline_date("path", "content", "modified_at")
    return notes.select("doc_id", when.alias("w"), tx.looks_date_like("content").alias("date_like")).select(
        "doc_id", F.col("w.year").alias("year"), F.col("w.month").alias("month"), "date_like"
    )


TIMELINE_SQL = f"""
WITH {fx.NOTES_SQL},
m AS (SELECT doc_id, content, modified_s, regexp_extract(content, '\\b(20\\d{{2}})[-_/](\\d{{1,2}})(?:[-_/](\\d{{1,2}}))?\\b', ['y', 'm', 'd']) AS iso FROM notes)
SELECT doc_id, CAST(iso.y AS INTEGER) AS year, CAST(iso.m AS INTEGER) AS month,
  (regexp_matches(content, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b') OR regexp_matches(content, '\\b\\d{{1,2}}[/-]\\d{{1,2}}(?:[/-]\\d{{2,4}})?\\b')
   OR {q.words('content', tx.MONTHS)} OR {q.words('content', tx.WEEKDAYS)}) AS date_like
FROM m"""


def query_terms(spark, sf):
    turns = fx.table(spark, sf, "conversations")
    return turns.select(
        "conv_id", "turn",
        *[F.array_join(tx.query_terms("text", v), " ").alias(v) for v in ("retrieval", "facts", "highlight", "rerank")],
    )


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]{2,}')"
QUERY_TERMS_SQL = f"""
WITH t AS (SELECT conv_id, turn, {_TOKENS} AS w FROM conversations),
d AS (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i AND x NOT IN ({q.quoted(tx.RETRIEVAL_STOP_WORDS)})) AS r FROM t)
SELECT conv_id, turn, coalesce(array_to_string(r, ' '), '') AS retrieval,
  coalesce(array_to_string(list_filter(w, lambda x: x NOT IN ({q.quoted(tx.FACT_STOP_WORDS)})), ' '), '') AS facts,
  coalesce(array_to_string(r, ' '), '') AS highlight, coalesce(array_to_string(w, ' '), '') AS rerank
FROM d"""


def strip_markup(spark, sf):
    pages = fx.table(spark, sf, "pages")
    return pages.select("page_id", tx.strip_markup("html").alias("text"), tx.compact_lines("html").alias("lines"))


_BARE = "regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '>', ' ', 'g'), '<[^>]*$', '')"
STRIP_MARKUP_SQL = f"""
SELECT page_id,
  {q.squeeze(f"replace(replace(replace(replace(replace({_BARE}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39))")} AS text,
  coalesce(array_to_string(list_filter(list_transform(string_split(replace(html, chr(13) || chr(10), chr(10)), chr(10)), lambda x: {q.strip('x')}), lambda x: x <> ''), chr(10)), '') AS lines
FROM pages"""


def snippets(spark, sf):
    notes = fx.notes(spark, sf)
    ask = F.concat(F.lit("Revision of doc "), F.col("doc_id").cast("string"), F.lit(" deadline"))
    snip = tx.match_snippet("content", F.lit("deadline: 2024"))
    return notes.select(
        "doc_id",
        tx.excerpt("content").alias("excerpt"),
        tx.best_snippet("content", ask).alias("best"),
        snip.alias("snippet"),
        tx.snippet_preview("content", F.array(F.lit("links"))).alias("preview"),
        F.array_join(tx.snippet_probes(snip), "|").alias("probes"),
    )


_CUT = lambda width, dots: f"regexp_replace(left(c, {width}), '{q.WS}+$', '') || '{dots}'"
SNIPPETS_SQL = f"""
WITH {fx.NOTES_SQL},
a AS (SELECT doc_id, {q.squeeze('content')} AS c, replace(content, chr(10), ' ') AS flat,
  list_filter(list_transform(string_split(content, chr(10)), lambda x: {q.squeeze('x')}), lambda x: x <> '') AS ls,
  list_filter(regexp_extract_all('revision of doc ' || doc_id || ' deadline', '[a-z0-9]{{2,}}'), lambda t, i: t <> 'of') AS terms FROM notes),
b AS (SELECT *, strpos(lower(flat), 'deadline: 2024') - 1 AS hit, strpos(lower(c), 'links') - 1 AS link,
  list_transform(ls, lambda l: list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(l), t) THEN CASE WHEN length(t) >= 5 THEN 2 ELSE 1 END ELSE 0 END))) AS scores FROM a),
d AS (SELECT *, ls[list_position(scores, list_max(scores))] AS line FROM b),
e AS (SELECT *, list_min(list_filter(list_transform(terms, lambda t: strpos(lower(line), t)), lambda p: p > 0)) - 1 AS spot,
  trim(substring(flat, greatest(0, hit - 70) + 1, hit + 140 - greatest(0, hit - 70))) AS snip FROM d),
f AS (SELECT *, {q.squeeze('snip')} AS cs, list_filter(regexp_extract_all({q.squeeze('snip')}, '[A-Za-z0-9]{{3,}}'), lambda t: lower(t) NOT IN ({q.quoted(tx.PROBE_STOP_WORDS)})) AS raw FROM e),
g AS (SELECT *, list_sort(list_transform(list_filter(raw, lambda t, i: list_position(raw, t) = i), lambda t, i: {{'n': -length(t), 'i': i, 't': t}})) AS longest FROM f)
SELECT doc_id, CASE WHEN length(c) <= 220 THEN c ELSE {_CUT(219, '…')} END AS excerpt,
  CASE WHEN length(line) <= 220 THEN line WHEN spot IS NULL THEN regexp_replace(left(line, 219), '{q.WS}+$', '') || '…'
    ELSE CASE WHEN spot > 70 THEN '…' ELSE '' END || substring(line, greatest(0, spot - 70) + 1, 220)
      || CASE WHEN greatest(0, spot - 70) + 220 < length(line) THEN '…' ELSE '' END END AS best,
  snip AS snippet,
  CASE WHEN length(c) <= 220 THEN c ELSE CASE WHEN link > 70 THEN '...' ELSE '' END || trim(substring(c, greatest(0, link - 70) + 1, 220))
    || CASE WHEN greatest(0, link - 70) + 220 < length(c) THEN '...' ELSE '' END END AS preview,
  array_to_string(list_transform(longest[1:2], lambda r: r.t), '|') || '|' || array_to_string(string_split(cs, ' ')[1:6], ' ') AS probes
FROM g"""

ITEMS = {
    "path_scope": Item(path_scope, _scope_sql()),
    "path_parts": Item(path_parts, PATH_PARTS_SQL),
    "content_hashes": Item(content_hashes, CONTENT_HASH_SQL),
    "sanitized_text": Item(sanitized, SANITIZED_SQL),
    "extraction_quality": Item(extraction_quality, EXTRACTION_QUALITY_SQL),
    "top_keywords": Item(top_keywords, TOP_KEYWORDS_SQL),
    "entities": Item(entities, ENTITIES_SQL),
    "sentences": Item(sentences, SENTENCES_SQL),
    "timeline_dates": Item(timeline_dates, TIMELINE_SQL),
    "query_terms": Item(query_terms, QUERY_TERMS_SQL),
    "strip_markup": Item(strip_markup, STRIP_MARKUP_SQL),
    "snippets": Item(snippets, SNIPPETS_SQL),
}
