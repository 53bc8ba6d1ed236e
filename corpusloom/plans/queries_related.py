"""Registered queries: related documents."""

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import related as rl
from corpusloom.operators import vectors as vx
from corpusloom.plans import fixtures as fx
from corpusloom.plans import sqlparts as q
from corpusloom.plans import queries_text as qt
from corpusloom.plans.catalog import Item
from corpusloom.session import cut_lineage


def _inputs(spark, sf):
    features = cut_lineage(rl.doc_features(fx.notes(spark, sf)))  # every use below reads them, none the texts
    vectors = vx.latest_embeddings(fx.note_vectors(spark, sf)).select("path", "embedding")
    return features, vectors


def doc_features(spark, sf):
    f = rl.doc_features(fx.notes(spark, sf))
    return f.select("path", "title", "folder", "top", "second", *[F.array_join(c, "|").alias(c) for c in ("title_tokens", "keywords", "entities")])


_ENT = f"list_transform({' || '.join(f'regexp_extract_all(content, {chr(39)}{chr(92)}b{p}{chr(92)}b{chr(39)})' for p in tx.ENTITY_PATTERNS)}, lambda e: lower(trim(e)))"
FEATURES_CTE = f"""
kws AS ({qt.keywords_sql('notes', 'path', 'content')}),
ent1 AS (SELECT path, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM (SELECT path, {_ENT} AS es FROM notes)),
ent2 AS (SELECT path, e, min(i) AS i FROM ent1 WHERE length(e) >= 2 GROUP BY ALL),
ents AS (SELECT path, list(e ORDER BY i) AS entities FROM ent2 GROUP BY path),
feats AS (SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '(?i)\\.md$', '') AS title,
  list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '(?i)\\.md$', '')), '[a-z0-9]{{3,}}'),
    lambda t: t NOT IN ({q.quoted(tx.RELATED_STOP_WORDS)}))) AS title_tokens,
  coalesce(keywords, []) AS keywords, coalesce(entities, []) AS entities,
  regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, string_split(path, '/')[1] AS top, coalesce(string_split(path, '/')[2], '') AS second
  FROM notes LEFT JOIN kws USING (path) LEFT JOIN ents USING (path))"""

FEATURES_SQL = f"""
WITH {fx.NOTES_SQL}, {FEATURES_CTE}
SELECT path, title, folder, top, second,
  array_to_string(list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}'), lambda t: t NOT IN ({q.quoted(tx.RELATED_STOP_WORDS)})), '|') AS title_tokens,
  coalesce(array_to_string(keywords, '|'), '') AS keywords, coalesce(array_to_string(entities, '|'), '') AS entities FROM feats"""


def related_candidates(spark, sf):
    return rl.related_candidates(*_inputs(spark, sf))


def related_edges(spark, sf):
    features, vectors = _inputs(spark, sf)
    edges = rl.with_reasons(rl.related_edges(features, vectors), features)
    said = rl.explain_edge(*[F.col(c) for c in ("tags", "reason", "semantic", "entity", "keyword", "title")])
    return edges.select(
        "source", "target", "rank", *[F.round(c, 6).alias(c) for c in ("score", "semantic", "keyword", "title", "entity")],
        "confidence", F.array_join("tags", "|").alias("tags"), "reason", said.alias("explanation"),
    )


def _jac(c: str) -> str:
    both = f"len(list_intersect(x.{c}, y.{c}))"
    return f"CASE WHEN len(x.{c}) = 0 OR len(y.{c}) = 0 THEN 0::DOUBLE ELSE {both}::DOUBLE / (len(x.{c}) + len(y.{c}) - {both}) END"


# All pairs of notes, whatever they share.
EDGES_CTE = f"""
vecs AS (SELECT path, embedding AS e, sqrt(list_dot_product(embedding, embedding)) AS norm FROM note_embeddings WHERE path IN (SELECT path FROM notes)),
nv AS (SELECT f.*, e, norm FROM feats f LEFT JOIN vecs USING (path)),
sig AS (SELECT x.path AS a, y.path AS b, greatest(0::DOUBLE, least(1::DOUBLE, round(coalesce(list_dot_product(x.e, y.e) / (x.norm * y.norm), 0), 9))) AS semantic,
  {_jac('keywords')} AS keyword, {_jac('title_tokens')} AS title, {_jac('entities')} AS entity,
  x.folder <> '' AND x.folder = y.folder AS sf, x.top = y.top AS st, x.top = y.top AND x.second <> '' AND x.second = y.second AS ss
  FROM nv x JOIN nv y ON x.path < y.path),
tot AS (SELECT *, least(1::DOUBLE, 0.56::DOUBLE * semantic + 0.16::DOUBLE * keyword + 0.08::DOUBLE * title + 0.2::DOUBLE * entity
  + CASE WHEN sf THEN 0.09::DOUBLE WHEN ss THEN 0.05::DOUBLE WHEN st THEN 0.02::DOUBLE ELSE 0 END) AS t FROM sig),
sco AS (SELECT *, round(CASE WHEN NOT (semantic >= 0.48 OR entity >= 0.22 OR keyword >= 0.24 OR title >= 0.38 OR (sf AND (semantic >= 0.2 OR entity >= 0.14 OR keyword >= 0.18))) THEN 0
  WHEN semantic < 0.12 AND keyword < 0.12 AND title < 0.18 AND entity < 0.12 THEN 0
  WHEN st AND NOT sf AND semantic < 0.22 AND entity < 0.18 AND keyword < 0.2 THEN least(t, 0.26::DOUBLE) ELSE t END, 9) AS score FROM tot),
two AS (SELECT a AS source, b AS target, * EXCLUDE (a, b) FROM sco UNION ALL SELECT b, a, * EXCLUDE (a, b) FROM sco),
edges AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM two WHERE score >= 0.30 QUALIFY rank <= 5)"""

CANDIDATES_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {FEATURES_CTE}, {EDGES_CTE} SELECT source, target FROM two WHERE score >= 0.30"""

EDGES_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {FEATURES_CTE}, {EDGES_CTE},
sh AS (SELECT e.*, list_filter(x.keywords, lambda t: list_contains(y.keywords, t))[1:3] AS sk, list_filter(x.entities, lambda t: list_contains(y.entities, t))[1:3] AS se
  FROM edges e JOIN feats x ON x.path = source JOIN feats y ON y.path = target),
tg AS (SELECT *, list_filter([CASE WHEN semantic >= 0.78 THEN 'same topic' WHEN semantic >= 0.58 THEN 'similar topic' END,
   CASE WHEN len(se) > 0 THEN 'shared person/topic' WHEN entity >= 0.24 THEN 'shared references' END,
   CASE WHEN len(sk) > 0 THEN 'shared keywords' WHEN keyword >= 0.28 THEN 'keyword overlap' END,
   CASE WHEN title >= 0.34 THEN 'related title' END, CASE WHEN sf THEN 'same folder' WHEN ss THEN 'same sub-area' WHEN st THEN 'same area' END], lambda t: t IS NOT NULL)[1:3] AS tags FROM sh),
rs AS (SELECT *, CASE WHEN len(se) > 0 THEN 'Shared people/topics: ' || array_to_string(se, ', ') WHEN len(sk) > 0 THEN 'Shared keywords: ' || array_to_string(sk, ', ')
   WHEN list_contains(tags, 'same folder') THEN 'Same folder context' WHEN list_contains(tags, 'same sub-area') THEN 'Same sub-area' WHEN list_contains(tags, 'same topic') THEN 'Very similar topic'
   WHEN list_contains(tags, 'similar topic') THEN 'Similar topic' WHEN list_contains(tags, 'shared references') THEN 'Shared named references'
   WHEN list_contains(tags, 'keyword overlap') THEN 'Strong keyword overlap' WHEN list_contains(tags, 'related title') THEN 'Related title/topic'
   WHEN list_contains(tags, 'same area') THEN 'Same area' ELSE 'Related context detected' END AS reason FROM tg)
SELECT source, target, rank, round(score, 6) AS score, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(title, 6) AS title, round(entity, 6) AS entity,
  CASE WHEN score >= 0.74 THEN 'high' WHEN score >= 0.54 THEN 'medium' ELSE 'low' END AS confidence, array_to_string(tags, '|') AS tags, reason,
  CASE WHEN list_contains(tags, 'same topic') THEN 'Very similar topic with strong semantic overlap.' WHEN list_contains(tags, 'similar topic') THEN 'Similar topic with meaningful semantic overlap.'
   WHEN len(list_intersect(tags, ['shared person/topic', 'shared keywords'])) > 0 THEN reason
   WHEN len(list_intersect(tags, ['same folder', 'same sub-area', 'same area'])) > 0 THEN 'Related mostly through nearby vault structure and '
     || CASE greatest(semantic, entity, keyword, title) WHEN semantic THEN 'topic overlap' WHEN entity THEN 'shared references' WHEN keyword THEN 'keyword overlap' ELSE 'title overlap' END || '.'
   ELSE reason END AS explanation
FROM rs"""


def update_related(spark, sf):
    """A stored graph of the notes outside the export folders, after those inside were added."""
    features, vectors = _inputs(spark, sf)
    changed = features.filter(F.contains("path", F.lit("/exports/")))
    before = features.join(changed.select("path"), "path", "left_anti")
    edges = cut_lineage(rl.related_edges(before, vectors))
    return rl.update_related(edges, changed, features, vectors).select("source", "target", "rank", F.round("score", 6).alias("score"))


UPDATE_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {FEATURES_CTE}, {EDGES_CTE}
SELECT source, target, rank, round(score, 6) AS score FROM edges"""


def prune_related(spark, sf):
    features, vectors = _inputs(spark, sf)
    edges = cut_lineage(rl.related_edges(features, vectors))
    valid = features.filter(~F.contains("path", F.lit("/exports/")))
    return rl.prune_related(features, edges, valid)[2]


PRUNE_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {FEATURES_CTE}, {EDGES_CTE}
SELECT (SELECT count(*) FROM feats WHERE contains(path, '/exports/')) AS removed_records,
  (SELECT count(*) FROM edges WHERE contains(source, '/exports/') OR contains(target, '/exports/')) AS removed_edges"""

ITEMS = {
    "doc_features": Item(doc_features, FEATURES_SQL),
    "related_candidates": Item(related_candidates, CANDIDATES_SQL),
    "related_edges": Item(related_edges, EDGES_SQL),
    "update_related": Item(update_related, UPDATE_SQL),
    "prune_related": Item(prune_related, PRUNE_SQL),
}
