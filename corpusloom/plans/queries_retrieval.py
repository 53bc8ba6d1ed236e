"""Registered queries: keyword and hybrid retrieval, grounding, facts."""

from pyspark.sql import functions as F

from corpusloom.functions import intents as it
from corpusloom.operators import facts as fa
from corpusloom.operators import retrieval as rt
from corpusloom.operators import vectors as vx
from corpusloom.plans import fixtures as fx
from corpusloom.plans import sqlparts as q
from corpusloom.plans.catalog import Item
from corpusloom.session import cut_lineage


def keyword_topk(spark, sf):
    queries, notes = fx.search_queries(spark, sf), fx.notes(spark, sf)
    hits = rt.with_snippets(rt.keyword_topk(queries, notes), queries, notes)
    return hits.select("query_id", "path", "title", "snippet", "score", "rank")


def _keyword_cte(limit: int) -> str:
    """Brute-force scores of all query and note pairs, then the best ``limit``."""
    return f"""
kq AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query, lower({q.strip('text')}) AS phrase FROM benchmark),
kt AS (SELECT query_id, list_filter(regexp_split_to_array(phrase, '{q.WS}+'), lambda t: t <> '') AS toks FROM kq),
kd AS (SELECT path, content, lower(path) AS lp, lower(regexp_extract(path, '[^/]*$')) AS ln, lower(content) AS lc FROM notes),
ks AS (SELECT kq.query_id, kq.query, kq.phrase, kt.toks, kd.path, kd.content,
   CASE WHEN contains(ln, phrase) THEN 120 ELSE 0 END + CASE WHEN contains(lp, phrase) THEN 60 ELSE 0 END
   + CASE WHEN contains(lc, phrase) THEN 40 ELSE 0 END
   + list_sum(list_transform(toks, lambda t: CASE WHEN contains(ln, t) THEN 20 ELSE 0 END
       + CASE WHEN contains(lp, t) THEN 10 ELSE 0 END + CASE WHEN contains(lc, t) THEN 4 ELSE 0 END)) AS score
   FROM kq JOIN kt USING (query_id) CROSS JOIN kd),
kh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM ks WHERE score > 0
       QUALIFY rank <= {limit})"""


_HIT = """
sn AS (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS title, replace(content, chr(10), ' ') AS flat FROM kh),
so AS (SELECT *, CASE WHEN strpos(lower(flat), phrase) > 0 THEN strpos(lower(flat), phrase)
   ELSE list_filter(list_transform(toks, lambda t: strpos(lower(flat), t)), lambda p: p > 0)[1] END - 1 AS spot FROM sn),
hits AS (SELECT *, {strip} AS snippet FROM so)""".replace(
    "{strip}",
    q.strip("CASE WHEN spot IS NULL THEN left(flat, 180) ELSE substring(flat, greatest(0, spot - 70) + 1, spot + 140 - greatest(0, spot - 70)) END"),
)

KEYWORD_SQL = f"""
WITH {fx.NOTES_SQL}, {_keyword_cte(40)}, {_HIT}
SELECT query_id, path, title, snippet, CAST(score AS INTEGER) AS score, rank FROM hits"""


def keyword_rerank(spark, sf):
    queries, notes = fx.search_queries(spark, sf), fx.notes(spark, sf)
    hits = rt.with_snippets(rt.keyword_topk(queries, notes, 20), queries, notes)
    return rt.keyword_rerank(hits).withColumn("tags", F.array_join("tags", "|")).drop("snippet")


def _count(where: str) -> str:
    return f"len(list_filter(toks, lambda t: contains(lower({where}), t)))"


RERANK_SQL = f"""
WITH {fx.NOTES_SQL}, {_keyword_cte(20)}, {_HIT},
c AS (SELECT *, {_count('title')} AS tn, {_count('path')} AS pn, {_count('snippet')} AS sn_, array_to_string(toks, ' ') AS joined,
   list_filter(toks, lambda t: contains(lower(title || ' ' || path || ' ' || snippet), t))[1:3] AS m FROM hits),
d AS (SELECT *, lower(title) = joined AS exact, starts_with(lower(title), joined) AS starts,
   '"' || array_to_string(m, '", "') || '"' AS mq, len(m) > 0 AS has_m FROM c),
e AS (SELECT *, score + 14 * tn + 5 * pn + 3 * sn_ + CASE WHEN exact THEN 40 ELSE 0 END + CASE WHEN starts THEN 16 ELSE 0 END AS ranking,
   CASE WHEN tn > 0 AND sn_ > 0 THEN 'mixed' WHEN tn > 0 THEN 'title' ELSE 'content' END AS match_kind FROM d)
SELECT query_id, path, title, CAST(score AS INTEGER) AS score, CAST(ranking AS INTEGER) AS ranking, match_kind,
  array_to_string(list_filter([CASE WHEN exact THEN 'Exact title' WHEN starts THEN 'Title starts with query' WHEN tn > 0 THEN 'Title match' END,
    CASE WHEN pn > 0 THEN 'Path match' END, CASE WHEN sn_ > 0 THEN 'Content match' END], lambda t: t IS NOT NULL), '|') AS tags,
  CASE WHEN exact THEN 'Exact title match for your query.'
    WHEN starts THEN 'Title starts with your query, which is usually a strong direct lookup signal.'
    WHEN tn > 0 AND sn_ > 0 THEN 'Matched in both the note title and content' || CASE WHEN has_m THEN ' for ' || mq ELSE '' END || '.'
    WHEN tn > 0 OR pn > 0 THEN 'Strong direct match in the note title or folder path' || CASE WHEN has_m THEN ' for ' || mq ELSE '' END || '.'
    ELSE 'Matched the note content' || CASE WHEN has_m THEN ' for ' || mq ELSE '' END || '.' END AS summary,
  row_number() OVER (PARTITION BY query_id ORDER BY ranking DESC,
    CASE match_kind WHEN 'mixed' THEN 0 WHEN 'title' THEN 1 ELSE 2 END, rank) AS new_rank
FROM e"""


def keyword_results(spark, sf):
    found = rt.keyword_results(fx.search_queries(spark, sf), fx.notes(spark, sf), 8)
    return found.select("query_id", "path", F.round("similarity", 6).alias("similarity"), F.array_join("path_terms", " ").alias("path_terms"))


def _terms(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}'), lambda t, i: list_position(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}'), t) = i AND t NOT IN ({q.quoted(__import__('corpusloom.functions.text', fromlist=['x']).RETRIEVAL_STOP_WORDS)}))"


def _keyword_results_cte(limit: int) -> str:
    return f"""
{_keyword_cte(max(4 * limit, 12))},
kr AS (SELECT query_id, path, query, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.24::DOUBLE + 0.58::DOUBLE * score / max(score) OVER (PARTITION BY query_id)
   - least(0.12::DOUBLE, 0.015::DOUBLE * (rank - 1)))), 9) AS similarity FROM kh),
keyword AS (SELECT query_id, path, similarity,
   list_filter({_terms('query')}, lambda t: list_contains(regexp_extract_all(lower(path), '[a-z0-9]{{2,}}'), t))[1:3] AS path_terms FROM kr
   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, path) <= {limit})"""


KEYWORD_RESULTS_SQL = f"""
WITH {fx.NOTES_SQL}, {_keyword_results_cte(8)}
SELECT query_id, path, round(similarity, 6) AS similarity, coalesce(array_to_string(path_terms, ' '), '') AS path_terms FROM keyword"""


def hybrid_search(spark, sf):
    found = rt.hybrid_search(fx.search_queries(spark, sf), fx.notes(spark, sf), fx.note_vectors(spark, sf))
    return _shown(found)


def _shown(found):
    return found.select(
        "query_id", "path", F.round("similarity", 6).alias("similarity"), F.array_join("tags", "|").alias("tags"), "summary", "rank"
    )


def _hybrid_cte(k: int) -> str:
    limit = max(2 * k, 8)
    return f"""
sq AS (SELECT CAST(b.item_id AS VARCHAR) AS query_id, CAST(e.embedding AS DOUBLE[]) AS v FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
semantic AS (SELECT query_id, path, round(list_dot_product(v, embedding) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(embedding, embedding))), 9) AS s
   FROM sq CROSS JOIN note_embeddings WHERE s >= 0
   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path) <= {limit}),
{_keyword_results_cte(limit)},
gate AS (SELECT CAST(item_id AS VARCHAR) AS query_id FROM benchmark LEFT JOIN semantic ON semantic.query_id = CAST(item_id AS VARCHAR)
   GROUP BY item_id HAVING count(s) < {k} OR coalesce(max(s), 0) < 0.36),
gated AS (SELECT * FROM keyword WHERE query_id IN (SELECT query_id FROM gate)),
u AS (SELECT query_id, path, coalesce(s, 0) AS s, coalesce(g.similarity, 0) AS w, coalesce(g.path_terms, []) AS terms
   FROM semantic FULL JOIN gated g USING (query_id, path)),
m AS (SELECT *, round(CASE WHEN s > 0 AND w > 0 THEN least(0.98::DOUBLE, greatest(s, w) + 0.06::DOUBLE) ELSE greatest(s, w) END, 9) AS similarity,
   '"' || array_to_string(terms, '", "') || '"' AS tq FROM u),
merged AS (SELECT query_id, path, similarity, terms,
   CASE WHEN s > 0 OR w > 0 THEN list_filter([CASE WHEN s > 0 THEN 'Semantic match' END, CASE WHEN w > 0 THEN 'Keyword match' END,
     CASE WHEN len(terms) > 0 THEN 'Title/path match' END], lambda t: t IS NOT NULL) END AS tags,
   CASE WHEN s > 0 AND w > 0 AND len(terms) > 0 THEN 'Matched both the meaning of your question and direct path keywords like ' || tq || '.'
     WHEN s > 0 AND w > 0 THEN 'Matched both the meaning of your question and direct keywords from the query.'
     WHEN s >= 0.72 THEN 'Strong semantic match to the meaning of your question.' WHEN s > 0 THEN 'Semantic match to the meaning of your question.'
     WHEN w > 0 AND len(terms) > 0 THEN 'Direct keyword match in the file name or folder path for ' || tq || '.'
     WHEN w > 0 THEN 'Direct keyword overlap with your question.' END AS summary,
   row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, path) AS rank FROM m QUALIFY rank <= {limit})"""


def _intent(x: str) -> str:
    toks = f"regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}')"
    has = lambda hints: f"len(list_filter({toks}, lambda t: t IN ({q.quoted(hints)}))) > 0"
    return f"""CASE WHEN len({toks}) = 0 THEN 'exploratory'
  WHEN {q.words(x, 'open|find|show|locate')} OR regexp_matches({x}, '(?i)\\b(?:where|which)\\b.+\\b(?:note|file|doc|document|path|folder)\\b') THEN 'lookup'
  WHEN regexp_matches({x}, '["''][^"'']+["'']') THEN 'lookup' WHEN {has(it.EXPLORATORY_HINTS)} THEN 'exploratory'
  WHEN {has(it.LOOKUP_HINTS)} AND len({toks}) <= 10 THEN 'lookup'
  WHEN len({toks}) <= 5 AND {q.words(x, 'note|file|doc|document')} THEN 'lookup' ELSE 'exploratory' END"""


HYBRID_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {_hybrid_cte(3)}
SELECT query_id, path, round(similarity, 6) AS similarity, array_to_string(tags, '|') AS tags, summary, rank FROM merged WHERE rank <= 3"""


def _lookup_queries(spark, sf):
    """Every note asked for by name."""
    return fx.notes(spark, sf).select(
        F.col("doc_id").cast("string").alias("query_id"),
        F.concat(F.when(F.col("doc_id") % 2 == 0, "find ").otherwise("explain "), F.regexp_replace("path", "^.*/", "")).alias("query"),
    )


def _neighbours(spark, sf, limit):
    """The vectors nearest to each note's."""
    latest = cut_lineage(vx.latest_embeddings(fx.note_vectors(spark, sf)))
    return vx.knn_candidates(latest, latest, 0.12, limit)


def _lookup_results(spark, sf, neighbours=None):
    """Three results for each of these queries: its vector's two nearest neighbours, and its own note."""
    notes = fx.notes(spark, sf)
    near = (_neighbours(spark, sf, 2) if neighbours is None else neighbours).filter(F.col("rank") <= 2)
    ids = notes.select(F.col("doc_id").cast("string").alias("query_id"), "path")
    found = near.join(ids.withColumnRenamed("path", "source"), "source").select("query_id", F.col("target").alias("path"), "similarity")
    own = ids.select("query_id", "path", F.lit(0.3).alias("similarity"))
    tags = F.array(F.lit("Semantic match"))
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "path")
    return found.unionByName(own).select(
        "query_id", "path", "similarity", F.lit(None).cast("string").alias("content"), tags.alias("tags"), F.lit("s").alias("summary"),
        F.array().cast("array<string>").alias("path_terms"), F.row_number().over(order).alias("rank"),
    )


def intent_rerank(spark, sf):
    found = rt.intent_rerank(_lookup_results(spark, sf), _lookup_queries(spark, sf), 3)
    return _shown(found).withColumn("boosted", F.startswith("summary", F.lit("Boosted"))).drop("summary")


_LOOKUP_CTE = f"""
lq AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, CASE WHEN doc_id % 2 = 0 THEN 'find ' ELSE 'explain ' END || regexp_extract(path, '[^/]*$') AS query, path FROM notes),
un AS (SELECT path, embedding, sqrt(list_dot_product(embedding, embedding)) AS norm FROM note_embeddings),
nn AS (SELECT a.path AS source, b.path AS target, round(list_dot_product(a.embedding, b.embedding) / (a.norm * b.norm), 9) AS s
   FROM un a CROSS JOIN un b WHERE a.path <> b.path AND s >= 0.12
   QUALIFY row_number() OVER (PARTITION BY a.path ORDER BY s DESC, b.path) <= 2),
lr AS (SELECT query_id, target AS path, s AS similarity FROM nn JOIN lq ON lq.path = nn.source
   UNION ALL SELECT query_id, path, 0.3::DOUBLE FROM lq),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, path) AS rank FROM lr)"""

INTENT_RERANK_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {_LOOKUP_CTE},
a AS (SELECT r.*, lq.query, starts_with(query, 'find') AS lookup,
   list_filter(regexp_extract_all(lower(lq.query), '[a-z0-9]{{2,}}'), lambda t: t NOT IN ({q.quoted(it.LOOKUP_HINTS)})) AS toks,
   regexp_replace(lower(regexp_extract(r.path, '[^/]*$')), '\\.[a-z0-9]+$', '') AS title FROM ranked r JOIN lq USING (query_id)),
b AS (SELECT *, len(list_filter(toks, lambda t: contains(title, t))) AS tn, len(list_filter(toks, lambda t: contains(lower(path), t))) AS pn FROM a),
c AS (SELECT *, tn > 0 AND contains(title, array_to_string(toks, ' ')) AS ex FROM b),
d AS (SELECT *, lookup AND (tn > 0 OR pn > 1 OR ex) AS boosted, CASE WHEN lookup THEN round(least(0.99::DOUBLE, similarity + least(0.12::DOUBLE, 0.035::DOUBLE * tn)
   + least(0.08::DOUBLE, 0.02::DOUBLE * pn) + CASE WHEN ex THEN 0.06::DOUBLE ELSE 0 END), 9) ELSE similarity END AS s2 FROM c)
SELECT query_id, path, round(s2, 6) AS similarity, CASE WHEN boosted THEN 'Direct lookup match|Semantic match' ELSE 'Semantic match' END AS tags, boosted,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lookup THEN -s2 END, CASE WHEN lookup THEN path END, rank) AS rank
FROM d"""


def question_intents(spark, sf):
    turns = fx.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("query")
    )
    asked = fx.fact_questions(spark, sf).select(F.concat(F.lit("q"), "query_id").alias("id"), "query")
    looked = _lookup_queries(spark, sf).select(F.concat(F.lit("n"), "query_id").alias("id"), "query")
    greetings = fx.table(spark, sf, "nation").select(
        F.concat(F.lit("g"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, " Hello!! ").otherwise(F.concat(F.lit("Hello "), "n_name")).alias("query")
    )
    everything = turns.unionByName(asked).unionByName(looked).unionByName(greetings)
    return everything.select(
        "id", it.retrieval_intent("query").alias("retrieval"), it.fact_intent("query").alias("fact"),
        it.is_small_talk("query").alias("small_talk"), it.is_synthesis("query").alias("synthesis"), it.asks_when("query").alias("asks_when"),
    )


_FACT_INTENT = f"""CASE WHEN {q.words('query', it.CONTEXTUAL_WORDS)} THEN 'contextual'
  WHEN regexp_matches({q.strip('query')}, '(?i)^(?:when|what|who|where|which|is|are|was|were)\\b') OR {q.words('query', it.DIRECT_SUBJECTS)}
    OR regexp_matches(query, '(?i)\\bmy\\b.+\\b(?:is|are|was|were)\\b') THEN 'direct' ELSE 'contextual' END"""

INTENTS_SQL = f"""
WITH {fx.NOTES_SQL}, {fx.FACT_QUESTIONS_SQL},
s AS (SELECT conv_id || '-' || turn AS id, text AS query FROM conversations
  UNION ALL SELECT 'q' || query_id, query FROM fact_questions
  UNION ALL SELECT 'n' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'find ' ELSE 'explain ' END || regexp_extract(path, '[^/]*$') FROM notes
  UNION ALL SELECT 'g' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN ' Hello!! ' ELSE 'Hello ' || n_name END FROM nation)
SELECT id, {_intent('query')} AS retrieval, {_FACT_INTENT} AS fact,
  (length({q.squeeze('query')}) BETWEEN 1 AND 64 AND regexp_full_match({q.squeeze('query')}, '(?i){"|".join(it.SMALL_TALK).replace(chr(39), chr(39) * 2)}')) AS small_talk,
  {q.words('query', it.SYNTHESIS_WORDS)} AS synthesis, {q.words('query', 'when')} AS asks_when
FROM s"""


def grounding_plan(spark, sf):
    results = rt.intent_rerank(_lookup_results(spark, sf), _lookup_queries(spark, sf), 3)
    return rt.grounding_plan(results, _lookup_queries(spark, sf)).select("query_id", "mode", "max_primary", "include_related", "grounding_summary")


_GROUNDED_CTE = _LOOKUP_CTE + ", final AS (" + INTENT_RERANK_SQL.split("ranked AS", 1)[1].split("FROM lr),", 1)[1].join(["WITH ", ""]) + ")"
GROUNDING_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {_GROUNDED_CTE},
p AS (SELECT query_id, max(similarity) FILTER (WHERE rank = 1) AS a, coalesce(max(similarity) FILTER (WHERE rank = 2), 0) AS b,
   bool_or(boosted AND rank = 1) AS direct FROM final GROUP BY query_id),
g AS (SELECT p.*, starts_with(query, 'find') AS lookup FROM p JOIN lq USING (query_id)),
m AS (SELECT *, CASE WHEN (lookup AND a >= 0.46 AND (direct OR round(a - b, 6) >= 0.08)) OR (a >= 0.78 AND round(a - b, 6) >= 0.12) THEN 1
   WHEN NOT lookup AND false THEN 2 WHEN b >= 0.30 AND round(a - b, 6) < 0.14 THEN 2 ELSE 3 END AS rule FROM g)
SELECT query_id, CASE WHEN rule = 2 THEN 'synthesized' ELSE 'focused' END AS mode, CAST(CASE WHEN rule = 2 THEN 2 ELSE 1 END AS INTEGER) AS max_primary,
  rule = 2 AS include_related, ['Focused on one strong note match to answer a direct lookup-style question.',
   'Synthesized across multiple related notes because the question benefits from broader context.',
   'Focused on the strongest matching note to keep the answer precise.'][rule] AS grounding_summary FROM m"""


def assemble_context(spark, sf):
    notes = fx.notes(spark, sf)
    near = cut_lineage(_neighbours(spark, sf, 5))  # one search: the results are the first two of the related documents
    results = cut_lineage(rt.intent_rerank(_lookup_results(spark, sf, near), _lookup_queries(spark, sf), 3))
    plans = cut_lineage(rt.grounding_plan(results, _lookup_queries(spark, sf)))
    edges = near.withColumnRenamed("similarity", "score")
    made = rt.assemble_context(results, plans, notes, edges)
    trust = rt.trust_level("similarity")
    return made.select(
        "query_id", "source", F.round("similarity", 6).alias("similarity"), F.array_join("source_paths", "|").alias("source_paths"),
        F.md5(F.col("context").cast("binary")).alias("context_md5"), trust["answer_mode"].alias("answer_mode"),
        trust["confidence"].alias("confidence"), trust["provenance"].alias("provenance"),
    )


CONTEXT_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {_GROUNDED_CTE}, plan AS ({GROUNDING_SQL.split(_GROUNDED_CTE + ',', 1)[1].join(['WITH ', ''])}),
pr AS (SELECT f.query_id, f.path, f.similarity, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) AS n, max_primary, include_related
   FROM final f JOIN plan USING (query_id) WHERE similarity >= 0.22 AND path IN (SELECT path FROM notes) QUALIFY n <= max_primary),
n5 AS (SELECT a.path AS source, b.path AS target, round(list_dot_product(a.embedding, b.embedding) / (a.norm * b.norm), 9) AS s,
   row_number() OVER (PARTITION BY a.path ORDER BY s DESC, b.path) AS erank FROM un a CROSS JOIN un b WHERE a.path <> b.path AND s >= 0.12 QUALIFY erank <= 5),
rel AS (SELECT p.query_id, target AS path, s AS similarity, 99 AS n, erank FROM pr p JOIN n5 ON n5.source = p.path
   WHERE p.n = 1 AND include_related AND target IN (SELECT path FROM notes)
     AND NOT EXISTS (SELECT 1 FROM pr z WHERE z.query_id = p.query_id AND z.path = target)
   QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY erank) = 1),
ch AS (SELECT query_id, path, similarity, n FROM pr UNION ALL SELECT query_id, path, similarity, n FROM rel),
nu AS (SELECT ch.*, row_number() OVER (PARTITION BY query_id ORDER BY n) AS i, notes.content FROM ch JOIN notes USING (path)),
ag AS (SELECT query_id, arg_min(path, i) AS source, arg_min(similarity, i) AS similarity, string_agg(path, '|' ORDER BY i) AS source_paths,
   string_agg('[Source ' || i || ': ' || path || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS ctx
   FROM nu GROUP BY query_id)
SELECT query_id, source, round(similarity, 6) AS similarity, source_paths, md5(ctx) AS context_md5,
  CASE WHEN similarity >= 0.62 THEN 'grounded' ELSE 'mixed' END AS answer_mode,
  CASE WHEN similarity >= 0.62 THEN 'high' WHEN similarity >= 0.38 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN similarity >= 0.62 THEN 'Grounded in your notes' WHEN similarity >= 0.38 THEN 'Partially grounded in your notes' ELSE 'Weak note match' END AS provenance
FROM ag"""


def extract_facts(spark, sf):
    return fa.extract_facts(_fact_notes(spark, sf)).select("path", "position", "subject", "value", "statement", "kind", "confidence")


def _fact_notes(spark, sf):
    """Notes with statements of all shapes, by number."""
    n = fx.notes(spark, sf)
    day = F.col("doc_id") % 28 + 1
    more = F.concat(
        F.lit("\nMy launch day is on June "), day.cast("string"), F.lit(", 2027. My role was lead "), (F.col("doc_id") % 7).cast("string"),
        F.lit("! The budget meeting will be on "), F.format_string("%02d/03/2025", day), F.lit(". wedding day xxxx "), (F.col("doc_id") % 5).cast("string"),
        F.lit("\nDeadline: "), F.format_string("2024-%02d-%02d", F.col("doc_id") % 12 + 1, day),
    )
    return n.withColumn("content", F.concat("content", more))


_FACTS_CTE = f"""
fn AS (SELECT path, content || chr(10) || 'My launch day is on June ' || (doc_id % 28 + 1) || ', 2027. My role was lead ' || (doc_id % 7)
   || '! The budget meeting will be on ' || printf('%02d', doc_id % 28 + 1) || '/03/2025. wedding day xxxx ' || (doc_id % 5) || chr(10)
   || 'Deadline: 2024-' || printf('%02d', doc_id % 12 + 1) || '-' || printf('%02d', doc_id % 28 + 1) AS content FROM notes),
fs AS (SELECT path, unnest(ss) AS st, generate_subscripts(ss, 1) - 1 AS line FROM (
   SELECT path, list_filter(list_transform(string_split(regexp_replace(content, '([.?!]){q.WS}+', '\\1' || chr(10), 'g'), chr(10)), lambda x: {q.squeeze('x')}), lambda x: length(x) >= 6) AS ss FROM fn)),
fm AS (
  {" UNION ALL ".join(f"SELECT path, line, st, {i} AS shape, unnest(regexp_extract_all(st, '(?i)\\b{p}', 1)) AS s, unnest(regexp_extract_all(st, '(?i)\\b{p}', 2)) AS v, generate_subscripts(regexp_extract_all(st, '(?i)\\b{p}', 1), 1) AS nth, {a} AS dated, {b} AS other FROM fs" for i, (p, a, b, _) in enumerate(fa.SHAPES))}
  UNION ALL SELECT path, line, st, 2, regexp_extract(st, '(?i){fa.LINE_SHAPE[0]}', 1), regexp_extract(st, '(?i){fa.LINE_SHAPE[0]}', 2), 1, 0.90, 0.74 FROM fs WHERE regexp_matches(st, '(?i){fa.LINE_SHAPE[0]}')),
fb AS (SELECT * FROM fm UNION ALL
  SELECT path, line, st, 3, regexp_extract(st, '(?i){fa.FALLBACK_SHAPE[0]}', 1), regexp_extract(st, '(?i){fa.FALLBACK_SHAPE[0]}', 2), 1, 0.7, 0.7 FROM fs
  WHERE regexp_matches(st, '(?i){fa.FALLBACK_SHAPE[0]}') AND NOT EXISTS (SELECT 1 FROM fm WHERE fm.path = fs.path AND fm.line = fs.line)),
fc AS (SELECT path, line, st, shape, nth, regexp_replace({q.squeeze('s')}, '(?i)^my\\s+', '') AS subject, {q.squeeze('v')} AS value, dated, other FROM fb),
fd AS (SELECT *, (regexp_matches(value, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b') OR regexp_matches(value, '\\b\\d{{1,2}}[/-]\\d{{1,2}}(?:[/-]\\d{{2,4}})?\\b')
   OR {q.words('value', fa.looks_date_like.__globals__['MONTHS'])} OR {q.words('value', fa.looks_date_like.__globals__['WEEKDAYS'])}) AS is_date,
   line * 1000000 + shape * 1000 + nth AS seq FROM fc WHERE length(subject) >= 2 AND length(value) >= 2),
fe AS (SELECT path, lower(subject) AS sk, lower(value) AS vk, min(seq) AS seen,
   arg_min({{'subject': subject, 'value': value, 'statement': st, 'kind': CASE WHEN is_date THEN 'date' ELSE 'attribute' END,
     'confidence': CAST(CASE WHEN is_date THEN dated ELSE other END AS DOUBLE)}}, {{'c': -CASE WHEN is_date THEN dated ELSE other END, 's': seq}}) AS f
   FROM fd GROUP BY ALL),
facts AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY seen) AS position, f.subject AS subject, f.value AS value, f.statement AS statement, f.kind AS kind, f.confidence AS confidence
   FROM fe)"""

FACTS_SQL = f"WITH {fx.NOTES_SQL}, {_FACTS_CTE} SELECT path, position, subject, value, statement, kind, confidence FROM facts"


def answer_from_facts(spark, sf):
    answers = fa.answer_from_facts(fx.fact_questions(spark, sf), fa.extract_facts(_fact_notes(spark, sf)))
    return answers.select("query_id", "answer", "source", "statement", "kind", F.round("score", 6).alias("score"), "similarity", "match_summary")


def _overlap(field: str) -> str:
    return f"CASE WHEN len(toks) = 0 THEN 0 ELSE len(list_filter(toks, lambda t: contains(lower({field}), t)))::DOUBLE / len(toks) END"


_ANSWERS_CTE = f"""
aq AS (SELECT CAST(query_id AS VARCHAR) AS query_id, query, list_filter(regexp_extract_all(lower(query), '[a-z0-9]{{2,}}'), lambda t: t NOT IN ({q.quoted(fa.query_terms.__globals__['FACT_STOP_WORDS'])})) AS toks,
   {q.words('query', 'when')} AS w FROM fact_questions),
ascore AS (SELECT query_id, query, facts.*, round(0.65::DOUBLE * {_overlap('subject')} + 0.25::DOUBLE * {_overlap('statement')} + 0.10::DOUBLE * {_overlap('value')}
   + CASE WHEN w AND kind = 'date' THEN 0.32::DOUBLE ELSE 0 END + 0.1::DOUBLE * confidence, 9) AS score FROM aq CROSS JOIN facts),
abest AS (SELECT * FROM ascore QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, position) = 1),
answers AS (SELECT query_id, CASE WHEN starts_with(lower(query), 'when') OR contains(lower(query), ' when ') THEN subject || ' is ' || value || '.'
   WHEN starts_with(lower(query), 'what') OR contains(lower(query), ' what ') THEN subject || ': ' || value || '.'
   ELSE 'Based on your note, ' || subject || ' is ' || value || '.' END AS answer, path AS source, statement, kind, score,
   least(0.99::DOUBLE, greatest(0.7::DOUBLE, confidence)) AS similarity,
   CASE WHEN kind = 'date' THEN 'Answered directly from a high-confidence extracted date fact.' ELSE 'Answered directly from an extracted note attribute.' END AS match_summary
   FROM abest WHERE score >= 0.24 AND {_FACT_INTENT} = 'direct' AND score >= CASE WHEN kind = 'date' THEN 0.34 ELSE 0.40 END)"""

ANSWERS_SQL = f"""
WITH {fx.NOTES_SQL}, {fx.FACT_QUESTIONS_SQL}, {_FACTS_CTE}, {_ANSWERS_CTE}
SELECT query_id, answer, source, statement, kind, round(score, 6) AS score, similarity, match_summary FROM answers"""


def route_questions(spark, sf):
    """Every benchmark question through facts, hybrid search, grounding and routing."""
    notes, questions = fx.notes(spark, sf), fx.fact_questions(spark, sf)
    vectors = fx.search_queries(spark, sf).select("query_id", "embedding")
    asked = questions.join(vectors, "query_id", "left")
    index = fx.note_vectors(spark, sf)
    latest = cut_lineage(vx.latest_embeddings(index))
    answers = fa.answer_from_facts(questions, fa.extract_facts(_fact_notes(spark, sf)))
    results = cut_lineage(rt.hybrid_search(asked, notes, index, 5))
    plans = cut_lineage(rt.grounding_plan(results, questions))
    # Related documents are asked for by the notes that were found, and by no others.
    sources = latest.join(results.select("path").distinct(), "path", "left_semi")
    edges = vx.knn_candidates(sources, latest, 0.12, 5).withColumnRenamed("similarity", "score")
    contexts = rt.assemble_context(results, plans, notes, edges)
    routed = rt.route_questions(questions, answers, results, contexts, plans)
    return routed.withColumn("similarity", F.round("similarity", 6))


# The questions take the place of the benchmark's texts in the parts that search.
ROUTE_SQL = f"""
WITH {fx.NOTE_EMBEDDINGS_SQL}, {fx.FACT_QUESTIONS_SQL}, {_FACTS_CTE}, {_ANSWERS_CTE},
benchmark AS (SELECT query_id AS item_id, query AS text FROM fact_questions), {_hybrid_cte(5)},
un AS (SELECT path, embedding, sqrt(list_dot_product(embedding, embedding)) AS norm FROM note_embeddings),
lq AS (SELECT CAST(query_id AS VARCHAR) AS query_id, query, {_intent('query')} = 'lookup' AS lookup, {q.words('query', it.SYNTHESIS_WORDS)} AS synthesis,
   (length({q.squeeze('query')}) BETWEEN 1 AND 64 AND regexp_full_match({q.squeeze('query')}, '(?i){"|".join(it.SMALL_TALK).replace(chr(39), chr(39) * 2)}')) AS small,
   list_filter(regexp_extract_all(lower(query), '[a-z0-9]{{2,}}'), lambda t: t NOT IN ({q.quoted(it.LOOKUP_HINTS)})) AS toks FROM fact_questions),
ra AS (SELECT m.*, lookup, toks, regexp_replace(lower(regexp_extract(m.path, '[^/]*$')), '\\.[a-z0-9]+$', '') AS title FROM merged m JOIN lq USING (query_id)),
rb AS (SELECT *, len(list_filter(toks, lambda t: contains(title, t))) AS tn, len(list_filter(toks, lambda t: contains(lower(path), t))) AS pn FROM ra),
rc AS (SELECT *, tn > 0 AND contains(title, array_to_string(toks, ' ')) AS ex FROM rb),
rd AS (SELECT * REPLACE (CASE WHEN lookup THEN round(least(0.99::DOUBLE, similarity + least(0.12::DOUBLE, 0.035::DOUBLE * tn) + least(0.08::DOUBLE, 0.02::DOUBLE * pn)
   + CASE WHEN ex THEN 0.06::DOUBLE ELSE 0 END), 9) ELSE similarity END AS similarity), lookup AND (tn > 0 OR pn > 1 OR ex) AS boosted FROM rc),
final AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lookup THEN -similarity END, CASE WHEN lookup THEN path END, rank) AS rank
   FROM rd QUALIFY rank <= 5),
gp AS (SELECT query_id, max(similarity) FILTER (WHERE rank = 1) AS a, coalesce(max(similarity) FILTER (WHERE rank = 2), 0) AS b, bool_or(boosted AND rank = 1) AS direct
   FROM final GROUP BY query_id),
plan AS (SELECT query_id, CASE WHEN a IS NULL THEN 0 WHEN (lookup AND a >= 0.46 AND (direct OR round(a - b, 9) >= 0.08)) OR (a >= 0.78 AND round(a - b, 9) >= 0.12) THEN 1
   WHEN synthesis OR (b >= 0.30 AND round(a - b, 9) < 0.14) THEN 2 ELSE 3 END AS rule FROM lq LEFT JOIN gp USING (query_id)),
pr AS (SELECT f.query_id, f.path, f.similarity, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) AS n
   FROM final f JOIN plan USING (query_id) WHERE similarity >= 0.22 AND path IN (SELECT path FROM notes) QUALIFY n <= CASE WHEN rule = 2 THEN 2 ELSE 1 END),
best AS (SELECT pr.query_id, pr.path, pr.similarity, content, list_filter(list_transform(string_split(content, chr(10)), lambda x: {q.squeeze('x')}), lambda x: x <> '') AS ls,
   {_terms('lq.query')} AS terms FROM pr JOIN notes USING (path) JOIN lq ON lq.query_id = pr.query_id WHERE n = 1),
sc AS (SELECT *, list_transform(ls, lambda l: coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(l), t) THEN CASE WHEN length(t) >= 5 THEN 2 ELSE 1 END ELSE 0 END)), 0)) AS scores FROM best),
ln AS (SELECT *, ls[list_position(scores, list_max(scores))] AS line FROM sc),
sp AS (SELECT *, list_min(list_filter(list_transform(terms, lambda t: strpos(lower(line), t)), lambda p: p > 0)) - 1 AS spot FROM ln),
note AS (SELECT query_id, path, similarity, CASE WHEN length(line) <= 220 THEN line WHEN spot IS NULL THEN regexp_replace(left(line, 219), '{q.WS}+$', '') || '…'
    ELSE CASE WHEN spot > 70 THEN '…' ELSE '' END || substring(line, greatest(0, spot - 70) + 1, 220) || CASE WHEN greatest(0, spot - 70) + 220 < length(line) THEN '…' ELSE '' END END AS snippet FROM sp),
rt AS (SELECT lq.query_id, CASE WHEN small THEN 'general' WHEN f.source IS NOT NULL THEN 'fact' WHEN n.path IS NOT NULL THEN 'note' ELSE 'general' END AS source_type, rule,
   f.source, f.similarity AS fs, f.answer, f.statement, f.match_summary, n.path, n.similarity AS ns, n.snippet
   FROM lq LEFT JOIN answers f USING (query_id) LEFT JOIN note n USING (query_id) JOIN plan USING (query_id))
SELECT query_id, source_type, CASE source_type WHEN 'fact' THEN source WHEN 'note' THEN path END AS source,
  round(CASE source_type WHEN 'fact' THEN fs WHEN 'note' THEN ns ELSE 0 END, 6) AS similarity, CASE WHEN source_type = 'fact' THEN answer END AS answer,
  CASE source_type WHEN 'fact' THEN statement WHEN 'note' THEN snippet END AS snippet,
  CASE source_type WHEN 'fact' THEN 'grounded' WHEN 'note' THEN CASE WHEN ns >= 0.62 THEN 'grounded' ELSE 'mixed' END ELSE 'general' END AS answer_mode,
  CASE source_type WHEN 'fact' THEN 'high' WHEN 'note' THEN CASE WHEN ns >= 0.62 THEN 'high' WHEN ns >= 0.38 THEN 'medium' ELSE 'low' END END AS confidence,
  CASE source_type WHEN 'fact' THEN 'Grounded in extracted facts' WHEN 'note' THEN CASE WHEN ns >= 0.62 THEN 'Grounded in your notes'
    WHEN ns >= 0.38 THEN 'Partially grounded in your notes' ELSE 'Weak note match' END END AS provenance,
  CASE source_type WHEN 'fact' THEN match_summary WHEN 'note' THEN ['No note evidence was strong enough to build a grounded answer plan.',
    'Focused on one strong note match to answer a direct lookup-style question.',
    'Synthesized across multiple related notes because the question benefits from broader context.',
    'Focused on the strongest matching note to keep the answer precise.'][rule + 1] END AS grounding_summary FROM rt"""

ITEMS = {
    "keyword_topk": Item(keyword_topk, KEYWORD_SQL),
    "keyword_rerank": Item(keyword_rerank, RERANK_SQL),
    "keyword_similarity": Item(keyword_results, KEYWORD_RESULTS_SQL),
    "hybrid_search": Item(hybrid_search, HYBRID_SQL),
    "intent_rerank": Item(intent_rerank, INTENT_RERANK_SQL),
    "question_intents": Item(question_intents, INTENTS_SQL),
    "grounding_plan": Item(grounding_plan, GROUNDING_SQL),
    "assemble_context": Item(assemble_context, CONTEXT_SQL),
    "extract_facts": Item(extract_facts, FACTS_SQL),
    "answer_from_facts": Item(answer_from_facts, ANSWERS_SQL),
    "route_questions": Item(route_questions, ROUTE_SQL),
}
