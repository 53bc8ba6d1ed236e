"""Registered queries: duplicates."""

from pyspark.sql import functions as F

from corpusloom.functions import duplicates as du
from corpusloom.operators import duplicates as dd
from corpusloom.plans import fixtures as fx
from corpusloom.plans import sqlparts as q
from corpusloom.plans.catalog import Item
from corpusloom.session import cut_lineage

_NOISE_RE2 = [
    "(?i)\\bcopy\\b", "(?i)\\bfinal\\b", "(?i)\\bexport\\b", "(?i)\\bscan(?:ned)?\\d*\\b", "(?i)\\bimg[_ -]?\\d+\\b", "\\(\\d+\\)",
    "(?i)[_ -]v\\d+\\b", "[_ -]\\d{4}[-_]\\d{2}[-_]\\d{2}\\b",
]


def versions(spark, sf):
    """Note paths under names with all marks of copies and versions."""
    marks = ["", " copy", " Final", "_export", " scanned12", " img_7", " (3)", "_v2", "_2024-05-06", " draft", "DraftCopy", " final copy"]
    n = fx.notes(spark, sf)
    mark = F.get(F.array(*[F.lit(m) for m in marks]), (F.col("doc_id") % len(marks)).cast("int"))
    return n.select("doc_id", F.concat(F.regexp_replace("path", "( draft| final| copy)?\\.md$", ""), mark, F.lit(".md")).alias("path"))


VERSIONS_SQL = f"""{fx.NOTES_SQL},
versions AS (SELECT doc_id, regexp_replace(path, '( draft| final| copy)?\\.md$', '')
  || ['', ' copy', ' Final', '_export', ' scanned12', ' img_7', ' (3)', '_v2', '_2024-05-06', ' draft', 'DraftCopy', ' final copy'][1 + doc_id % 12] || '.md' AS path FROM notes)"""


def file_versions(spark, sf):
    v = versions(spark, sf)
    key = du.preference_key("path")
    return v.select(
        "doc_id", "path", du.noise_score("path").alias("noise"), du.normalized_stem("path").alias("stem"),
        du.draft_state("path").alias("state"), du.version_quality("path").alias("quality"), (-key["shallow"]).alias("depth"),
    )


def _stem_sql(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[._-]+', ' ', 'g')"
    for p in [*_NOISE_RE2, "(?i)\\bdraft\\b"]:
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({out}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 2), ' ')"


def _traits(table: str, modified: str) -> str:
    """CTE body: the preference criteria of each path."""
    name = "regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^/.]+$', '')"
    return f"""SELECT *, {" + ".join(f"len(regexp_extract_all(nm, '{p}'))" for p in _NOISE_RE2)} AS noise,
  {_stem_sql('nm')} AS stem, CASE WHEN {q.words('nm', 'draft')} THEN 'draft' WHEN {q.words('nm', 'final')} THEN 'final' ELSE 'plain' END AS state,
  CASE WHEN {q.words('nm', 'draft')} AND NOT {q.words('nm', 'final')} THEN -2
    WHEN {q.words('nm', 'final')} AND NOT {q.words('nm', 'draft')} AND NOT {q.words('nm', 'copy')} THEN 1 ELSE 0 END AS quality,
  least(len({q.parts('path')}) - 1, 4) AS depth, {modified} AS modified, lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) AS folder
FROM (SELECT *, {name} AS nm FROM {table})"""


FILE_VERSIONS_SQL = f"""
WITH {VERSIONS_SQL}, t AS ({_traits('versions', '0')})
SELECT doc_id, path, CAST(noise AS INTEGER) AS noise, coalesce(stem, '') AS stem, state, quality, CAST(depth AS INTEGER) AS depth FROM t"""

_ORDER = "CASE WHEN {a}.state = 'draft' THEN 1 ELSE 0 END, {a}.noise, -{a}.depth, -{a}.quality, -{a}.modified, length({a}.path), {a}.path"


def _key(a: str) -> str:
    names = ["d", "n", "h", "q", "m", "l", "p"]
    return "{" + ", ".join(f"'{n}': {e.strip()}" for n, e in zip(names, _split(_ORDER.format(a=a)))) + "}"


def _split(text: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def _why(k: str, o: str) -> str:
    return f"""CASE WHEN ({k}.state = 'draft') <> ({o}.state = 'draft') THEN CASE WHEN {k}.state = 'final' THEN 'final version ' ELSE 'non-draft file ' END
  WHEN {k}.noise <> {o}.noise THEN 'cleaner canonical file ' WHEN {k}.depth <> {o}.depth THEN 'better organized file '
  WHEN {k}.quality <> {o}.quality THEN CASE WHEN {k}.quality = 1 THEN 'final version ' ELSE '' END
  WHEN {k}.modified <> {o}.modified THEN 'newer copy ' ELSE '' END"""


_NORM = f"lower({q.squeeze(chr(123) + chr(125))})"


def _normalized(x: str) -> str:
    cleaned = f"regexp_replace(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '(?m)^\\s*[-*_]{{3,}}\\s*$', '', 'g')"
    return f"lower({q.squeeze(cleaned)})"


def _profile_sql(table: str, modified: str) -> str:
    return f"""traits AS ({_traits(table, modified)}),
prof AS (SELECT *, {_normalized('content')} AS norm FROM traits WHERE length({_normalized('content')}) >= 20),
keyed AS (SELECT prof.*, {_key('prof')} AS key FROM prof),
exact AS (SELECT x.path, 'exact-delete' AS kind, y.path AS target, 'Exact duplicate of ' || {_why('y', 'x')} || y.path AS reason
  FROM keyed x JOIN (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY norm ORDER BY key) = 1) y ON x.norm = y.norm AND x.path <> y.path)"""


def document_files(spark, sf):
    """The documents as they are, as files of their source folders."""
    d = fx.table(spark, sf, "documents")
    return d.select(
        F.concat(F.concat_ws("/", "source", "lang", F.lit("doc ")), F.format_string("%05d", "doc_id"), F.when(F.col("doc_id") % 7 == 3, " final").otherwise(""), F.lit(".md")).alias("path"),
        F.col("text").alias("content"),
    )


def exact_duplicates(spark, sf):
    return dd.exact_duplicates(dd.duplicate_profile(document_files(spark, sf)))


EXACT_SQL = f"""
WITH files AS (SELECT source || '/' || lang || '/doc ' || printf('%05d', doc_id) || CASE WHEN doc_id % 7 = 3 THEN ' final' ELSE '' END || '.md' AS path, text AS content FROM documents),
{_profile_sql('files', '0')}
SELECT path, kind, target, reason FROM exact"""


def near_duplicates(spark, sf):
    """All near pairs among the notes and the similarity that decided them."""
    profile = dd.duplicate_profile(fx.notes(spark, sf))
    pairs = dd.near_pairs(cut_lineage(dd.near_candidates(profile)))
    return pairs.select(
        F.col("x.path").alias("path"), F.col("y.path").alias("better"), F.col("x.stem").alias("stem"),
        F.round(du.jaccard("x.words", "y.words"), 6).alias("similarity"), F.round(dd.length_ratio("x", "y"), 6).alias("length_ratio"),
    )


_WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace({x}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 2))"
_PAIRS = f"""
ws AS (SELECT *, {_WORDS.replace('{x}', 'norm')} AS w FROM {{keyed}}),
pr AS (SELECT x AS x, y AS y, len(list_intersect(x.w, y.w)) AS both_, least(length(x.norm), length(y.norm))::DOUBLE / greatest(length(x.norm), length(y.norm)) AS ratio
  FROM ws x JOIN ws y ON x.stem = y.stem AND x.stem <> '' AND y.key < x.key AND x.norm <> y.norm),
ps AS (SELECT *, CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0 ELSE both_::DOUBLE / (len(x.w) + len(y.w) - both_) END AS sim,
  x.folder = y.folder AS same, x.noise > 0 OR y.noise > 0 AS noisy FROM pr),
near AS (SELECT * FROM ps WHERE (same OR noisy) AND ratio >= 0.72 AND round(sim, 9) >= CASE WHEN same AND noisy THEN 0.55 ELSE 0.74 END)"""

NEAR_SQL = f"""
WITH {fx.NOTES_SQL}, {_profile_sql('notes', 'modified_s')}, {_PAIRS.replace('{keyed}', 'keyed')}
SELECT x.path AS path, y.path AS better, x.stem AS stem, round(sim, 6) AS similarity, round(ratio, 6) AS length_ratio FROM near"""


def detect_duplicates(spark, sf):
    return dd.detect_duplicates(fx.notes(spark, sf))


DETECT_CTE = f"""{_profile_sql('notes', 'modified_s')},
left_over AS (SELECT * FROM keyed WHERE path NOT IN (SELECT path FROM exact)), {_PAIRS.replace('{keyed}', 'left_over')},
kept AS (SELECT * FROM near WHERE y.path NOT IN (SELECT x.path FROM near) QUALIFY row_number() OVER (PARTITION BY x.path ORDER BY y.key) = 1),
rules AS (SELECT *, {_why('y', 'x')} AS why, (sim >= 0.78 AND (both_::DOUBLE / len(x.w) >= 0.88 OR contains(y.norm, x.norm))) AS strong FROM kept),
duplicates AS (SELECT path, kind, target, reason FROM exact
UNION ALL SELECT x.path, CASE WHEN strong AND why <> '' THEN 'superseded-delete' ELSE 'merge-recommended' END, y.path,
  CASE WHEN strong AND why <> '' THEN 'Superseded by ' ELSE 'Probable duplicate revision of ' END || why || y.path FROM rules)"""

# No note has a chain of better versions, so the first round of the resolution is the whole of it.
DETECT_SQL = f"WITH {fx.NOTES_SQL}, {DETECT_CTE} SELECT * FROM duplicates"

ITEMS = {
    "file_versions": Item(file_versions, FILE_VERSIONS_SQL),
    "exact_duplicates": Item(exact_duplicates, EXACT_SQL),
    "near_duplicates": Item(near_duplicates, NEAR_SQL),
    "detect_duplicates": Item(detect_duplicates, DETECT_SQL),
}
