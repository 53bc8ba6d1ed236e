"""Registered queries: classification and reorganization."""

from pyspark.sql import functions as F

from corpusloom.functions import naming as nm
from corpusloom.functions import responses as rs
from corpusloom.functions import review as rv
from corpusloom.operators import planning as pl
from corpusloom.plans import fixtures as fx
from corpusloom.plans import sqlparts as q
from corpusloom.plans.catalog import Item
from corpusloom.session import cut_lineage



def _as_of():
    return F.make_date(F.lit(2024), F.lit(1), F.lit(31))


def naming_kinds(spark, sf):
    d = nm.doc_profile(fx.named_files(spark, sf), _as_of())
    return d.select(
        "path", "kind", "folder.category", "folder.subcategory", "file_role", nm.visual_kind("path").alias("visual"),
        F.col("quality.quality").alias("quality"), "conservative",
    )


_H = lambda words: q.words("ctx", words)
_L = lambda words: q.words("low", words)


def _folder_sql() -> str:
    out = []
    for kind, rules in nm.FOLDER_RULES.items():
        for words, category, sub in rules:
            cond = f"kind = '{kind}'" if kind != "general" else "true"
            out.append(f"WHEN {cond}{' AND ' + _H(words) if words else ''} THEN '{category}/{sub}'")
    return "CASE " + " ".join(out) + " END"


NAMING_SQL = f"""
WITH {fx.NAMED_FILES_SQL},
c AS (SELECT path, content, named_files.kind AS file_kind, {q.strip('content')} AS txt, lower({q.strip('content')}) AS low,
  regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) AS ext,
  lower({q.strip('content')}) || ' ' || lower({q.squeeze("regexp_replace(regexp_replace(path, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[._/-]+', ' ', 'g')")}) AS ctx FROM named_files),
k AS (SELECT *, CASE
  WHEN regexp_matches(txt, '(?i)\\*\\*interviewer:\\*\\*|\\*\\*you:\\*\\*|(^|\\n)\\s*(interviewer|candidate|you):') THEN 'interview'
  WHEN regexp_matches(txt, '(?i)^(rewrite|build|create|give|help|make|generate|improve|shorten)\\b') THEN 'prompt'
  WHEN regexp_matches(txt, '(?i)\\bresume\\b.*\\bexperience\\b|\\bexperience\\b.*\\bresume\\b') THEN 'resume'
  WHEN regexp_matches(txt, '(?i)\\bquality\\b.*\\btesting\\b|\\btesting\\b.*\\bquality\\b') THEN 'strategy'
  WHEN regexp_matches(txt, '(?i)\\bprompt engineering\\b|\\bprompt generation\\b|\\bgithub\\b.*\\bactivity\\b|\\btool\\b.*\\bintegration\\b') THEN 'general'
  WHEN {_H('offer letter|offer packet|offer')} THEN 'document' WHEN regexp_matches(ctx, '(?i)({nm.CONTRACT})') THEN 'contract'
  WHEN ext IN ({q.quoted(nm.VISUAL_EXTENSIONS)}) OR {_H(nm.IMAGE)} THEN 'image' WHEN ext IN ('ppt', 'pptx') OR {_H(nm.SLIDES)} THEN 'presentation'
  WHEN ext IN ('xls', 'xlsx', 'csv') OR {_H(nm.SHEET)} THEN 'spreadsheet' WHEN ext IN ('pdf', 'doc', 'docx') OR {_H(nm.DOCUMENT)} THEN 'document'
  WHEN {_L('meeting|agenda|minutes|standup|sync|follow-up')} THEN 'meeting' WHEN {_H('resume|cv|cover letter|job description')} THEN 'resume'
  WHEN regexp_matches(txt, '(?m)^[-*•]\\s') OR len(regexp_extract_all(txt, '(?m)^\\d+[.)]\\s')) > 2 THEN 'checklist'
  WHEN {_L(nm.CODE)} OR contains(txt, '```') THEN 'code' WHEN length(txt) - length(replace(txt, '?', '')) > 1 THEN 'qa'
  WHEN {_L('strategy|approach|plan|roadmap|architecture|quality')} THEN 'strategy' ELSE 'general' END AS kind FROM c),
f AS (SELECT *, {_folder_sql()} AS folder FROM k),
t AS (SELECT *, length(regexp_replace(txt, '{q.WS}+', '', 'g')) AS n, regexp_extract_all(low, '[a-z]{{2,}}') AS w,
  length(regexp_replace(txt, '[^A-Za-z]+', '', 'g')) AS a, length(regexp_replace(txt, '[^0-9]+', '', 'g')) AS d FROM f),
g AS (SELECT *, CASE WHEN length(txt) < 60 OR len(w) < 12 THEN 'low' WHEN a::DOUBLE / n < 0.38 OR (d::DOUBLE / n > 0.34 AND a::DOUBLE / n < 0.52) OR (n - a - d)::DOUBLE / n > 0.28 THEN 'low'
  WHEN len(list_distinct(w))::DOUBLE / len(w) < 0.28 THEN 'medium' WHEN length(txt) < 240 OR len(w) < 45 THEN 'medium' ELSE 'high' END AS quality FROM t),
v AS (SELECT *, regexp_replace(lower(path), '[_-]+', ' ', 'g') AS sp FROM g)
SELECT path, kind, split_part(folder, '/', 1) AS category, split_part(folder, '/', 2) AS subcategory, quality, file_kind <> 'text' AND quality <> 'high' AS conservative,
  CASE WHEN file_kind = 'image' THEN 'image' WHEN kind = 'contract' AND {_H('offer letter|offer packet|offer')} THEN 'offer'
    WHEN kind IN ('contract', 'document') AND {_H('statement|bank statement')} THEN 'statement' WHEN kind = 'contract' THEN 'contract'
    WHEN kind IN ('resume', 'interview', 'prompt', 'presentation', 'spreadsheet', 'image') THEN kind
    WHEN kind = 'document' AND {_H('profile|personal profile')} THEN 'profile' WHEN kind = 'document' AND {_H('proposal')} THEN 'proposal'
    WHEN kind = 'document' AND {_H('guide|manual|reference|playbook|tutorial|onboarding')} THEN 'guide'
    WHEN kind <> 'document' AND file_kind = 'text' THEN 'text-note' ELSE 'general-document' END AS file_role,
  CASE WHEN {q.words('sp', 'screenshot|screen ?shot|capture')} THEN 'screenshot' WHEN {q.words('sp', 'diagram|architecture|flowchart|wireframe|mockup')} THEN 'diagram'
    WHEN {q.words('sp', 'scan|scanned|statement|invoice|receipt|passport|id|license')} THEN 'scan' WHEN {q.words('sp', 'photo|img ?[0-9]+|dsc ?[0-9]+|camera|picture')} THEN 'photo' ELSE 'image' END AS visual
FROM v"""


def naming_plans(spark, sf):
    """Titles and summaries; checked by unit cases rather than SQL."""
    d = nm.naming_plan(fx.named_files(spark, sf).drop("kind"), _as_of())
    return d.select("path", "kind", "summary", "plan_title", F.array_join("plan_keywords", " ").alias("keywords"))


def ranked_keywords(spark, sf):
    return fx.named_files(spark, sf).select("path", F.array_join(nm.rank_keywords("content", "path"), " ").alias("keywords"))


RANKED_SQL = f"""
WITH {fx.NAMED_FILES_SQL},
w AS (SELECT path, list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),
   lambda x: (length(x) > 3 OR x IN ({q.quoted(nm.ACRONYMS)})) AND x NOT IN ({q.quoted(nm.STOP_WORDS)})) AS ws FROM named_files),
e AS (SELECT path, unnest(ws) AS t, CASE WHEN generate_subscripts(ws, 1) <= 40 THEN 2 ELSE 1 END AS n FROM w
  UNION ALL SELECT path, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(path, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[/\\s._-]+'), lambda x: lower(x)),
   lambda x: length(x) > 2 AND x NOT IN ({q.quoted(nm.GENERIC_PATH_WORDS)}))), 4 FROM named_files),
s AS (SELECT path, t, sum(n) AS n FROM e WHERE t NOT IN ({q.quoted(nm.FILLER_WORDS)}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, t) AS rk FROM s)
SELECT path, coalesce(string_agg(t, ' ' ORDER BY rk) FILTER (WHERE rk <= 4), '') AS keywords FROM named_files LEFT JOIN r USING (path) GROUP BY path"""


def title_checks(spark, sf):
    """Titles made of file names and of the documents' own openings."""
    n = fx.named_files(spark, sf)
    title = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("_", F.lit("scan"), F.col("doc_id").cast("string"))).when(
        F.col("doc_id") % 3 == 1, F.array_join(F.slice(F.split("content", "\\s+"), 3, 1 + (F.col("doc_id") % 8).cast("int")), " ")
    ).otherwise(F.regexp_replace("path", "^.*/|\\.[^.]*$", ""))
    t = n.withColumn("title", title)
    return t.select(
        "doc_id", nm.clean_title("title").alias("clean"), nm.is_messy_title("title").alias("messy"), nm.needs_title_cleanup("title").alias("cleanup"),
        nm.is_forbidden_title("title").alias("forbidden"), F.array_join(nm.title_failures("title", "content"), "|").alias("failures"),
    )


_TW = "list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


def _messy(x: str) -> str:
    w = _TW.replace("{x}", x)
    return (
        f"(len({w}) < 2 OR len({w}) > 6 OR len(list_filter({w}, lambda v: v IN ({q.quoted(nm.FILLER_WORDS)}))) >= ceil(len({w}) / 2.0) "
        f"OR {w}[1] IN ('yeah', 'today', 'just', 'easy', 'interviewer'))"
    )


def _clean(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(regexp_replace({x}, '[/\\\\:*?\"<>|]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    cased = f"list_transform({words}, lambda w: CASE WHEN lower(w) IN ({q.quoted(nm.ACRONYMS)}) THEN upper(w) WHEN regexp_full_match(w, '[A-Z]{{2,4}}') THEN w ELSE replace(upper(left(w, 1)), 'ẞ', 'SS') || lower(substring(w, 2)) END)"
    return f"trim(left(coalesce(array_to_string({cased}, ' '), ''), 60))"


TITLE_SQL = f"""
WITH {fx.NAMED_FILES_SQL},
t AS (SELECT doc_id, content, CASE doc_id % 3 WHEN 0 THEN 'scan_' || doc_id WHEN 1 THEN array_to_string(regexp_split_to_array(content, '\\s+')[3:3 + doc_id % 8], ' ')
  ELSE regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') END AS title FROM named_files),
c AS (SELECT *, {_clean('title')} AS clean, trim(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g')) AS tl FROM t),
d AS (SELECT *, {_TW.replace('{x}', 'clean')} AS w, regexp_split_to_array(tl, '\\s+') AS tw, array_to_string(regexp_split_to_array(lower(left({q.strip('content')}, 150)), '\\s+')[1:10], ' ') AS opening,
  regexp_replace(lower(left({q.strip('content')}, length(title))), '[^a-z0-9]', '', 'g') AS pre, regexp_replace(tl, '[^a-z0-9]', '', 'g') AS bare FROM c)
SELECT doc_id, clean, {_messy('title')} AS messy,
  (clean = '' OR regexp_full_match({q.strip('title')}, '[a-z0-9]+(?:_[a-z0-9]+)+') OR lower(clean) IN ({q.quoted(nm.WEAK_TITLES)}) OR {_messy('clean')}
   OR regexp_matches(lower(clean), '^(img|image|scan|screenshot|file|document)[\\s_-]*\\d+') OR ({q.words('clean', 'copy|draft')} AND len(w) <= 3)
   OR regexp_full_match(clean, '\\d+') OR len(list_filter(w, lambda x: x NOT IN ({q.quoted(nm.GENERIC_TITLE_WORDS)}))) < 2) AS cleanup,
  (lower({q.strip('title')}) IN ({q.quoted(nm.FORBIDDEN_TITLES)}) OR contains(lower(title), 'untitled')) AS forbidden,
  coalesce(array_to_string(list_filter([CASE WHEN len(tw) >= 3 AND starts_with(opening, array_to_string(tw[1:5], ' ')) THEN 'verbatim copy from content start' END,
    CASE WHEN pre = bare AND length(bare) > 10 THEN 'exact substring of content' END,
    CASE WHEN regexp_matches(tl, '^(?:here is|this is|i am|my latest|the following|note about)') THEN 'forbidden starting phrase' END,
    CASE WHEN regexp_matches(title, '[-.]{{2,}}$|\\s+$|^[^A-Z0-9]') THEN 'malformed or truncated' END,
    CASE WHEN len(list_filter(regexp_split_to_array(title, '\\s+'), lambda x: length(x) > 3)) < 2 THEN 'too vague or generic' END], lambda x: x IS NOT NULL), '|'), '') AS failures
FROM d"""


def model_responses(spark, sf):
    """Model responses about the notes, in all the loose shapes they come in."""
    n = fx.notes(spark, sf)
    name = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), "\\.md$", "")
    body = lambda text: F.format_string(text, name, F.col("doc_id") % 9)
    strict = body('{"suggestedPath": "Work/Area %1$s", "suggestedTitle": "Area Report %2$d", "reason": "Looks like a longer report on one area", "shouldKeep": "yes"}')
    shapes = [
        strict, F.concat(F.lit("Sure:\n```json\n"), strict, F.lit("\n```")),
        body("{'path': 'Learning/%1$s', 'title': 'Learning Guide %2$d', 'why': 'better fit', 'keep': 'no',}"),
        body('// note\n{targetPath: "Career/Prep/%1$s", newTitle: "Career Prep Plan %2$d", rationale: "Fits the career preparation folder well"};'),
        body('{"suggestedPath": "misc/%1$s", "title": "Note %2$d", "reason": "misc", "isDuplicate": true, "duplicateOf": "notes/Other %2$d"}'),
        F.lit("I cannot say."), F.concat(F.lit('"'), F.replace(strict, F.lit('"'), F.lit('\\"')), F.lit('"')),
    ]
    return n.select("doc_id", "path", F.get(F.array(*shapes), (F.col("doc_id") % len(shapes)).cast("int")).alias("raw"))


def parsed_suggestions(spark, sf):
    r = model_responses(spark, sf)
    s = rs.parse_suggestion("raw", "path", F.lit("general"), F.lit("Planned Title"), F.lit("Fallback/Path"))
    parsed = r.select("doc_id", "path", rs.recover_json("raw").isNotNull().alias("readable"), s.alias("s"))
    checked = rs.assess_suggestion("path", F.col("s"), F.lit("document"), F.lit("Work"), F.lit("Area"), F.col("doc_id") % 2 == 0)
    out = parsed.withColumn("a", F.when(F.col("s").isNotNull(), checked))
    return out.select(
        "doc_id", "readable", "s.should_keep", "s.suggested_path", "s.suggested_title", "s.is_duplicate", "s.duplicate_of", "s.reason",
        "a.confidence", F.array_join("a.flags", "|").alias("flags"), rs.marked_reason(F.col("s.reason"), F.col("a.confidence")).alias("marked"),
    )


_NM = "regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '')"
SUGGESTIONS_SQL = f"""
WITH {fx.NOTES_SQL},
b AS (SELECT doc_id, path, {_NM} AS nm, doc_id % 9 AS k, doc_id % 7 AS shape, string_split(path, '/') AS ps FROM notes),
p AS (SELECT *, shape <> 5 AS readable, CASE WHEN shape IN (0, 1, 6) THEN 'Work/Area ' || nm WHEN shape = 2 THEN 'Learning/' || nm WHEN shape = 3 THEN 'Career/Prep/' || nm WHEN shape = 4 THEN 'misc/' || nm END AS sp,
  CASE WHEN shape IN (0, 1, 6) THEN 'Area Report ' || k WHEN shape = 2 THEN 'Learning Guide ' || k WHEN shape = 3 THEN 'Career Prep Plan ' || k WHEN shape = 4 THEN 'Planned Title' END AS st,
  CASE WHEN shape IN (0, 1, 6) THEN 'Looks like a longer report on one area' WHEN shape = 2 THEN 'better fit' WHEN shape = 3 THEN 'Fits the career preparation folder well' WHEN shape = 4 THEN 'misc' END AS reason FROM b),
c AS (SELECT *, lower(string_split(sp, '/')[1]) AS top, lower(CASE WHEN len(ps) >= 1 THEN ps[1] END) AS here, lower(regexp_extract(sp, '^(.*)/[^/]*$', 1)) AS folder,
  {_TW.replace('{x}', "regexp_extract(sp, '[^/]*$')")} AS leaf, {_TW.replace('{x}', 'st')} AS tw FROM p),
d AS (SELECT *, top IN ({q.quoted(rs.GENERIC_TOPS)}) AS f1, {_messy('st')} AS f2, len(list_filter(tw, lambda w: list_contains(leaf, w))) < greatest(1, len(tw) // 2) AS f3,
  (length(reason) < 18 OR len(regexp_split_to_array(reason, '\\s+')) <= 3) AS f4, top <> 'work' AS f5, folder <> '' AND NOT starts_with(folder, 'work/area') AS f6,
  doc_id % 2 = 0 AND here <> top AS f7, shape = 4 AS dup FROM c),
e AS (SELECT *, f1::INT * 3 + f2::INT * 3 + f3::INT * 2 + f4::INT * 2 + f5::INT * 2 + f6::INT + f7::INT * 2 + (dup AND f4)::INT AS pts FROM d)
SELECT doc_id, readable, CASE WHEN readable THEN shape <> 2 END AS should_keep, sp AS suggested_path, st AS suggested_title, CASE WHEN readable THEN dup END AS is_duplicate,
  CASE WHEN dup THEN 'Other ' || k || '.md' END AS duplicate_of, reason, CASE WHEN readable THEN CASE WHEN pts >= 5 THEN 'low' WHEN pts >= 2 THEN 'medium' ELSE 'high' END END AS confidence,
  CASE WHEN readable THEN coalesce(array_to_string(list_filter([CASE WHEN f1 THEN 'generic folder target' END, CASE WHEN f2 THEN 'messy generated title' END, CASE WHEN f3 THEN 'title/path mismatch' END,
    CASE WHEN f4 THEN 'generic rationale' END, CASE WHEN f5 THEN 'folder conflicts with naming plan' END, CASE WHEN f6 THEN 'subcategory conflicts with naming plan' END,
    CASE WHEN f7 THEN 'aggressive move despite weak extraction' END, CASE WHEN dup AND f4 THEN 'weak duplicate rationale' END], lambda x: x IS NOT NULL), '|'), '') END AS flags,
  reason || CASE WHEN pts BETWEEN 2 AND 4 THEN ' (low-confidence refinement)' ELSE '' END AS marked
FROM e"""


def taxonomy(spark, sf):
    return pl.taxonomy(fx.notes(spark, sf)).select("kind", "key", "n")


TAXONOMY_CTE = f"""
tax AS (SELECT 'top' AS kind, lower({q.parts('path')}[1]) AS key, count(*) AS n FROM notes WHERE {q.structured('path')} GROUP BY ALL
  UNION ALL SELECT 'sub', lower(regexp_extract(path, '^(.*)/[^/]*$', 1)), count(*) FROM notes WHERE {q.structured('path')} AND len({q.parts('path')}) >= 3 GROUP BY ALL)"""
TAXONOMY_SQL = f"WITH {fx.NOTES_SQL}, {TAXONOMY_CTE} SELECT * FROM tax"


def folder_counts(spark, sf):
    return pl.folder_counts(fx.notes(spark, sf))


FOLDERS_SQL = f"""
WITH {fx.NOTES_SQL},
l AS (SELECT array_to_string(p[1:n], '/') AS folder, n = len(p) - 1 AS direct FROM (SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT string_split(path, '/') AS p FROM notes))),
f AS (SELECT folder, count(*) FILTER (WHERE direct) AS files, count(*) AS files_below FROM l GROUP BY folder)
SELECT f.folder, files, (SELECT count(*) FROM f c WHERE regexp_extract(c.folder, '^(.*)/[^/]*$', 1) = f.folder) AS folders, files_below FROM f"""


def tree_stats(spark, sf):
    return pl.tree_stats(fx.notes(spark, sf))


TREE_SQL = f"""
WITH {fx.NOTES_SQL}
SELECT (SELECT count(*) FROM notes) AS files, (SELECT count(DISTINCT array_to_string(p[1:n], '/')) FROM (SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT string_split(path, '/') AS p FROM notes))) AS folders"""


def structural_issues(spark, sf):
    """Notes with repeated folders and extensions, and folders with nothing in them."""
    n = fx.notes(spark, sf)
    odd = n.select(
        "doc_id",
        F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("work/sub/work/"), "path")).when(F.col("doc_id") % 13 == 0, F.concat("path", F.lit(".MD.md"))).otherwise(F.col("path")).alias("path"),
    )
    folders = pl.folder_counts(odd).select("folder").unionByName(
        n.filter(F.col("doc_id") % 29 == 0).select(F.concat(F.lit("archive/empty "), F.col("doc_id").cast("string")).alias("folder"))
    ).unionByName(n.select(F.lit("archive").alias("folder")).distinct())
    return pl.structural_issues(odd, folders)


STRUCTURAL_SQL = f"""
WITH {fx.NOTES_SQL},
o AS (SELECT CASE WHEN doc_id % 17 = 0 THEN 'work/sub/work/' || path WHEN doc_id % 13 = 0 THEN path || '.MD.md' ELSE path END AS path FROM notes),
f AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS folder FROM (SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT string_split(path, '/') AS p FROM o))),
e AS (SELECT 'archive/empty ' || doc_id AS folder FROM notes WHERE doc_id % 29 = 0)
SELECT 'structural' AS type, 'recommended' AS level, folder AS source_path, 'Nested/repeated folder name: ''' || regexp_extract(folder, '[^/]*$') || ''' appears multiple times in path' AS reason, 'nestedFolders' AS issue_type
FROM f WHERE len(list_filter(string_split(folder, '/'), lambda x: x = regexp_extract(folder, '[^/]*$'))) > 1
UNION ALL SELECT 'delete', 'strong', folder, 'Delete empty folder: ''' || folder || '''', 'emptyFolder' FROM e
UNION ALL SELECT 'structural', 'recommended', path, 'File has repeated .md extensions', 'repeatedExtension' FROM o WHERE regexp_matches(path, '(?i)\\.md(\\.md)+$')"""


def clutter_folders(spark, sf):
    return pl.clutter_folders(fx.notes(spark, sf))


CLUTTER_SQL = f"""
WITH {fx.NOTES_SQL},
f AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '[^/]*$') AS name FROM notes),
c AS (SELECT folder FROM f WHERE folder LIKE '%/exports' GROUP BY folder HAVING count(*) = count(*) FILTER (WHERE {q.words('name', 'final')}))
SELECT path, folder, regexp_extract(folder, '^(.*)/[^/]*$', 1) || '/' || name AS target,
  'Flatten shallow clutter folder ''' || folder || ''' into ''' || regexp_extract(folder, '^(.*)/[^/]*$', 1) || ''' (flatten noisy copy/export container)' AS reason
FROM f JOIN c USING (folder)"""


def operations(spark, sf):
    """One operation for each note, covering all kinds, reasons and levels."""
    n = fx.notes(spark, sf)
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("doc_id") / by) % len(values)).cast("int"))
    kind = pick(TYPES, 1)
    name = F.regexp_replace("path", "^.*/", "")
    target = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Work/Research/"), name)).when(
        F.col("doc_id") % 3 == 1, F.concat(F.regexp_extract("path", "^(.*/)?", 0), F.lit("Renamed "), name)
    ).otherwise(F.concat(F.lit("Review/"), name))
    return n.select(
        F.col("doc_id").alias("op_id"), kind.alias("type"), pick(LEVELS, 2).alias("level"), F.col("path").alias("source_path"),
        F.when(kind != "delete", target).alias("target_path"), pick(REASONS, 1).alias("reason"),
        F.when(kind == "delete", pick(["emptyFolder", ""], 4)).when(kind == "structural", "repeatedExtension").alias("issue_type"),
        F.struct(
            pick(["text", "pdf", "image", "xlsx"], 3).alias("file_kind"), pick(["high", "medium", "low"], 5).alias("quality"), F.lit("Why").alias("quality_reason"),
            F.lit("text-note").alias("file_role"), (F.col("doc_id") % 2 == 0).alias("conservative"), (F.col("doc_id") % 4 < 2).alias("validated"),
            pick(["move", "duplicate", "review"], 1).alias("validation"),
        ).alias("review"),
        pick(["scan", "screenshot", "photo", "image"], 2).alias("visual"), pick(["ocr", "path"], 3).alias("mode"), (F.col("doc_id") % 3 > 0).alias("approved"),
    )


TYPES = ["move", "merge", "delete", "structural", "move"]
LEVELS = ["strong", "recommended", "optional"]
REASONS = [
    "Tidy (root or uncategorized note • matches existing vault category structure)", "Same (low-confidence refinement)",
    "Exact duplicate of cleaner canonical file a.md", "Superseded by final version b.md", "Move (target folder approved 2 times • target folder is a better fit than the current location)",
    "Broken file", "Flatten shallow clutter folder 'x' into 'y' (flatten noisy copy/export container)", "See notes/Work/Other file.md, then Work/a b.txt.",
]


def _pick_sql(values, by: int) -> str:
    return f"list_extract([{q.quoted(values)}], 1 + CAST((doc_id // {by}) % {len(values)} AS INTEGER))"


OPERATIONS_CTE = f"""{fx.NOTES_SQL},
ops AS (SELECT *, CASE WHEN type <> 'delete' THEN CASE doc_id % 3 WHEN 0 THEN 'Work/Research/' || nm WHEN 1 THEN regexp_extract(source_path, '^(.*/)?') || 'Renamed ' || nm ELSE 'Review/' || nm END END AS target_path,
  CASE WHEN type = 'delete' THEN {_pick_sql(['emptyFolder', ''], 4)} WHEN type = 'structural' THEN 'repeatedExtension' END AS issue_type FROM (
  SELECT doc_id, doc_id AS op_id, {_pick_sql(TYPES, 1)} AS type, {_pick_sql(LEVELS, 2)} AS level, path AS source_path, regexp_extract(path, '[^/]*$') AS nm, {_pick_sql(REASONS, 1)} AS reason,
  {_pick_sql(['text', 'pdf', 'image', 'xlsx'], 3)} AS file_kind, {_pick_sql(['high', 'medium', 'low'], 5)} AS quality, doc_id % 2 = 0 AS conservative, doc_id % 4 < 2 AS validated,
  {_pick_sql(['move', 'duplicate', 'review'], 1)} AS validation, {_pick_sql(['scan', 'screenshot', 'photo', 'image'], 2)} AS visual, {_pick_sql(['ocr', 'path'], 3)} AS mode, doc_id % 3 > 0 AS approved FROM notes))"""


def review_table(spark, sf):
    o = operations(spark, sf)
    grouped = pl.review_groups(o)
    c = rv.confidence_summary("type", "level", "target_path", "reason", "review.quality", "review.validated")
    r = F.col("review")
    tags = rv.review_tags("reason", r["file_kind"], r["quality"], r["validated"], r["validation"], F.col("visual"), F.col("mode"), r["conservative"])
    return grouped.select(
        "op_id", "group", "group_label", "group_order", c["label"].alias("confidence"), c["rank"].alias("confidence_rank"),
        F.array_join(tags, "|").alias("tags"), F.size(rv.folder_evidence("reason")).alias("evidence"),
        F.size(rv.narrative("type", "target_path", "reason")).alias("bullets"), rv.change_kind("source_path", "target_path").alias("change_kind"),
        rv.cluster_label("type", "target_path", "issue_type").alias("cluster"), rv.change_summary("source_path", "target_path")["target_folder"].alias("to_folder"),
        F.array_join(rs.mentioned_paths("source_path", "target_path", "reason"), "|").alias("mentioned"),
        rv.review_hint(r["file_kind"], r["quality"], r["quality_reason"], F.col("visual"), F.col("mode")).isNotNull().alias("hinted"),
    )


def _says(p: str) -> str:
    return f"regexp_matches(lower(reason), '{p}')"


_FOLD = lambda x: f"regexp_extract({x}, '^(.*)/[^/]*$', 1)"
REVIEW_SQL = f"""
WITH {OPERATIONS_CTE},
g AS (SELECT *, {_FOLD('source_path')} AS sf, {_FOLD('target_path')} AS tf, lower(regexp_extract(target_path, '[^/]*$')) AS tn,
  CASE WHEN type = 'move' AND lower({_FOLD('source_path')}) = lower({_FOLD('target_path')}) THEN 1 WHEN type = 'move' THEN 2 WHEN type = 'merge' THEN 3
   WHEN type = 'delete' AND issue_type = 'emptyFolder' THEN 4 WHEN type = 'delete' THEN 5 ELSE 6 END AS gi FROM ops),
c AS (SELECT *, CASE WHEN type = 'merge' AND validated THEN 1 WHEN type = 'move' AND starts_with(target_path, 'Review/') THEN 0
   WHEN contains(reason, 'low-confidence refinement') OR quality = 'low' OR level = 'optional' THEN 3 WHEN quality = 'medium' OR level = 'recommended' THEN 2 ELSE 1 END AS cr FROM g),
t AS (SELECT *, list_filter([CASE WHEN {_says(rv.UNCATEGORIZED)} THEN 'Uncategorized Fix' END, CASE WHEN {_says('matches existing vault category structure')} THEN 'Vault Pattern' END,
   CASE WHEN {_says(rv.LEARNED)} THEN 'Learned From Approvals' END, CASE WHEN {_says('low-confidence refinement')} THEN 'Low Confidence' END,
   CASE WHEN validated THEN CASE validation WHEN 'duplicate' THEN 'Validated Duplicate' WHEN 'review' THEN 'Validated Review' ELSE 'Validated Move' END END,
   CASE WHEN {_says('cleaner canonical file')} THEN 'Cleaner Canonical File' WHEN {_says('final version')} THEN 'Final Version' END,
   CASE WHEN {_says('flatten noisy copy/export container')} THEN 'Clutter Cleanup' END,
   CASE WHEN file_kind IN ('pdf', 'xlsx') THEN CASE quality WHEN 'low' THEN 'Weak Extraction' WHEN 'medium' THEN 'Limited Extraction' END END,
   CASE WHEN file_kind = 'image' THEN 'Visual Asset' END, CASE WHEN file_kind = 'image' THEN CASE visual WHEN 'scan' THEN 'Scanned Doc' WHEN 'screenshot' THEN 'Screenshot' WHEN 'photo' THEN 'Photo' END END,
   CASE WHEN file_kind = 'image' AND mode = 'ocr' THEN CASE WHEN quality = 'low' THEN 'Weak OCR' ELSE 'OCR Read' END END,
   CASE WHEN file_kind = 'image' AND mode = 'path' AND conservative THEN 'Path-Based' END], lambda x: x IS NOT NULL)[1:4] AS tg FROM c)
SELECT op_id, ['rename', 'move', 'merge', 'empty-folder', 'delete', 'structural'][gi] AS group, [{q.quoted(rv.GROUPS.values())}][gi] AS group_label, gi AS group_order,
  ['Manual review', 'High confidence', 'Moderate confidence', 'Lower confidence'][cr + 1] AS confidence, cr AS confidence_rank, coalesce(array_to_string(tg, '|'), '') AS tags,
  CAST(greatest(1, ({_says(rv.UNCATEGORIZED)})::INT + ({_says('matches existing vault category structure')})::INT + ({_says(rv.LEARNED)})::INT + ({_says('better fit than')})::INT) AS INTEGER) AS evidence,
  CASE WHEN type = 'merge' THEN greatest(1, ({_says('cleaner canonical file')})::INT + ({_says('final version')})::INT + ({_says('superseded by')})::INT)
    WHEN type = 'move' AND starts_with(target_path, 'Review/') THEN 1 END AS bullets,
  CASE WHEN target_path IS NULL THEN NULL WHEN lower(sf) <> lower(tf) AND tn <> lower(nm) THEN 'move-rename' WHEN lower(sf) <> lower(tf) THEN 'move' WHEN tn <> lower(nm) THEN 'rename' END AS change_kind,
  CASE WHEN type IN ('move', 'merge') THEN coalesce(nullif(tf, ''), 'Vault Root') WHEN type = 'delete' THEN CASE WHEN issue_type = 'emptyFolder' THEN 'Empty Folder Cleanup' ELSE 'Delete Cleanup' END
    ELSE coalesce(nullif(tf, ''), 'Structural Fixes') END AS cluster,
  CASE WHEN target_path IS NOT NULL THEN coalesce(nullif(tf, ''), 'Vault root') END AS to_folder,
  source_path || coalesce('|' || target_path, '') || CASE WHEN starts_with(reason, 'See notes/') THEN '|See notes/Work/Other file.md|then Work/a b.txt' ELSE '' END AS mentioned,
  (file_kind = 'image' OR (file_kind IN ('pdf', 'xlsx') AND quality <> 'high')) AS hinted
FROM t"""


def destination_clusters(spark, sf):
    return pl.destination_clusters(operations(spark, sf).filter("approved"))


CLUSTERS_SQL = f"""
WITH {OPERATIONS_CTE}
SELECT CASE WHEN type IN ('move', 'merge') THEN coalesce(nullif({_FOLD('target_path')}, ''), 'Vault Root') WHEN type = 'delete' THEN CASE WHEN issue_type = 'emptyFolder' THEN 'Empty Folder Cleanup' ELSE 'Delete Cleanup' END
    ELSE coalesce(nullif({_FOLD('target_path')}, ''), 'Structural Fixes') END AS label, count(*) AS n
FROM ops WHERE approved GROUP BY label ORDER BY n DESC, lower(label), label LIMIT 6"""


def confidence_counts(spark, sf):
    return pl.confidence_counts(operations(spark, sf))


CONFIDENCE_SQL = f"""
WITH {OPERATIONS_CTE},
c AS (SELECT CASE WHEN type = 'merge' AND validated THEN 1 WHEN type = 'move' AND starts_with(target_path, 'Review/') THEN 0
   WHEN contains(reason, 'low-confidence refinement') OR quality = 'low' OR level = 'optional' THEN 3 WHEN quality = 'medium' OR level = 'recommended' THEN 2 ELSE 1 END AS cr FROM ops)
SELECT count(*) FILTER (WHERE cr = 1) AS high, count(*) FILTER (WHERE cr = 2) AS moderate, count(*) FILTER (WHERE cr = 3) AS lower, count(*) FILTER (WHERE cr = 0) AS manual FROM c"""


def learn_preferences(spark, sf):
    return pl.learn_preferences(operations(spark, sf))


PREFS_CTE = f"""
mv AS (SELECT lower({q.parts('source_path')}[1]) || '=>' || lower({q.parts('target_path')}[1]) AS mk, lower({_FOLD('target_path')}) AS up, approved,
  list_filter(string_split(regexp_replace(regexp_replace(lower(nm), '\\.[^.]+$', ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 4) AS toks FROM ops WHERE type = 'move'),
pf AS (SELECT CASE WHEN approved THEN 'accepted_top' ELSE 'denied_top' END AS kind, mk AS key, '' AS inner_key FROM mv
  UNION ALL SELECT CASE WHEN approved THEN 'accepted_parent' ELSE 'denied_parent' END, up, '' FROM mv WHERE up <> ''
  UNION ALL SELECT 'token_parent', unnest(toks), up FROM mv WHERE approved AND up <> ''),
prefs AS (SELECT kind, key, inner_key, count(*) AS n FROM pf GROUP BY ALL)"""
PREFS_SQL = f"WITH {OPERATIONS_CTE}, {PREFS_CTE} SELECT * FROM prefs"


def _moves(spark, sf):
    """Every note against a move within or across its source folder, and what is known of folders and decisions."""
    o = operations(spark, sf)
    dictionary = cut_lineage(pl.taxonomy(fx.notes(spark, sf)).unionByName(pl.learn_preferences(o)))
    target = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("src1/en/"), F.regexp_replace("path", "^.*/", ""))).otherwise(F.concat(F.lit("Work/Research/"), F.regexp_replace("path", "^.*/", "")))
    moves = fx.notes(spark, sf).select("path", F.col("path").alias("current"), target.alias("target"), F.lit("Clear reason to move").alias("reason"), "doc_id")
    return moves, dictionary


def folder_fit(spark, sf):
    """Fit of and decision on every move."""
    fitted = pl.folder_fit(*_moves(spark, sf))
    move = pl.should_move(pl.pt.is_structured("current"), F.lit(False), F.col("doc_id") % 5 == 0)
    return fitted.select("path", "current_fit", "target_fit", move.alias("move"))


_CNT = lambda kind, key, inner="''": f"coalesce((SELECT max(n) FROM dict d WHERE d.kind = '{kind}' AND d.key = {key} AND d.inner_key = {inner}), 0)"
FIT_CTE = f"""{OPERATIONS_CTE}, {PREFS_CTE}, {TAXONOMY_CTE},
dict AS (SELECT * FROM prefs UNION ALL SELECT kind, key, '', n FROM tax),
m AS (SELECT doc_id, path, CASE WHEN doc_id % 2 = 0 THEN 'src1/en/' ELSE 'Work/Research/' END || regexp_extract(path, '[^/]*$') AS target FROM notes),
k AS (SELECT *, lower({q.parts('path')}[1]) AS ht, lower({q.parts('target')}[1]) AS tt, lower({_FOLD('path')}) AS hp, lower({_FOLD('target')}) AS tp,
  list_filter(string_split(regexp_replace(regexp_replace(lower(regexp_extract(path, '[^/]*$')), '\\.[^.]+$', ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 4) AS toks FROM m),
tk AS (SELECT path, unnest(toks) AS t, hp, tp FROM k),
ts AS (SELECT path, coalesce(sum(n) FILTER (WHERE inner_key = hp), 0) AS hs, coalesce(sum(n) FILTER (WHERE inner_key = tp), 0) AS tsu FROM tk JOIN dict ON kind = 'token_parent' AND key = t GROUP BY path),
s AS (SELECT k.*, coalesce(hs, 0) AS hs, coalesce(tsu, 0) AS tsu, {_CNT('top', 'ht')} > 0 AS kht, {_CNT('top', 'tt')} > 0 AS ktt, {_CNT('sub', 'hp')} > 0 AS khs, {_CNT('sub', 'tp')} > 0 AS kts,
  {_CNT('accepted_parent', 'hp')} AS ho, {_CNT('accepted_parent', 'tp')} AS to_, {_CNT('denied_parent', 'tp')} AS tno, {_CNT('accepted_top', "ht || '=>' || tt")} AS mo, {_CNT('denied_top', "ht || '=>' || tt")} AS mn,
  {q.structured('path')} AS st, {q.uncategorized('path')} AS unc, {q.level('path', 'target')} AS lv FROM k LEFT JOIN ts USING (path)),
f AS (SELECT *, CASE WHEN kht THEN 2 ELSE 0 END + CASE WHEN khs THEN 3 ELSE 0 END + least(3, CASE WHEN hp <> '' THEN ho ELSE 0 END) + least(3, hs) AS cf,
  CASE WHEN ktt THEN 2 ELSE -2 END + CASE WHEN kts THEN 3 WHEN ktt THEN -1 ELSE 0 END + CASE WHEN ht = tt THEN 1 ELSE 0 END + least(3, mo) - least(3, mn) + least(4, to_) - least(4, tno) + least(4, tsu) AS tf FROM s)"""

FIT_SQL = f"""
WITH {FIT_CTE}
SELECT path, cf AS current_fit, tf AS target_fit, CASE WHEN unc THEN true WHEN target = path THEN false WHEN (mn >= 2 AND mn > mo) OR (tno >= 2 AND tno > to_) THEN false
  WHEN st AND ht <> tt AND NOT ktt THEN false WHEN hp = tp THEN doc_id % 5 = 0 WHEN st AND (lv = 'optional' OR ht <> tt) THEN tf - cf >= 3 WHEN st THEN tf - cf >= 2 ELSE tf - cf > 0 END AS move
FROM f"""


def learned_targets(spark, sf):
    """Where learnt folders and the taxonomy direct every move."""
    moves, dictionary = _moves(spark, sf)
    return pl.align_to_taxonomy(pl.apply_learned_parent(moves, dictionary), dictionary).select("path", "target")


LEARNED_SQL = f"""
WITH {FIT_CTE},
lp AS (SELECT path, inner_key AS learned, sum(n) AS score FROM tk JOIN dict ON kind = 'token_parent' AND key = t GROUP BY ALL),
bp AS (SELECT path, learned FROM lp QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, learned) = 1 AND score >= 2),
tops AS (SELECT DISTINCT key FROM dict WHERE kind = 'top'),
t1 AS (SELECT k.path, ht, CASE WHEN learned IS NOT NULL AND (NOT EXISTS (SELECT 1 FROM tops) OR string_split(learned, '/')[1] IN (SELECT key FROM tops))
  THEN learned || '/' || regexp_extract(target, '[^/]*$') ELSE target END AS t, {q.structured('k.path')} AS st FROM k LEFT JOIN bp ON bp.path = k.path)
SELECT path, CASE WHEN lower(string_split(t, '/')[1]) NOT IN (SELECT key FROM tops) AND ht IN (SELECT key FROM tops) AND st THEN path ELSE t END AS target FROM t1"""


def explained_moves(spark, sf):
    moves, dictionary = _moves(spark, sf)
    return pl.explain_move(cut_lineage(pl.folder_fit(moves, dictionary)), dictionary).select("path", "reason")


EXPLAINED_SQL = f"""
WITH {FIT_CTE},
pa AS (SELECT path, string_agg(t || ' (' || n || ')', ', ' ORDER BY n DESC, i) AS patterns FROM (
  SELECT path, t, i, n FROM (SELECT path, unnest(toks) AS t, generate_subscripts(toks, 1) AS i, tp FROM k) JOIN dict ON kind = 'token_parent' AND key = t AND inner_key = tp
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, i) <= 2) GROUP BY path),
b AS (SELECT f.path, lv, list_filter([CASE WHEN unc THEN 'root or uncategorized note' END, CASE WHEN ktt THEN 'matches existing vault category structure' END,
  CASE WHEN ht <> tt AND mo > 0 THEN 'similar top-level move approved ' || mo || CASE WHEN mo = 1 THEN ' time' ELSE ' times' END END,
  CASE WHEN to_ > 0 THEN 'target folder approved ' || to_ || CASE WHEN to_ = 1 THEN ' time' ELSE ' times' END END,
  CASE WHEN patterns IS NOT NULL THEN 'similar approved note patterns: ' || patterns END,
  CASE WHEN tf - cf >= 3 THEN 'target folder is a much stronger fit than the current location' WHEN tf - cf >= 2 THEN 'target folder is a better fit than the current location' END],
  lambda x: x IS NOT NULL) AS bits FROM f LEFT JOIN pa ON pa.path = f.path)
SELECT path, CASE WHEN len(bits) > 0 THEN 'Clear reason to move (' || array_to_string(bits, ' • ') || ')' WHEN lv = 'optional' THEN 'Clear reason to move (low-confidence refinement)'
  ELSE 'Clear reason to move' END AS reason FROM b"""


def move_outcomes(spark, sf):
    o = operations(spark, sf).filter(F.col("target_path").isNotNull())
    d = F.col("op_id")
    out = pl.move_outcome("source_path", F.when(d % 7 == 0, F.col("source_path")).otherwise(F.col("target_path")), "reason", d % 11 == 0, d % 5 == 0, d % 3 == 0, F.when(d % 6 == 0, F.lit("x.md")))
    return o.select("op_id", out["suppress"].alias("suppress"), out["is_duplicate"].alias("is_duplicate"), out["rename_only"].alias("rename_only"),
                    pl.surfaces_review("source_path", "reason", d % 11 == 0, d % 5 == 0).alias("review"))


OUTCOME_SQL = f"""
WITH {OPERATIONS_CTE},
o AS (SELECT op_id, source_path AS c, CASE WHEN op_id % 7 = 0 THEN source_path ELSE target_path END AS t, reason, op_id % 11 = 0 AS failed, op_id % 5 = 0 AS messy, op_id % 3 = 0 AS dup,
  op_id % 6 = 0 AS has_of, contains(lower(reason), 'low-confidence refinement') AS low FROM ops WHERE target_path IS NOT NULL),
r AS (SELECT *, lower({_FOLD('c')}) = lower({_FOLD('t')}) AND lower(regexp_extract(c, '[^/]*$')) <> lower(regexp_extract(t, '[^/]*$')) AS ren, {q.uncategorized('c')} AS unc, {q.level('c', 't')} AS lv,
  {q.words('reason', pl.REVIEW_WORDS)} AS strong FROM o),
s AS (SELECT *, lower(c) = lower(t) AND NOT ren AND NOT dup AS same, NOT dup AND NOT ren AND NOT unc AND NOT messy AND lv = 'optional' AND low AS weak, dup AND (failed OR NOT has_of OR low) AS inv FROM r)
SELECT op_id, same OR weak AS suppress, NOT same AND NOT weak AND dup AND NOT inv AS is_duplicate, ren AND NOT same AS rename_only,
  NOT failed AND NOT (low AND NOT (messy OR unc)) AND NOT (length(reason) < 18 AND NOT strong) AND (strong OR messy OR unc) AS review FROM s"""


def strategies(spark, sf):
    n = fx.named_files(spark, sf)
    profiled = nm.doc_profile(n, _as_of())
    moves = profiled.select(
        "doc_id", "path", F.concat(F.lit("src1/en/"), F.regexp_replace("path", "^.*/", "")).alias("current"), F.concat(F.lit("New/Deep/"), F.regexp_replace("path", "^.*/", "")).alias("target"),
        "content", F.timestamp_micros(F.lit(fx.EPOCH_2024_US) + F.col("doc_id") * fx.MINUTE_US).alias("modified_at"), "folder.category", "folder.subcategory", "plan_title",
    )
    dictionary = n.select(F.explode(F.array(F.lit("src1"), F.lit("work"), F.lit("career"))).alias("key")).distinct().select(F.lit("top").alias("kind"), "key", F.lit("").alias("inner_key"), F.lit(1).cast("bigint").alias("n"))
    return pl.apply_strategies(moves, ["type", "timeline", "project"], dictionary).select("doc_id", "strategy", "target", "rationale")


STRATEGY_SQL = f"""
WITH p AS ({NAMING_SQL}),
x AS (SELECT path, category, subcategory, regexp_extract(path, '[^/]*$') AS nm, CAST(regexp_extract(path, ' (\\d+)\\.', 1) AS BIGINT) AS doc_id FROM p),
d AS (SELECT x.*, 1 + (doc_id % (SELECT max(doc_id) + 1 FROM documents)) % 12 AS mo FROM x)
SELECT doc_id, 'type' AS strategy, CASE WHEN category IN ('Work', 'Career') THEN category || '/' || subcategory ELSE 'New/Deep' END || '/' || nm AS target,
  'type-based grouping' || CASE WHEN category IN ('Work', 'Career') THEN '' ELSE ' fell outside vault taxonomy, kept semantic path' END AS rationale FROM d
UNION ALL SELECT doc_id, 'timeline', 'Timeline/2024/' || printf('%02d', mo) || '-' || ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][mo] || '/' || nm, 'timeline grouping' FROM d
UNION ALL SELECT doc_id, 'project', 'src1/en/Deep/' || nm, 'kept within current project/workstream' FROM d"""


def reorganization_plan(spark, sf):
    plan = pl.build_plan(fx.notes(spark, sf), responses=_responses(spark, sf), preferences=pl.learn_preferences(operations(spark, sf)), as_of=_as_of())
    return plan.select("type", "level", "source_path", "target_path", "reason", "issue_type", "review.quality", "review.file_role", "review.validation")


def _responses(spark, sf):
    r = model_responses(spark, sf)
    s = rs.parse_suggestion("raw", "path", F.lit("general"), F.lit("Planned Title"), F.lit("Fallback/Path"))
    return r.select("path", s.alias("s")).filter(F.col("s").isNotNull()).select("path", "s.*")


def plan_summary(spark, sf):
    notes = fx.notes(spark, sf)
    return pl.plan_summary(operations(spark, sf), notes)


SUMMARY_SQL = f"""
WITH {OPERATIONS_CTE}
SELECT (SELECT count(*) FROM notes) AS total_notes, count(*) FILTER (WHERE type = 'move') AS to_move, count(*) FILTER (WHERE type = 'delete') AS to_delete,
  count(*) FILTER (WHERE type = 'merge') AS to_merge, count(*) FILTER (WHERE type = 'structural') AS structural_issues FROM ops"""


def analysis_routes(spark, sf):
    notes = fx.notes(spark, sf)
    old = notes.filter(F.col("doc_id") % 3 == 0).select("path", pl.content_hash(F.concat_ws(":", "kind", "content")).alias("content_hash"), F.when(F.col("doc_id") % 2 == 0, "m:1").otherwise("other").alias("model"))
    return pl.analysis_route(notes, old, "m").select("path", "route")


ROUTES_SQL = f"""
WITH {fx.NOTES_SQL}
SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'cached' WHEN {q.uncategorized('path')} OR length({q.strip('content')}) >= 1800
  OR (length({q.strip('content')}) >= 700 AND regexp_matches(content, '(^|\\n)#\\s+')) THEN 'needs_model' ELSE 'heuristic' END AS route FROM notes"""


def _applied(spark, sf):
    """A plan with all kinds of steps, carried out: names that many want, merges of two notes into a third, deletions."""
    n = cut_lineage(fx.notes(spark, sf).select("doc_id", "path", "content"))
    turn, d = F.col("doc_id") % 5, F.col("doc_id")
    into = n.select(F.col("doc_id").alias("into"), F.col("path").alias("into_path"))
    steps = n.withColumn("into", F.floor(d / 10) * 10 + 3).join(into, "into", "left")
    target = (
        F.when(turn == 0, F.concat(F.lit("Inbox/file "), (d % 7).cast("string"), F.lit(".md"))).when(turn == 1, F.col("into_path"))
        .when(turn == 4, F.concat(F.lit("Moved/"), d.cast("string"), F.lit(".md")))
    )
    plan = steps.filter(turn != 3).select(
        d.alias("op_id"), F.when(turn == 1, "merge").when(turn == 2, "delete").otherwise("move").alias("type"), F.col("path").alias("source_path"),
        target.alias("target_path"), F.lit(None).cast("string").alias("issue_type"), F.lit("why").alias("reason"),
    )
    approved = plan.filter(F.col("op_id") % 11 > 0).select("op_id")
    return pl.apply_plan(n.select("path", "content"), plan, approved, "run1")


def apply_plan(spark, sf):
    """Documents after the approved operations, by digest of their text."""
    return _applied(spark, sf)[0].select("path", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def plan_trash(spark, sf):
    return _applied(spark, sf)[1].select("trash_path", "source_path", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def plan_undo(spark, sf):
    return _applied(spark, sf)[2].select("op_id", "operation", "source_path", "target_path", "trash_path", "reason")


_APPLIED_CTE = f"""{fx.NOTES_SQL},
st AS (SELECT n.doc_id, n.path, n.content, CASE WHEN n.doc_id % 11 > 0 THEN n.doc_id % 5 ELSE 3 END AS turn, t.path AS into_path, t.doc_id AS into_id
  FROM notes n LEFT JOIN notes t ON t.doc_id = n.doc_id // 10 * 10 + 3),
ok AS (SELECT *, CASE WHEN turn = 1 AND (into_path IS NULL OR into_id % 5 <> 3) THEN 3 ELSE turn END AS act FROM st),
mv AS (SELECT doc_id, path, content, CASE WHEN act = 4 THEN 'Moved/' || doc_id || '.md' ELSE 'Inbox/file ' || doc_id % 7
   || CASE WHEN nth > 0 THEN '-' || (nth + 1) ELSE '' END || '.md' END AS final
  FROM (SELECT *, row_number() OVER (PARTITION BY act, doc_id % 7 ORDER BY doc_id) - 1 AS nth FROM ok WHERE act IN (0, 4))),
tr AS (SELECT doc_id, path, content, act, into_path, 'Trash/run1/' || CASE WHEN nth > 0 THEN regexp_replace(safe, '\\.md$', '-' || (nth + 1) || '.md') ELSE safe END AS trash_path
  FROM (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY doc_id, path) - 1 AS nth
    FROM (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '[^a-zA-Z0-9._-]', '-', 'g') AS safe FROM ok WHERE act IN (1, 2))))"""

APPLY_SQL = f"""
WITH {_APPLIED_CTE},
added AS (SELECT into_path AS path, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS more FROM ok WHERE act = 1 GROUP BY ALL)
SELECT path, md5(content || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || more, '')) AS content_md5 FROM ok LEFT JOIN added USING (path) WHERE act = 3
UNION ALL SELECT final, md5(content) FROM mv"""

TRASH_SQL = f"WITH {_APPLIED_CTE} SELECT trash_path, path AS source_path, md5(content) AS content_md5 FROM tr"

UNDO_SQL = f"""
WITH {_APPLIED_CTE}
SELECT doc_id AS op_id, 'move' AS operation, path AS source_path, final AS target_path, NULL AS trash_path, 'why' AS reason FROM mv
UNION ALL SELECT doc_id, CASE act WHEN 1 THEN 'merge' ELSE 'delete' END, path, CASE act WHEN 1 THEN into_path END, trash_path, 'why' FROM tr"""


def project_tree(spark, sf):
    o = operations(spark, sf)
    return pl.project_tree(fx.notes(spark, sf), o, o.filter("approved"))


PROJECT_SQL = f"""
WITH {OPERATIONS_CTE},
a AS (SELECT * FROM ops WHERE approved), mv AS (SELECT * FROM a WHERE type IN ('move', 'structural')),
arr AS (SELECT target_path AS path, arg_max(source_path, op_id) AS source_path FROM mv GROUP BY ALL),
lft AS (SELECT path FROM notes WHERE path NOT IN (SELECT source_path FROM a WHERE type <> 'merge' OR true) AND path NOT IN (SELECT path FROM arr)),
mg AS (SELECT target_path AS path, arg_max(source_path, op_id) AS source_path FROM a WHERE type = 'merge' GROUP BY ALL)
SELECT path, source_path, CASE WHEN source_path IS NOT NULL THEN 'merge-target' END AS change_kind FROM lft LEFT JOIN mg USING (path)
UNION ALL SELECT path, source_path, CASE WHEN lower({_FOLD('source_path')}) <> lower({_FOLD('path')}) AND lower(regexp_extract(source_path, '[^/]*$')) <> lower(regexp_extract(path, '[^/]*$')) THEN 'move-rename'
  WHEN lower({_FOLD('source_path')}) <> lower({_FOLD('path')}) THEN 'move' WHEN lower(regexp_extract(source_path, '[^/]*$')) <> lower(regexp_extract(path, '[^/]*$')) THEN 'rename' END FROM arr"""

ITEMS = {
    "naming_kinds": Item(naming_kinds, NAMING_SQL),
    "naming_plans": Item(naming_plans),
    "ranked_keywords": Item(ranked_keywords, RANKED_SQL),
    "title_checks": Item(title_checks, TITLE_SQL),
    "parsed_suggestions": Item(parsed_suggestions, SUGGESTIONS_SQL),
    "taxonomy": Item(taxonomy, TAXONOMY_SQL),
    "folder_counts": Item(folder_counts, FOLDERS_SQL),
    "tree_stats": Item(tree_stats, TREE_SQL),
    "structural_issues": Item(structural_issues, STRUCTURAL_SQL),
    "clutter_folders": Item(clutter_folders, CLUTTER_SQL),
    "review_table": Item(review_table, REVIEW_SQL),
    "destination_clusters": Item(destination_clusters, CLUSTERS_SQL),
    "confidence_counts": Item(confidence_counts, CONFIDENCE_SQL),
    "learn_preferences": Item(learn_preferences, PREFS_SQL),
    "folder_fit": Item(folder_fit, FIT_SQL),
    "learned_targets": Item(learned_targets, LEARNED_SQL),
    "explained_moves": Item(explained_moves, EXPLAINED_SQL),
    "move_outcomes": Item(move_outcomes, OUTCOME_SQL),
    "strategies": Item(strategies, STRATEGY_SQL),
    "reorganization_plan": Item(reorganization_plan),
    "plan_summary": Item(plan_summary, SUMMARY_SQL),
    "analysis_routes": Item(analysis_routes, ROUTES_SQL),
    "apply_plan": Item(apply_plan, APPLY_SQL),
    "plan_trash": Item(plan_trash, TRASH_SQL),
    "plan_undo": Item(plan_undo, UNDO_SQL),
    "project_tree": Item(project_tree, PROJECT_SQL),
}
