"""Reorganization: structure checks, taxonomy, learned preferences, move decisions, the plan and its application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths as pt
from corpusloom.functions import review as rv
from corpusloom.functions.columns import ColumnLike, choose, col, has_word, let, non_empty, one_of, trim
from corpusloom.functions.duplicates import is_noisy_name
from corpusloom.functions.naming import doc_profile, needs_title_cleanup
from corpusloom.functions.responses import LOW_CONFIDENCE, is_fallback_reason, suggestion_path
from corpusloom.functions.text import content_hash, timeline_date
from corpusloom.operators.duplicates import detect_duplicates
from corpusloom.operators.maintenance import model_matches
from corpusloom.operators.positions import number_rows
from corpusloom.session import cut_lineage

# Fixed values.
CLUTTER_NAMES = [
    "copies", "copy", "exports", "export", "imports", "import", "scans", "scan", "uploads", "upload", "tmp", "temp",
]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
UNCERTAIN = "(?i)heuristic pass|could not parse analysis|analysis failed|error during analysis|low-confidence"
REVIEW_WORDS = (
    "empty|blank|orphaned|broken|corrupt|garbage|junk|temporary|temp|unsupported|manual check|required|unreadable|failed"
)
MERGE_SEPARATOR = "\n\n---\n\n"
PLAN_COLUMNS = ["type", "level", "source_path", "target_path", "reason", "issue_type", "review"]
REVIEW_TYPE = (
    "struct<file_kind:string,quality:string,quality_reason:string,file_role:string,conservative:boolean,"
    "validated:boolean,validation:string>"
)


def _lower_parent(path: ColumnLike) -> Column:
    parts = pt.segments(F.lower(col(path)))
    return let(parts, lambda p: F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), "/"))


def _lower_top(path: ColumnLike) -> Column:
    return F.coalesce(F.get(pt.segments(F.lower(col(path))), F.lit(0)), F.lit(""))


def learning_tokens(path: ColumnLike) -> Column:
    """Words of at least four characters of a file name."""
    name = F.regexp_replace(F.lower(F.substring_index(col(path), "/", -1)), "\\.[^.]+$", "")
    words = F.split(F.regexp_replace(name, "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda t: F.length(t) >= 4)


# Structure of the folder tree.


def folder_counts(paths: DataFrame) -> DataFrame:
    """For each folder its direct files, direct subfolders and all files below it: a roll-up over path levels."""
    parts = paths.select(pt.segments("path").alias("p"))
    levels = parts.select(
        F.explode(
            F.when(
                F.size("p") > 1,
                F.transform(
                    F.sequence(F.lit(1), F.size("p") - 1),
                    lambda n: F.struct(F.array_join(F.slice(F.col("p"), 1, n), "/").alias("folder"), (n == F.size("p") - 1).alias("direct")),
                ),
            )
        ).alias("l")
    ).select("l.folder", "l.direct")
    files = levels.groupBy("folder").agg(
        F.count(F.lit(1)).alias("files_below"), F.count_if("direct").alias("files")
    )
    children = files.filter(F.contains("folder", F.lit("/"))).groupBy(pt.parent("folder").alias("folder")).agg(F.count(F.lit(1)).alias("folders"))
    return files.join(children, "folder", "left").select("folder", "files", F.coalesce("folders", F.lit(0)).alias("folders"), "files_below")


def tree_stats(paths: DataFrame) -> DataFrame:
    """Number of files and folders, in one row."""
    folders = folder_counts(paths).agg(F.count(F.lit(1)))
    return paths.agg(F.count(F.lit(1)).alias("files")).select("files", folders.scalar().alias("folders"))


def structural_issues(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Repeated folder names, empty folders and repeated extensions, as plan rows."""
    known = folders.select(F.col("folder")).distinct()
    parts = pt.segments("folder")
    name = F.element_at(parts, -1)
    nested = known.filter(F.size(F.filter(parts, lambda p: p == name)) > 1).select(
        F.lit("structural").alias("type"), F.lit("recommended").alias("level"), F.col("folder").alias("source_path"),
        F.concat(F.lit("Nested/repeated folder name: '"), name, F.lit("' appears multiple times in path")).alias("reason"),
        F.lit("nestedFolders").alias("issue_type"),
    )
    filled = folder_counts(paths).select("folder").unionByName(
        known.select(pt.parent("folder").alias("folder")).filter(F.col("folder") != "")
    )
    empty = known.join(filled, "folder", "left_anti").select(
        F.lit("delete").alias("type"), F.lit("strong").alias("level"), F.col("folder").alias("source_path"),
        F.concat(F.lit("Delete empty folder: '"), "folder", F.lit("'")).alias("reason"), F.lit("emptyFolder").alias("issue_type"),
    )
    repeated = paths.filter(F.regexp_like("path", F.lit("(?i)\\.md(\\.md)+$"))).select(
        F.lit("structural").alias("type"), F.lit("recommended").alias("level"), F.col("path").alias("source_path"),
        F.lit("File has repeated .md extensions").alias("reason"), F.lit("repeatedExtension").alias("issue_type"),
    )
    return nested.unionByName(empty).unionByName(repeated)


def clutter_folders(paths: DataFrame, max_files: int | None = None) -> DataFrame:
    """Files of shallow copy or export folders, with their place in the parent folder; of any size unless bounded."""
    files = paths.select("path", pt.parent("path").alias("folder"), pt.file_name("path").alias("name"))
    counted = files.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_noisy_name("name")).alias("noisy")
    )
    folder_name = F.lower(F.substring_index("folder", "/", -1))
    # A folder that holds any folder appears among the parents of folders.
    with_folders = folder_counts(paths).filter(F.col("folders") > 0).select("folder")
    chosen = counted.filter(
        F.contains("folder", F.lit("/")) & one_of(folder_name, CLUTTER_NAMES) & (F.col("n") == F.col("noisy"))
        & (F.lit(True) if max_files is None else F.col("n") <= max_files)
    ).join(with_folders, "folder", "left_anti")
    up = pt.parent("folder")
    return files.join(chosen.select("folder"), "folder").select(
        "path", "folder", F.concat_ws("/", up, "name").alias("target"),
        F.concat(F.lit("Flatten shallow clutter folder '"), "folder", F.lit("' into '"), up, F.lit("' (flatten noisy copy/export container)")).alias("reason"),
    )


# Taxonomy and preferences, kept as one dictionary (kind, key, inner_key, n).


def taxonomy(paths: DataFrame) -> DataFrame:
    """Top folders and subfolders that structured files already use."""
    relative = paths.select(pt.strip_notes_root(pt.normalize_path("path")).alias("path")).filter(pt.is_structured("path"))
    keys = F.array_compact(
        F.array(
            F.struct(F.lit("top").alias("kind"), _lower_top("path").alias("key")),
            F.when(F.size(pt.segments("path")) >= 3, F.struct(F.lit("sub").alias("kind"), _lower_parent("path").alias("key"))),
        )
    )
    return relative.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("n")).select(
        "kind", "key", F.lit("").alias("inner_key"), "n"
    )


def top_move_key(source: ColumnLike, target: ColumnLike) -> Column:
    a, b = _lower_top(source), _lower_top(target)
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("=>"), b)).otherwise("")


def learn_preferences(decisions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Counters after review decisions (type, source_path, target_path, approved), added to the known ones."""
    moves = decisions.filter((F.col("type") == "move") & (F.coalesce("target_path", F.lit("")) != ""))
    entry = lambda kind, key, inner="": F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), (F.lit(inner) if isinstance(inner, str) else inner).alias("inner_key")
    )
    top, up = top_move_key("source_path", "target_path"), _lower_parent("target_path")
    accepted = F.concat(
        F.array(entry("accepted_top", top), entry("accepted_parent", up)),
        F.transform(learning_tokens("source_path"), lambda t: entry("token_parent", t, up)),
    )
    denied = F.array(entry("denied_top", top), entry("denied_parent", up))
    counted = (
        moves.select(F.explode(F.when(F.col("approved"), accepted).otherwise(denied)).alias("e"))
        .select("e.*")
        .filter((F.col("key") != "") & ((F.col("kind") != "token_parent") | (F.col("inner_key") != "")))
        .groupBy("kind", "key", "inner_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if known is None:
        return counted
    return known.select("kind", "key", "inner_key", "n").unionByName(counted).groupBy("kind", "key", "inner_key").agg(F.sum("n").alias("n"))


def apply_learned_parent(moves: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Redirect suggested paths to the folder that files of similar names were approved for, if it is known well."""
    learned = dictionary.filter(F.col("kind") == "token_parent").select(F.col("key").alias("token"), F.col("inner_key").alias("learned"), "n")
    tokens = moves.select("path", F.explode(learning_tokens("current")).alias("token"))
    scores = tokens.join(learned, "token").groupBy("path", "learned").agg(F.sum("n").alias("score"))
    best = scores.groupBy("path").agg(F.min_by(F.struct("learned", "score"), F.struct((-F.col("score")).alias("s"), "learned")).alias("b"))
    good = best.filter(F.col("b.score") >= 2).select("path", F.col("b.learned").alias("learned"))
    tops = dictionary.filter(F.col("kind") == "top").select(F.col("key").alias("learned_top")).distinct()
    any_top = tops.select(F.count(F.lit(1))).scalar()
    joined = moves.join(good, "path", "left").withColumn("learned_top", F.substring_index("learned", "/", 1)).join(
        tops.withColumn("top_known", F.lit(True)), "learned_top", "left"
    )
    allowed = F.col("learned").isNotNull() & ((any_top == 0) | F.coalesce("top_known", F.lit(False)))
    return joined.withColumn(
        "target", F.when(allowed & (pt.file_name("target") != ""), F.concat_ws("/", "learned", pt.file_name("target"))).otherwise(F.col("target"))
    ).drop("learned", "learned_top", "top_known")


def align_to_taxonomy(moves: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Keep a structured file in its known top folder when the suggested one is unknown."""
    tops = dictionary.filter(F.col("kind") == "top").select("key").distinct()
    joined = (
        moves.withColumn("_here", _lower_top("current")).withColumn("_there", _lower_top("target"))
        .join(tops.select(F.col("key").alias("_here"), F.lit(True).alias("_here_known")), "_here", "left")
        .join(tops.select(F.col("key").alias("_there"), F.lit(True).alias("_there_known")), "_there", "left")
    )
    unknown = F.col("_there_known").isNull() & F.col("_here_known").isNotNull() & pt.is_structured("current")
    keep = (F.col("_there") == "") | unknown
    return joined.withColumn("target", F.when(keep, F.col("current")).otherwise(F.col("target"))).drop("_here", "_there", "_here_known", "_there_known")


def folder_fit(moves: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add how well current and target folder fit: (path, current, target) -> current_fit, target_fit and counters.

    All look-ups of a move go through one join with the dictionary and one aggregation.
    """
    here, there = _lower_parent("current"), _lower_parent("target")
    look = lambda slot, kind, key, inner=F.lit(""): F.struct(
        F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), key.alias("key"), inner.alias("inner_key")
    )
    move_key = top_move_key("current", "target")
    wanted = F.concat(
        F.array(
            look("here_top", "top", _lower_top("current")), look("there_top", "top", _lower_top("target")),
            look("here_sub", "sub", here), look("there_sub", "sub", there),
            look("here_ok", "accepted_parent", here), look("there_ok", "accepted_parent", there), look("there_no", "denied_parent", there),
            look("move_ok", "accepted_top", move_key), look("move_no", "denied_top", move_key),
        ),
        F.transform(learning_tokens("current"), lambda t: look("here_token", "token_parent", t, here)),
        F.transform(learning_tokens("current"), lambda t: look("there_token", "token_parent", t, there)),
    )
    asked = moves.select("path", F.explode(wanted).alias("w")).select("path", "w.*").filter(F.col("key") != "")
    found = asked.join(dictionary, ["kind", "key", "inner_key"])
    slot = lambda name: F.coalesce(F.sum(F.when(F.col("slot") == name, F.col("n"))), F.lit(0)).alias(name)
    names = ["here_top", "there_top", "here_sub", "there_sub", "here_ok", "there_ok", "there_no", "move_ok", "move_no", "here_token", "there_token"]
    counts = found.groupBy("path").agg(*[slot(n) for n in names])
    joined = moves.join(counts, "path", "left").fillna(0, names)
    at_most = lambda limit, name: F.least(F.lit(limit), F.col(name))
    known = lambda name: F.col(name) > 0
    top_there = _lower_top("target")
    current_fit = (
        F.when(known("here_top"), 2).otherwise(0) + F.when(known("here_sub"), 3).otherwise(0)
        + at_most(3, "here_ok") + at_most(3, "here_token")
    )
    target_fit = (
        choose((known("there_top"), F.lit(2)), (top_there != "", F.lit(-2)), otherwise=F.lit(0))
        + choose((known("there_sub"), F.lit(3)), ((_lower_parent("target") != "") & known("there_top"), F.lit(-1)), otherwise=F.lit(0))
        + F.when((top_there != "") & (_lower_top("current") == top_there), 1).otherwise(0)
        + at_most(3, "move_ok") - at_most(3, "move_no") + at_most(4, "there_ok") - at_most(4, "there_no") + at_most(4, "there_token")
    )
    return joined.withColumn("current_fit", current_fit).withColumn("target_fit", target_fit)


def should_move(structured: Column, parse_failed: Column, title_messy: Column, reason: ColumnLike = "reason") -> Column:
    """Whether a move with its fits (see folder_fit) is worth suggesting."""
    delta = F.col("target_fit") - F.col("current_fit")
    here, there = _lower_top("current"), _lower_top("target")
    level = pt.suggestion_level("current", "target")
    other_top = (here != "") & (there != "") & (here != there)
    blocked = (
        ((F.col("move_no") >= 2) & (F.col("move_no") > F.col("move_ok")))
        | ((F.col("there_no") >= 2) & (F.col("there_no") > F.col("there_ok")))
    )
    careful = F.regexp_like(col(reason), F.lit(UNCERTAIN)) | (level == "optional") | other_top
    return choose(
        (pt.looks_uncategorized("current"), F.lit(True)),
        ((F.col("target") == F.col("current")) | (parse_failed & structured) | blocked, F.lit(False)),
        (structured & other_top & (F.col("there_top") == 0), F.lit(False)),
        (_lower_parent("current") == _lower_parent("target"), title_messy),
        (structured & careful, delta >= 3), (structured & (level == "recommended"), delta >= 2),
        otherwise=delta > 0,
    )


def fit_explanation() -> Column:
    delta = F.col("target_fit") - F.col("current_fit")
    return choose(
        (delta >= 3, "target folder is a much stronger fit than the current location"),
        (delta >= 2, "target folder is a better fit than the current location"),
    )


def explain_move(moves: DataFrame, dictionary: DataFrame, reason: str = "reason") -> DataFrame:
    """Append the evidence for each move (with fits, see folder_fit) to its reason."""
    learned = dictionary.filter(F.col("kind") == "token_parent").select(F.col("key").alias("token"), F.col("inner_key").alias("folder"), "n")
    tokens = moves.select("path", _lower_parent("target").alias("folder"), F.posexplode(learning_tokens("current")).alias("nth", "token"))
    pattern = (
        tokens.join(learned, ["token", "folder"])
        .groupBy("path")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "nth", "token"))), 1, 2).alias("t"))
        .select("path", F.array_join(F.transform("t", lambda e: F.concat(e["token"], F.lit(" ("), (-e["rank"]).cast("string"), F.lit(")"))), ", ").alias("patterns"))
    )
    times = lambda name: F.concat(F.col(name).cast("string"), F.lit(" time"), F.when(F.col(name) == 1, "").otherwise("s"))
    here, there = _lower_top("current"), _lower_top("target")
    bits = F.array_compact(
        F.array(
            F.when(pt.looks_uncategorized("current"), "root or uncategorized note"),
            F.when(F.col("there_top") > 0, "matches existing vault category structure"),
            F.when((here != there) & (F.col("move_ok") > 0), F.concat(F.lit("similar top-level move approved "), times("move_ok"))),
            F.when(F.col("there_ok") > 0, F.concat(F.lit("target folder approved "), times("there_ok"))),
            F.concat(F.lit("similar approved note patterns: "), "patterns"),
            fit_explanation(),
        )
    )
    plain = F.when(pt.suggestion_level("current", "target") == "optional", F.array(F.lit(LOW_CONFIDENCE))).otherwise(bits)
    evidence = let(bits, lambda b: F.when(F.size(b) > 0, b).otherwise(plain))
    return moves.join(pattern, "path", "left").withColumn("evidence", evidence).withColumn(
        reason,
        F.when(F.size("evidence") > 0, F.concat(reason, F.lit(" ("), F.array_join("evidence", " • "), F.lit(")"))).otherwise(F.col(reason)),
    ).drop("patterns", "evidence")


# Strategies.


def _file_for(raw: Column, fallback: Column) -> Column:
    """Safe file name of ``raw``, with the fallback's extension if it has none."""
    extension = F.coalesce(F.nullif(pt.dotted_extension(raw), F.lit("")), pt.dotted_extension(fallback))
    name = pt.clean_segment(pt.stem(raw))
    return F.concat(F.when(name == "", "Note").otherwise(name), extension)


def apply_strategy(moves: DataFrame, strategy: str, dictionary: DataFrame) -> DataFrame:
    """Bend targets to a strategy: by meaning, type, timeline or project.

    ``moves`` has path, current, target, content, modified_at, category, subcategory and plan_title. A result outside
    the known top folders falls back to the target as it was. Adds ``rationale``.
    """
    if strategy == "meaning":
        return moves.withColumn("rationale", F.lit("meaning-based organization"))
    if strategy not in ("type", "timeline", "project"):
        raise ValueError(f"unknown strategy {strategy!r}")
    current, target = F.col("current"), F.col("target")
    name = _file_for(pt.file_name(target), current)
    clean = lambda parts: F.array_join(non_empty(F.transform(parts, pt.clean_segment)), "/")
    if strategy == "type":
        bent = F.concat_ws("/", clean(F.array_compact(F.array("category", "subcategory"))), name)
        why = F.lit("type-based grouping")
    elif strategy == "timeline":
        # A caller that has left the texts behind brings the dates along.
        dates = F.col("timeline") if "timeline" in moves.columns else timeline_date("current", "content", "modified_at")
        moves = moves.withColumn("_when", dates)
        month = F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.col("_when.month") - 1)
        dated = F.concat_ws("/", F.lit("Timeline"), F.col("_when.year").cast("string"), F.concat(F.format_string("%02d-", F.col("_when.month")), month), name)
        bent = F.when(F.col("_when").isNotNull(), dated).otherwise(target)
        why = F.when(F.col("_when").isNotNull(), "timeline grouping").otherwise("timeline grouping unavailable, kept semantic path")
    else:
        here, there = pt.segments(current), pt.segments(target)
        anchor = F.slice(here, 1, F.least(F.size(here) - 1, F.lit(2)))
        inner = F.slice(there, 2, F.greatest(F.size(there) - 2, F.lit(0)))
        tail = F.get(inner, F.size(inner) - 1)
        extra = F.when(tail.isNotNull() & (F.lower(tail) != F.lower(F.element_at(anchor, -1))), F.array(tail)).otherwise(F.array().cast("array<string>"))
        loose = pt.looks_uncategorized("current")
        same = _lower_top("current") == _lower_top("target")
        bent = F.when(loose | same, target).otherwise(F.concat_ws("/", clean(F.concat(anchor, extra)), name))
        why = choose(
            (loose, "uncategorized note still uses semantic/project suggestion"), (same, "project-aligned semantic path"),
            otherwise="kept within current project/workstream",
        )
    tops = dictionary.filter(F.col("kind") == "top").select(F.col("key").alias("_top"), F.lit(True).alias("_known")).distinct()
    any_top = tops.select(F.count(F.lit(1))).scalar()
    joined = (
        moves.withColumn("_bent", bent).withColumn("_why", why).withColumn("_top", _lower_top("_bent")).join(tops, "_top", "left")
    )
    accepted = one_of(F.col("_top"), ["", "timeline"]) | (any_top == 0) | F.coalesce("_known", F.lit(False))
    folders = pt.parent("_bent")
    plain = F.concat_ws("/", F.lit("Unsorted"), _file_for(F.concat("plan_title", pt.dotted_extension(current)), current))
    final = F.when(folders == "", plain).otherwise(F.concat_ws("/", clean(pt.segments(folders)), _file_for(pt.file_name("_bent"), current)))
    return (
        joined.withColumn("_final", F.when(accepted, final).otherwise(target))
        .withColumn("rationale", F.when(accepted, F.col("_why")).otherwise(F.concat("_why", F.lit(" fell outside vault taxonomy, kept semantic path"))))
        .withColumn("target", F.col("_final"))
        .drop("_bent", "_why", "_top", "_known", "_final", "_when")
    )


def apply_strategies(moves: DataFrame, strategies: list[str], dictionary: DataFrame) -> DataFrame:
    """The same moves under each of some strategies, named in ``strategy``; see apply_strategy.

    What the moves hold is worked out once for all strategies, and the texts are left behind.
    """
    if "timeline" in strategies and "timeline" not in moves.columns:
        moves = moves.withColumn("timeline", timeline_date("current", "content", "modified_at"))
    slim, dictionary = cut_lineage(moves.drop("content")), cut_lineage(dictionary)
    bent = [apply_strategy(slim, name, dictionary).withColumn("strategy", F.lit(name)) for name in strategies]
    return reduce(DataFrame.unionByName, bent)


# Decisions on single documents.


def move_outcome(current: ColumnLike, target: ColumnLike, reason: ColumnLike, parse_failed: Column, title_messy: Column, is_duplicate: Column, duplicate_of: Column) -> Column:
    """Struct of suppress, is_duplicate and rename_only."""
    low = F.contains(F.lower(col(reason)), F.lit(LOW_CONFIDENCE))
    here, there = F.lower(col(current)), F.lower(col(target))
    rename = (F.lower(pt.parent(current)) == F.lower(pt.parent(target))) & (
        F.lower(F.substring_index(col(current), "/", -1)) != F.lower(F.substring_index(col(target), "/", -1))
    )
    other = F.coalesce(duplicate_of, F.lit(""))
    invalid = is_duplicate & (parse_failed | (other == "") | (F.lower(other) == here) | low)
    weak = (
        ~is_duplicate & ~rename & ~pt.looks_uncategorized(current) & ~title_messy
        & (pt.suggestion_level(current, target) == "optional") & low
    )
    same = (here == there) & ~rename & ~is_duplicate
    return F.struct(
        (same | weak).alias("suppress"), (~same & ~weak & is_duplicate & ~invalid).alias("is_duplicate"), (rename & ~same).alias("rename_only")
    )


def surfaces_review(current: ColumnLike, reason: ColumnLike, parse_failed: Column, title_messy: Column) -> Column:
    """Whether a suggestion not to keep a file is worth a manual review."""
    low = F.contains(F.lower(col(reason)), F.lit(LOW_CONFIDENCE))
    strong = has_word(reason, REVIEW_WORDS)
    loose = title_messy | pt.looks_uncategorized(current)
    return ~parse_failed & ~(low & ~loose) & ~((F.length(trim(reason)) < 18) & ~strong) & (strong | loose)


def needs_model(path: ColumnLike, content: ColumnLike) -> Column:
    relative = pt.strip_notes_root(pt.normalize_path(path))
    length = F.length(trim(content))
    return (
        pt.looks_uncategorized(relative) | pt.has_generic_title(relative) | (length >= 1800)
        | ((length >= 700) & F.regexp_like(col(content), F.lit("(^|\\n)#\\s+")))
    )


def analysis_route(documents: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """How each document (path, kind, content) is analyzed: from the cache, by rules, or by a model.

    ``cache(path, content_hash, model)``; entries of missing paths never match and so drop out.
    """
    hashed = documents.withColumn("content_hash", content_hash(F.concat_ws(":", "kind", "content")))
    old = cache.select("path", F.col("content_hash").alias("old_hash"), F.col("model").alias("old_model"))
    hit = (F.col("old_hash") == F.col("content_hash")) & model_matches(F.lit(model), F.col("old_model"))
    return hashed.join(old, "path", "left").withColumn(
        "route",
        choose((F.coalesce(hit, F.lit(False)), "cached"), (~needs_model("path", "content"), "heuristic"), otherwise="needs_model"),
    ).drop("old_hash", "old_model")


def _analyses(profiles: DataFrame, responses: DataFrame | None) -> DataFrame:
    """One analysis for each document: the model's response where one is needed and given, else rules."""
    current = F.col("current")
    inferred = pt.normalize_suggested_path(pt.suggest_path_from_name(current), current)
    by_rule = F.struct(
        F.lit(True).alias("should_keep"), inferred.alias("suggested_path"), pt.title_of(current).alias("suggested_title"),
        F.lit(False).alias("is_duplicate"), F.lit(None).cast("string").alias("duplicate_of"),
        F.concat(
            F.when(inferred == current, "Heuristic pass: path already looks organized").otherwise("Heuristic pass: moved from uncategorized/generic location"),
            F.when(F.col("conservative"), F.concat(F.lit(" ("), "quality.reason", F.lit(")"))).otherwise(""),
        ).alias("reason"),
    )
    bare = F.regexp_replace(current, "(?i)\\.md$", "")
    planned = F.concat_ws("/", "category", "subcategory", pt.clean_segment("plan_title"))
    loose = (F.size(pt.segments(bare)) <= 1) | one_of(_lower_top(bare), ["quick notes", "notes", "misc", "miscellaneous", "general", "uncategorized", "untitled"])
    fallback_path = F.when(loose, suggestion_path(planned, bare, F.col("plan_title"))).otherwise(suggestion_path(bare, planned, F.col("plan_title")))
    fallback = F.struct(
        F.lit(True).alias("should_keep"), fallback_path.alias("suggested_path"), pt.file_name(fallback_path).alias("suggested_title"),
        F.lit(False).alias("is_duplicate"), F.lit(None).cast("string").alias("duplicate_of"),
        F.lit("Heuristic fallback from note content").alias("reason"),
    )
    if responses is None:
        answered = profiles.withColumn("response", F.lit(None).cast("struct<should_keep:boolean,suggested_path:string,suggested_title:string,is_duplicate:boolean,duplicate_of:string,reason:string>"))
    else:
        given = responses.select("path", F.struct("should_keep", "suggested_path", "suggested_title", "is_duplicate", "duplicate_of", "reason").alias("response"))
        answered = profiles.join(given, "path", "left")
    return answered.withColumn(
        "analysis", F.when(F.col("needs_model"), F.coalesce("response", fallback)).otherwise(by_rule)
    ).drop("response")


def _op(kind: str, level: ColumnLike, source: ColumnLike, target: Column, reason: ColumnLike, issue: ColumnLike, review: Column) -> list[Column]:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return [
        F.lit(kind).alias("type"), as_col(level).alias("level"), source.alias("source_path"), target.alias("target_path"),
        reason.alias("reason"), as_col(issue).alias("issue_type"), review.cast(REVIEW_TYPE).alias("review"),
    ]


def build_plan(
    documents: DataFrame, folders: DataFrame | None = None, responses: DataFrame | None = None,
    preferences: DataFrame | None = None, strategy: str = "meaning", as_of: Column | None = None,
) -> DataFrame:
    """The reviewable plan for a corpus (path, content, kind, modified_at).

    For each document the first of these applies: a structural move, a duplicate, a review, a merge, a move.
    """
    corpus = documents.filter(~pt.is_skipped_by_analysis("path") & pt.is_reorganizable("path"))
    paths = cut_lineage(corpus.select("path"))
    dictionary = taxonomy(paths)
    if preferences is not None:
        dictionary = dictionary.unionByName(preferences.select("kind", "key", "inner_key", "n"))
    dictionary = cut_lineage(dictionary)
    none, text_null = F.lit(None).cast(REVIEW_TYPE), F.lit(None).cast("string")

    if folders is None:
        folders = folder_counts(paths).select("folder")
    structural = structural_issues(paths, folders).select(
        "type", "level", "source_path", text_null.alias("target_path"), "reason", "issue_type", none.alias("review")
    )
    clutter = clutter_folders(paths)
    flattened = clutter.select(*_op("move", "recommended", F.col("path"), F.col("target"), F.col("reason"), text_null, none))

    # Profiles are costly and used many times, so they are written once; they leave the texts behind. Files of clutter
    # folders are taken out of them, and not of the texts, which so are never shuffled.
    profiles = (
        doc_profile(corpus, as_of)
        .withColumn("timeline", timeline_date("path", "content", "modified_at") if strategy == "timeline" else F.lit(None))
        .select(
            "path", "modified_at", "file_kind", "plan_title", "file_role", "quality", "conservative", "timeline",
            F.col("folder.category").alias("category"), F.col("folder.subcategory").alias("subcategory"),
            pt.strip_notes_root("path").alias("current"), needs_model("path", "content").alias("needs_model"),
        )
    )
    profiles = cut_lineage(cut_lineage(profiles).join(clutter.select("path"), "path", "left_anti"))
    review = lambda validation: F.struct(
        F.col("file_kind"), F.col("quality.quality").alias("quality"), F.col("quality.reason").alias("quality_reason"), F.col("file_role"),
        F.col("conservative"), F.lit(validation is not None).alias("validated"), F.lit(validation).alias("validation"),
    )
    copies = detect_duplicates(corpus.select("path", "content", "modified_at"), profiles.select("path", "file_role"))
    contexts = profiles.select("path", review(None).alias("review"))
    duplicates = copies.join(contexts, "path").select(
        F.when(F.col("kind") == "merge-recommended", "merge").otherwise("delete").alias("type"),
        F.when(F.col("kind") == "exact-delete", "strong").otherwise("recommended").alias("level"),
        F.col("path").alias("source_path"), F.when(F.col("kind") == "merge-recommended", F.col("target")).alias("target_path"),
        "reason", text_null.alias("issue_type"), F.col("review").cast(REVIEW_TYPE).alias("review"),
    )

    open_files = profiles.join(copies.select("path"), "path", "left_anti")
    analyzed = _analyses(open_files, responses).select("*", "analysis.*").drop("analysis")
    judged = cut_lineage(  # both files that stay and files that go read it
        analyzed.withColumn("parse_failed", is_fallback_reason("reason"))
        .withColumn("title_messy", needs_title_cleanup(pt.title_of("current")))
        .withColumn("structured", pt.is_structured("current"))
        .withColumn("loose", pt.looks_uncategorized("current"))
    )
    dropped = judged.filter(~F.col("should_keep"))
    safe_name = F.regexp_replace(pt.file_name("path"), "[^a-zA-Z0-9._-]", "-")
    reviews = dropped.filter(surfaces_review("current", "reason", F.col("parse_failed"), F.col("title_messy"))).select(
        *_op("move", "recommended", F.col("path"), F.concat(F.lit("Review/"), safe_name),
             F.concat("reason", F.lit(" (moved to Review for manual check)")), text_null, review("review"))
    )

    kept = judged.filter(F.col("should_keep"))
    suggested = pt.normalize_suggested_path("suggested_path", "current")
    inferred = pt.normalize_suggested_path(pt.suggest_path_from_name("current"), "current")
    start = choose((~F.col("parse_failed"), suggested), (F.col("loose"), inferred), otherwise=F.col("current"))
    moves = apply_learned_parent(align_to_taxonomy(kept.withColumn("target", start), dictionary), dictionary)
    moves = apply_strategy(moves, strategy, dictionary)
    new_title = trim(F.regexp_replace(pt.clean_segment("suggested_title"), "\\.[^/.]+$", ""))
    rename = (
        ~F.col("conservative") & F.col("title_messy") & (new_title != "") & (F.lower(new_title) != F.lower(pt.title_of("current")))
    )
    renamed = F.concat_ws("/", F.nullif(pt.parent("target"), F.lit("")), F.concat(new_title, pt.dotted_extension("target")))
    stay = F.col("conservative") & F.col("structured") & ~F.col("loose") & ~F.col("title_messy")
    noted = F.concat("reason", F.lit(" ("), "quality.reason", F.lit(")"))
    moves = cut_lineage(
        moves.withColumn("target", F.when(rename, renamed).otherwise(F.col("target")))
        .withColumn("target", F.when(stay, F.col("current")).otherwise(F.col("target")))
        .withColumn("reason", F.when(stay & ~F.contains(F.lower("reason"), F.lower("quality.reason")), noted).otherwise(F.col("reason")))
        .withColumn("outcome", move_outcome("current", "target", "reason", F.col("parse_failed"), F.col("title_messy"), F.col("is_duplicate"), F.col("duplicate_of")))
        .filter(~F.col("outcome.suppress"))
    )
    merges = moves.filter(F.col("outcome.is_duplicate")).select(
        *_op("merge", "strong", F.col("path"), F.col("duplicate_of"), F.col("reason"), text_null, review("duplicate"))
    )
    fitted = folder_fit(moves.filter(~F.col("outcome.is_duplicate")), dictionary)
    worth = fitted.filter(should_move(F.col("structured"), F.col("parse_failed"), F.col("title_messy")))
    based = worth.withColumn("reason", F.when(F.col("loose"), F.concat("reason", F.lit(" (auto-fix uncategorized path)"))).otherwise(F.col("reason")))
    if strategy != "meaning":
        based = based.withColumn("reason", F.concat("reason", F.lit(" ("), "rationale", F.lit(")")))
    level = F.when(F.col("title_messy") & (pt.parent("current") == pt.parent("target")), "recommended").otherwise(pt.suggestion_level("current", "target"))
    moved = explain_move(based, dictionary).select(
        *_op("move", level, F.col("path"), F.col("target"), F.col("reason"), text_null, review("move"))
    )
    parts = [structural, flattened, duplicates, reviews, merges, moved]
    plan = parts[0]
    for part in parts[1:]:
        plan = plan.unionByName(part)
    return plan


def number_plan(plan: DataFrame) -> DataFrame:
    """Give the operations consecutive numbers, in a fixed order."""
    return number_rows(plan, "type", "source_path", "issue_type").withColumnRenamed("position", "op_id")


def plan_summary(plan: DataFrame, documents: DataFrame) -> DataFrame:
    count = lambda kind: F.count_if(F.col("type") == kind)
    total = documents.filter(~pt.is_skipped_by_analysis("path") & pt.is_reorganizable("path")).agg(F.count(F.lit(1)))
    return plan.agg(
        count("move").alias("to_move"), count("delete").alias("to_delete"), count("merge").alias("to_merge"), count("structural").alias("structural_issues")
    ).select(total.scalar().alias("total_notes"), "*")


# Review and application.


def destination_clusters(plan: DataFrame, limit: int = 6) -> DataFrame:
    """The most frequent destinations of the plan's operations."""
    labelled = plan.select(rv.cluster_label("type", "target_path", "issue_type").alias("label")).filter(F.col("label").isNotNull())
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.lower("label"), "label").limit(limit)


def review_groups(plan: DataFrame) -> DataFrame:
    """Operations with their review group and its place in the fixed order of groups."""
    order = F.array(*[F.lit(g) for g in rv.GROUPS])
    grouped = plan.withColumn("group", rv.review_group("type", "source_path", "target_path", "issue_type"))
    return grouped.withColumn("group_label", choose(*[(F.col("group") == k, v) for k, v in rv.GROUPS.items()])).withColumn(
        "group_order", F.array_position(order, F.col("group"))
    )


def confidence_counts(plan: DataFrame) -> DataFrame:
    summary = rv.confidence_summary("type", "level", "target_path", "reason", "review.quality", "review.validated")
    rank = plan.select(summary["rank"].alias("rank"))
    return rank.agg(
        F.count_if(F.col("rank") == 1).alias("high"), F.count_if(F.col("rank") == 2).alias("moderate"),
        F.count_if(F.col("rank") == 3).alias("lower"), F.count_if(F.col("rank") == 0).alias("manual"),
    )


def free_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Final path of each file (path, op_id, target): the first comer gets its target if free, others name-2, name-3, ...

    Numbers already taken are left out. Counting uses a global sort, so that a name wanted by many is no bottleneck.
    """
    numbered = number_rows(wanted.select("path", "op_id", "target"), "target", "op_id", "path")
    first = numbered.groupBy("target").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("wanting"))
    present = existing.select(F.col("path").alias("target"), F.lit(1).alias("present")).distinct()
    # Existing files named like a numbered copy, by the name they are a copy of.
    split = "^(.*)-([0-9]+)(\\.[^./]*)?$"
    copies = existing.filter(F.regexp_like("path", F.lit(split))).select(
        F.concat(F.regexp_extract("path", split, 1), F.coalesce(F.regexp_extract("path", split, 3), F.lit(""))).alias("target"),
        F.regexp_extract("path", split, 2).try_cast("bigint").alias("number"),
    ).filter(F.col("number") >= 2)
    crowded = first.join(present, "target", "left").filter((F.col("wanting") > 1) | F.col("present").isNotNull())
    taken = copies.join(crowded.select("target"), "target", "left_semi").groupBy("target").agg(F.sort_array(F.collect_set("number")).alias("taken"))
    joined = numbered.join(first, "target").join(present, "target", "left").join(taken, "target", "left")
    place = F.col("position") - F.col("first") + F.when(F.col("present").isNotNull(), 1).otherwise(0)
    # The k-th free number: each taken number at or below it moves it up by one.
    numbers = F.coalesce("taken", F.array().cast("array<bigint>"))
    number = place + 1 + F.size(F.filter(F.transform(numbers, lambda n, i: n - i), lambda n: n <= place + 1))
    suffixed = F.concat(
        F.when(pt.parent("target") == "", "").otherwise(F.concat(pt.parent("target"), F.lit("/"))),
        pt.stem("target"), F.lit("-"), number.cast("string"), pt.dotted_extension("target"),
    )
    return joined.select("path", F.when(place == 0, F.col("target")).otherwise(suffixed).alias("final"))


def apply_plan(corpus: DataFrame, plan: DataFrame, approved: DataFrame, run_id: str, soft_delete: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Carry out the approved operations: (corpus after, trash, undo log).

    ``corpus(path, content)``, ``plan(op_id, ...)``, ``approved(op_id)``. Two files never end up under one path: later
    ones get a numbered name. Merged texts follow their target in operation order.
    """
    chosen = plan.join(approved.select("op_id").distinct(), "op_id", "left_semi")
    simple = chosen.filter(~((F.col("type") == "structural") & (F.col("issue_type") == "nestedFolders")))
    target = F.when(F.col("issue_type") == "repeatedExtension", F.regexp_replace("source_path", "(?i)(\\.md)+$", ".md")).otherwise(F.col("target_path"))
    action = choose(
        ((F.col("type") == "merge") & F.col("target_path").isNotNull(), "merge"),
        ((F.col("type") == "delete") | (F.col("issue_type") == "orphanedFile"), "delete"),
        (one_of(F.col("type"), ["move", "structural"]) & target.isNotNull(), "move"),
    )
    direct = simple.select("op_id", "type", "issue_type", "reason", F.col("source_path").alias("path"), target.alias("target"), action.alias("action"))
    nested = chosen.filter((F.col("type") == "structural") & (F.col("issue_type") == "nestedFolders")).select("op_id", "type", "issue_type", "reason", F.col("source_path").alias("folder"))
    recovered = corpus.select("path", pt.parent("path").alias("folder")).join(nested, "folder").select(
        "op_id", "type", "issue_type", "reason", "path", F.concat(F.lit("Recovered/"), pt.file_name("path")).alias("target"), F.lit("move").alias("action")
    )
    # The first operation on a file counts; the file is gone for later ones.
    fields = F.struct("type", "issue_type", "reason", "target", "action")
    steps = (
        direct.unionByName(recovered).filter(F.col("action").isNotNull())
        .groupBy("path").agg(F.min_by(fields, "op_id").alias("s"), F.min("op_id").alias("op_id"))
        .select("path", "op_id", "s.*")
        .join(corpus.select("path"), "path", "left_semi")
    )
    # A merge into a file that is itself leaving would lose text: it becomes a move of its own.
    leaving = steps.select(F.col("path").alias("target"), F.lit(True).alias("leaves"))
    merges = steps.filter(F.col("action") == "merge").join(leaving, "target", "left").join(
        corpus.select(F.col("path").alias("target"), F.lit(True).alias("there")), "target", "left"
    ).filter(F.col("leaves").isNull() & F.col("there").isNotNull()).select("path", "target", "op_id", "type", "issue_type", "reason", "action")
    moves = steps.filter(F.col("action") == "move")
    deletes = steps.filter(F.col("action") == "delete")
    done = moves.unionByName(deletes).unionByName(merges.select(*moves.columns))

    staying = corpus.join(done.select("path"), "path", "left_anti")
    finals = free_names(moves, staying.select("path"))
    moved = corpus.join(finals, "path").select(F.col("final").alias("path"), "content")
    texts = merges.join(corpus.select("path", "content"), "path").groupBy("target").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("op_id", "content"))), lambda m: m["content"]), MERGE_SEPARATOR).alias("added")
    )
    grown = staying.join(texts.withColumnRenamed("target", "path"), "path", "left").select(
        "path", F.concat_ws(MERGE_SEPARATOR, "content", "added").alias("content")
    )
    after = grown.unionByName(moved)

    gone = deletes.select("path", "op_id").unionByName(merges.select("path", "op_id"))
    safe = F.regexp_replace(pt.file_name("path"), "[^a-zA-Z0-9._-]", "-")
    bins = free_names(gone.withColumn("target", F.concat(F.lit(f"Trash/{run_id}/"), safe)), staying.select("path"))
    trash = bins.join(corpus, "path").select(F.col("final").alias("trash_path"), F.col("path").alias("source_path"), "content")
    if not soft_delete:
        trash = trash.limit(0)
    named = done.join(finals.withColumnRenamed("final", "moved_to"), "path", "left").join(
        trash.select(F.col("source_path").alias("path"), "trash_path"), "path", "left"
    )
    undo = named.select(
        "op_id", F.when(F.col("type") == "structural", F.concat_ws(":", "type", "issue_type")).otherwise(F.col("type")).alias("operation"),
        F.col("path").alias("source_path"), F.coalesce("moved_to", F.when(F.col("action") == "merge", F.col("target"))).alias("target_path"),
        "trash_path", "reason",
    )
    return after, trash, undo


def project_tree(paths: DataFrame, plan: DataFrame, approved: DataFrame) -> DataFrame:
    """Files as they would lie after the approved operations: (path, change_kind, source_path)."""
    clean = lambda c: trim(F.regexp_replace(pt.strip_notes_root(c), "^/+", ""))
    chosen = plan.join(approved.select("op_id").distinct(), "op_id", "left_semi").select(
        "op_id", "type", clean("source_path").alias("source"), clean(F.coalesce("target_path", F.lit(""))).alias("target")
    )
    current = paths.select(clean("path").alias("path")).filter(F.col("path") != "").distinct()
    moving = chosen.filter(one_of(F.col("type"), ["move", "structural"]) & (F.col("source") != "") & (F.col("target") != ""))
    removed = chosen.filter(one_of(F.col("type"), ["delete", "merge"])).select(F.col("source").alias("path")).unionByName(moving.select(F.col("source").alias("path")))
    arrived = moving.groupBy(F.col("target").alias("path")).agg(F.max_by("source", "op_id").alias("source_path"))
    arrived = arrived.withColumn("change_kind", rv.change_kind("source_path", "path"))
    left = current.join(removed, "path", "left_anti").join(arrived.select("path"), "path", "left_anti")
    merged = chosen.filter((F.col("type") == "merge") & (F.col("target") != "")).groupBy(F.col("target").alias("path")).agg(F.max_by("source", "op_id").alias("source_path"))
    kept = left.join(merged, "path", "left").select("path", "source_path", F.when(F.col("source_path").isNotNull(), "merge-target").alias("change_kind"))
    return kept.unionByName(arrived.select("path", "source_path", "change_kind"))
