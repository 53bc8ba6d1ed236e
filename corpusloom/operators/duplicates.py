"""Exact and near duplicates over a whole corpus, with the file to keep.

Files are weighed in preference order: a file is flagged when it matches a better file that is itself not flagged.
Exact copies are grouped by content hash, which is linear however many copies there are. Near copies share a
normalized file name; they are first compared with the best file of their name, which settles large groups of
copies in linear time, and what remains is joined on its rarest words (prefix filtering, exact for the threshold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import duplicates as du
from corpusloom.functions.paths import parent
from corpusloom.session import cut_lineage

PIVOT_PASSES = 2


def duplicate_profile(documents: DataFrame) -> DataFrame:
    """What duplicate detection needs of each document: (path, content[, file_role][, modified_at])."""
    role = F.col("file_role") if "file_role" in documents.columns else F.lit(None).cast("string")
    modified = F.col("modified_at") if "modified_at" in documents.columns else None
    return (
        documents.select(
            "path", role.alias("file_role"), du.normalize_for_dedup("content").alias("normalized"),
            du.preference_key("path", modified).alias("key"), du.draft_state("path").alias("state"),
            du.normalized_stem("path").alias("stem"), F.lower(parent("path")).alias("folder"),
        )
        .filter(F.length("normalized") >= du.MIN_CONTENT)
        .withColumn("role", du.role_class("file_role"))
        .withColumn("hash", F.sha2("normalized", 256))
    )


def exact_duplicates(profile: DataFrame) -> DataFrame:
    """Copies of equal normalized content and compatible role, each with the best copy as its target."""
    # Grouped and joined again: the texts are normalized once, for what identifies them.
    profile = cut_lineage(profile.select("path", "key", "state", "hash", "role"))
    kept = F.struct("key", "state")
    best = profile.groupBy("hash", "role").agg(F.min(kept).alias("best"), F.count(F.lit(1)).alias("n"))
    # At most one row for each role, so the list of a content is short however often it is copied.
    choices = best.groupBy("hash").agg(F.sum("n").alias("n"), F.collect_list(F.struct("role", "best")).alias("choices"))
    choices = choices.filter(F.col("n") > 1)
    fits = lambda c: F.col("role").isNull() | c["role"].isNull() | (c["role"] == F.col("role"))
    target = F.array_min(F.transform(F.filter("choices", fits), lambda c: c["best"]))
    joined = profile.join(choices.select("hash", "choices"), "hash").withColumn("best", target)
    why = du.preference_reason(F.col("best.key"), F.col("key"), F.col("best.state"))
    return joined.filter(F.col("best.key.path") != F.col("path")).select(
        "path", F.lit("exact-delete").alias("kind"), F.col("best.key.path").alias("target"),
        du.reason_text("Exact duplicate of", F.col("best.key.path"), why).alias("reason"),
    )


def _near(x: str, y: str) -> Column:
    """Whether two profiles with word sets, aliased x and y, are near copies of one another."""
    c = lambda side, name: F.col(f"{side}.{name}")
    same_folder = c(x, "folder") == c(y, "folder")
    noisy = (c(x, "key.noise") > 0) | (c(y, "key.noise") > 0)
    threshold = F.when(same_folder & noisy, du.NEAR_NOISY).otherwise(du.NEAR)
    return (
        (c(x, "hash") != c(y, "hash"))
        & (c(x, "role").isNull() | c(y, "role").isNull() | (c(x, "role") == c(y, "role")))
        & (same_folder | noisy)
        & (length_ratio(x, y) >= du.LENGTH_RATIO)
        & (F.round(du.jaccard(c(x, "words"), c(y, "words")), 9) >= threshold)
    )


def length_ratio(x: str, y: str) -> Column:
    a, b = F.length(F.col(f"{x}.normalized")), F.length(F.col(f"{y}.normalized"))
    return F.least(a, b) / F.greatest(a, b)


def _of_shared_stem(profile: DataFrame) -> DataFrame:
    """Profiles, with or without their texts, that share their stem with another one."""
    shared = profile.filter(F.col("stem") != "").groupBy("stem").count().filter(F.col("count") > 1).select("stem")
    return profile.join(shared, "stem", "left_semi")


def near_candidates(profile: DataFrame) -> DataFrame:
    """Profiles that share their stem with another one, with their word sets."""
    return _of_shared_stem(profile).withColumn("words", du.word_set("normalized"))


def _rare_word_pairs(candidates: DataFrame) -> DataFrame:
    """Pairs (path, other) of one stem, ``other`` the better, that share one of their rarest words.

    Sets of Jaccard similarity t share a word among the first n - ceil(t n) + 1 of each, in any common order. Rarest
    first makes such meetings rare for unrelated files.
    """
    slim = candidates.select("stem", "path", "key", F.size("words").alias("n"), F.length("normalized").alias("chars"), "words")
    words = slim.select("stem", "path", "n", F.explode("words").alias("word"))
    frequency = words.groupBy("stem", "word").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") > 1)
    ranked = (
        words.join(frequency, ["stem", "word"], "left")
        .groupBy("stem", "path", "n")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "word"))).alias("by_rarity"))
    )
    length = F.col("n") - F.ceil(F.col("n") * du.NEAR_NOISY).cast("int") + 1
    prefix = ranked.select("stem", "path", F.explode(F.slice("by_rarity", 1, length)).alias("w")).filter(F.col("w.f") > 1)
    sized = slim.select("path", "key", "n", "chars")
    side = prefix.select("stem", "path", F.col("w.word").alias("word")).join(sized, "path")
    x, y = side.alias("x"), side.alias("y")
    fits = (
        (F.col("y.key") < F.col("x.key"))
        & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * du.NEAR_NOISY)
        & (F.least("x.chars", "y.chars") >= F.greatest("x.chars", "y.chars") * du.LENGTH_RATIO)
    )
    met = x.join(y, (F.col("x.stem") == F.col("y.stem")) & (F.col("x.word") == F.col("y.word")) & fits)
    return met.select(F.col("x.path").alias("path"), F.col("y.path").alias("other")).distinct()


def near_pairs(candidates: DataFrame) -> DataFrame:
    """All pairs (path, other) of near copies of one stem, ``other`` the better one."""
    better = candidates.select(F.col("path").alias("other"), F.struct("*").alias("y"))
    joined = (
        _rare_word_pairs(candidates)
        .join(candidates.select("path", F.struct("*").alias("x")), "path")
        .select("other", "x")
        .join(better, "other")
        .select("x", "y")
    )
    return joined.filter(_near("x", "y"))


def _flag(joined: DataFrame) -> DataFrame:
    """Matched rows of (x, y) as result rows: x is superseded by y, or should be merged into it."""
    why = du.preference_reason(F.col("y.key"), F.col("x.key"), F.col("y.state"))
    similarity = F.round(du.jaccard("x.words", "y.words"), 9)
    contained = F.contains(F.col("y.normalized"), F.col("x.normalized"))
    covered = (F.round(du.coverage("x.words", "y.words"), 9) >= du.COVERAGE) | contained
    superseded = (F.col("why") != "shorter-path") & (similarity >= du.SUPERSEDED) & covered
    return joined.withColumn("why", why).select(
        F.col("x.path").alias("path"),
        F.when(superseded, "superseded-delete").otherwise("merge-recommended").alias("kind"),
        F.col("y.path").alias("target"),
        F.when(superseded, du.reason_text("Superseded by", "y.path", "why"))
        .otherwise(du.reason_text("Probable duplicate revision of", "y.path", "why")).alias("reason"),
    )


def near_duplicates(profile: DataFrame) -> DataFrame:
    """Near copies, each with the best unflagged match. Give it profiles without exact copies."""
    return _near_copies(cut_lineage(near_candidates(profile)))


def _near_copies(open_files: DataFrame) -> DataFrame:
    done = None
    for _ in range(PIVOT_PASSES):
        # The best open file of a stem has no better match, so it stays; whatever is near it is settled.
        pivots = open_files.groupBy("stem").agg(F.min("key").alias("key")).select(F.col("key.path").alias("path"))
        x = open_files.select("stem", F.struct("*").alias("x"))
        y = open_files.join(pivots, "path", "left_semi").select("stem", F.struct("*").alias("y"))
        settled = cut_lineage(_flag(x.join(y, "stem").filter((F.col("x.path") != F.col("y.path")) & _near("x", "y"))))
        done = settled if done is None else done.unionByName(settled)
        open_files = open_files.join(settled.select("path"), "path", "left_anti").join(pivots, "path", "left_anti")
    edges = cut_lineage(near_pairs(open_files))
    while not edges.isEmpty():
        # Files that are nobody's worse half stay; files next to them are settled; the rest goes another round.
        worse = edges.select(F.col("x.path").alias("path")).distinct()
        to_kept = edges.withColumn("path", F.col("y.path")).join(worse, "path", "left_anti")
        best = Window.partitionBy("x.path").orderBy("y.key")
        settled = cut_lineage(
            _flag(to_kept.withColumn("n", F.row_number().over(best)).filter(F.col("n") == 1))
        )
        done = done.unionByName(settled)
        gone = settled.select("path")
        edges = cut_lineage(
            edges.withColumn("path", F.col("x.path")).join(gone, "path", "left_anti")
            .withColumn("path", F.col("y.path")).join(gone, "path", "left_anti").select("x", "y")
        )
    return done


def detect_duplicates(documents: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Every file to delete or merge, with its target and reason.

    ``roles(path, file_role)`` may come by themselves; then only files in it take part. All texts are normalized once, for
    what identifies them; only texts that may be near copies are read again.
    """
    profile = duplicate_profile(documents)
    slim = profile.drop("normalized")
    if roles is not None:
        known = roles.select("path", du.role_class("file_role").alias("role"))
        slim = slim.drop("role").join(known, "path")
    slim = cut_lineage(slim)
    exact = cut_lineage(exact_duplicates(slim))
    open_files = cut_lineage(_of_shared_stem(slim.join(exact.select("path"), "path", "left_anti")).select("path", "role"))
    texts = duplicate_profile(documents.join(open_files, "path", "left_semi"))
    if roles is not None:
        texts = texts.drop("role").join(open_files.distinct(), "path")
    return exact.unionByName(_near_copies(cut_lineage(texts.withColumn("words", du.word_set("normalized")))))
