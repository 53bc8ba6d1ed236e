"""Columns that decide whether two files are versions of each other, and which one to keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.columns import WORD_END, WORD_START, WS, ColumnLike, choose, col, has_word, let, matches, one_of, squeeze
from corpusloom.functions.paths import folder_depth

# Marks of copies, exports and scans in a file name.
NOISE_PATTERNS = [
    f"(?i){WORD_START}copy{WORD_END}",
    f"(?i){WORD_START}final{WORD_END}",
    f"(?i){WORD_START}export{WORD_END}",
    f"(?i){WORD_START}scan(?:ned)?[0-9]*{WORD_END}",
    f"(?i){WORD_START}img[_ -]?[0-9]+{WORD_END}",
    "\\([0-9]+\\)",
    f"(?i)[_ -]v[0-9]+{WORD_END}",
    f"[_ -][0-9]{{4}}[-_][0-9]{{2}}[-_][0-9]{{2}}{WORD_END}",
]
DOCUMENT_ROLES = ["text-note", "guide", "proposal", "general-document"]
MIN_CONTENT = 20
NEAR_NOISY = 0.55
NEAR = 0.74
LENGTH_RATIO = 0.72
SUPERSEDED = 0.78
COVERAGE = 0.88


def bare_name(path: ColumnLike) -> Column:
    return F.regexp_replace(F.substring_index(col(path), "/", -1), "\\.[^/.]+$", "")


def normalize_for_dedup(content: ColumnLike) -> Column:
    text = F.regexp_replace(F.replace(col(content), F.lit("\r\n"), F.lit("\n")), "[\\u200B-\\u200D\\uFEFF]", "")
    return F.lower(squeeze(F.regexp_replace(text, "(?m)^\\s*[-*_]{3,}\\s*$", "")))


def word_set(text: ColumnLike) -> Column:
    """Distinct words of more than two characters."""
    return F.array_distinct(matches(F.lower(col(text)), "[a-z0-9]{3,}"))


def noise_score(path: ColumnLike) -> Column:
    """How many marks of copies and exports the file name carries."""
    name = bare_name(path)
    total = F.lit(0)
    for pattern in NOISE_PATTERNS:
        total = total + F.regexp_count(name, F.lit(pattern))
    return total


def normalized_stem(path: ColumnLike) -> Column:
    """File name without version marks, as space-joined words; the blocking key of near duplicates."""
    name = F.regexp_replace(F.regexp_replace(bare_name(path), "([a-z])([A-Z])", "$1 $2"), "[._-]+", " ")
    for pattern in [*NOISE_PATTERNS, f"(?i){WORD_START}draft{WORD_END}"]:
        name = F.regexp_replace(name, pattern, " ")
    spaced = F.regexp_replace(F.lower(name), f"[^a-z0-9{WS[1:-1]}]", " ")
    return F.array_join(F.filter(F.split(spaced, WS + "+"), lambda t: F.length(t) > 2), " ")


def draft_state(path: ColumnLike) -> Column:
    name = bare_name(path)
    return choose((has_word(name, "draft"), "draft"), (has_word(name, "final"), "final"), otherwise="plain")


def version_quality(path: ColumnLike) -> Column:
    name = bare_name(path)
    draft, final, copy = has_word(name, "draft"), has_word(name, "final"), has_word(name, "copy")
    return choose((draft & ~final, F.lit(-2)), (final & ~draft & ~copy, F.lit(1)), otherwise=F.lit(0))


def preference_key(path: ColumnLike, modified_at: Column | None = None) -> Column:
    """Sortable struct; the smaller key is the file to keep. A missing modification time counts as oldest."""
    age = F.lit(0).cast("bigint") if modified_at is None else F.coalesce(-F.unix_micros(modified_at), F.lit(2**62))
    return F.struct(
        (draft_state(path) == "draft").cast("int").alias("draft"),
        noise_score(path).alias("noise"),
        (-F.least(folder_depth(path), F.lit(4))).alias("shallow"),
        (-version_quality(path)).alias("version"),
        age.alias("age"),
        F.length(col(path)).alias("length"),
        col(path).alias("path"),
    )


def preference_reason(kept: Column, other: Column, kept_state: Column) -> Column:
    """The first criterion in which the kept file's key beats the other's."""
    return choose(
        ((kept["draft"] != other["draft"]) & (kept_state == "final"), "final-version"),
        (kept["draft"] != other["draft"], "non-draft"),
        (kept["noise"] != other["noise"], "cleaner-canonical"),
        (kept["shallow"] != other["shallow"], "better-organized"),
        (kept["version"] != other["version"], F.when(kept["version"] == -1, "final-version").otherwise("shorter-path")),
        (kept["age"] != other["age"], "newer-copy"),
        otherwise="shorter-path",
    )


REASON_WORDS = {
    "cleaner-canonical": "cleaner canonical file ",
    "better-organized": "better organized file ",
    "final-version": "final version ",
    "non-draft": "non-draft file ",
    "newer-copy": "newer copy ",
}


def reason_text(base: ColumnLike, target: ColumnLike, why: ColumnLike) -> Column:
    words = choose(*[(col(why) == key, text) for key, text in REASON_WORDS.items()], otherwise="")
    lead = F.lit(base) if isinstance(base, str) else base
    return F.concat(lead, F.lit(" "), words, col(target))


def jaccard(a: ColumnLike, b: ColumnLike) -> Column:
    """Share of common members of two sets; 0 if either is empty."""
    left, right = col(a), col(b)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(
        let(
            F.size(F.array_intersect(left, right)),
            lambda common: common / (F.size(left) + F.size(right) - common),
        )
    )


def coverage(part: ColumnLike, whole: ColumnLike) -> Column:
    """Share of ``part`` found in ``whole``; 0 if either is empty."""
    left, right = col(part), col(whole)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(left)
    )


def role_class(role: ColumnLike) -> Column:
    """Roles whose files may be versions of each other share a class; an unknown role is null and fits all."""
    return F.when(one_of(col(role), DOCUMENT_ROLES), "document-like").otherwise(col(role))


def roles_compatible(a: ColumnLike, b: ColumnLike) -> Column:
    return role_class(a).isNull() | role_class(b).isNull() | (role_class(a) == role_class(b))


def is_noisy_name(path: ColumnLike) -> Column:
    return noise_score(path) > 0
