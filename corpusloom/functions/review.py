"""How planned operations are shown for review: groups, clusters, confidence, tags and wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.columns import ColumnLike, choose, col, has_word, labels, one_of, trim
from corpusloom.functions.paths import file_name, parent, strip_notes_root

# Fixed values.
GROUPS = {
    "rename": "Rename Cleanup", "move": "Move Suggestions", "merge": "Merge Duplicates",
    "empty-folder": "Delete Empty Folders", "delete": "Delete Suggestions", "structural": "Structural Fixes",
}
EXTRACTED_KINDS = ["pdf", "docx", "pptx", "xlsx", "csv"]
UNCATEGORIZED = "root or uncategorized note|auto-fix uncategorized path"
LEARNED = "target folder approved|similar approved note patterns|similar top-level move approved"


def _says(reason: ColumnLike, phrases: str) -> Column:
    return F.regexp_like(F.lower(col(reason)), F.lit(phrases))


def _relative(path: ColumnLike) -> Column:
    return trim(F.regexp_replace(strip_notes_root(path), "^/+", ""))


def review_group(kind: ColumnLike, source: ColumnLike, target: ColumnLike, issue: ColumnLike) -> Column:
    same_folder = F.lower(parent(_relative(source))) == F.lower(parent(_relative(target)))
    return choose(
        ((col(kind) == "move") & F.coalesce(same_folder, F.lit(False)), "rename"),
        (col(kind) == "move", "move"), (col(kind) == "merge", "merge"),
        ((col(kind) == "delete") & (F.coalesce(col(issue), F.lit("")) == "emptyFolder"), "empty-folder"),
        (col(kind) == "delete", "delete"), otherwise="structural",
    )


def cluster_label(kind: ColumnLike, target: ColumnLike, issue: ColumnLike) -> Column:
    """Where an operation leads, or what it cleans up; null when neither can be said."""
    folder = F.nullif(parent(_relative(target)), F.lit(""))
    has_target = F.coalesce(col(target), F.lit("")) != ""
    return choose(
        (one_of(col(kind), ["move", "merge"]) & has_target, F.coalesce(folder, F.lit("Vault Root"))),
        ((col(kind) == "delete") & (F.coalesce(col(issue), F.lit("")) == "emptyFolder"), "Empty Folder Cleanup"),
        (col(kind) == "delete", "Delete Cleanup"),
        (col(kind) == "structural", F.coalesce(F.when(has_target, folder), F.lit("Structural Fixes"))),
    )


def change_kind(source: ColumnLike, target: ColumnLike) -> Column:
    moved = F.lower(parent(_relative(source))) != F.lower(parent(_relative(target)))
    renamed = F.lower(file_name(_relative(source))) != F.lower(file_name(_relative(target)))
    return choose((moved & renamed, "move-rename"), (moved, "move"), (renamed, "rename"))


def confidence_summary(kind: ColumnLike, level: ColumnLike, target: ColumnLike, reason: ColumnLike, quality: ColumnLike, validated: ColumnLike) -> Column:
    """Struct of label, detail and sort rank."""

    def tier(rank: int, label: str, detail: Column | str) -> Column:
        text = F.lit(detail) if isinstance(detail, str) else detail
        return F.struct(F.lit(label).alias("label"), text.alias("detail"), F.lit(rank).alias("rank"))

    passed = F.coalesce(col(validated), F.lit(False))
    weak, limited = F.coalesce(col(quality), F.lit("")) == "low", F.coalesce(col(quality), F.lit("")) == "medium"
    review = (col(kind) == "move") & F.coalesce(F.startswith(col(target), F.lit("Review/")), F.lit(False))
    lower = _says(reason, "low-confidence refinement") | weak | (col(level) == "optional")
    return choose(
        ((col(kind) == "merge") & passed, tier(1, "High confidence", "Strong duplicate or superseded-version signal passed validation.")),
        (review, tier(0, "Manual review", "There is enough risk to avoid organizing this file automatically.")),
        (
            lower,
            tier(
                3, "Lower confidence",
                F.when(weak, "This suggestion was softened because the extracted evidence was weak or noisy.").otherwise(
                    "This is a lighter refinement rather than one of the strongest suggestions."
                ),
            ),
        ),
        (
            limited | (col(level) == "recommended"),
            tier(
                2, "Moderate confidence",
                F.when(passed, "This suggestion passed validation, but it is still a moderate-confidence change.").otherwise(
                    "This suggestion looks useful, but it is not in the highest-confidence tier."
                ),
            ),
        ),
        otherwise=tier(
            1, "High confidence",
            F.when(passed, "This suggestion passed validation and is one of the stronger recommendations.").otherwise(
                "This is one of the stronger suggestions in the current review set."
            ),
        ),
    )


def review_tags(reason: ColumnLike, file_kind: Column, quality: Column, validated: Column, validation: Column, visual: Column, mode: Column, conservative: Column) -> Column:
    """At most four labels on why an operation is suggested and how far to trust it."""
    extracted = one_of(file_kind, EXTRACTED_KINDS)
    image = file_kind == "image"
    ocr = image & (F.coalesce(mode, F.lit("")) == "ocr")
    low, medium = F.coalesce(quality, F.lit("")) == "low", F.coalesce(quality, F.lit("")) == "medium"
    passed = F.coalesce(validated, F.lit(False))
    kept = [
        ("cleaner canonical file", "Cleaner Canonical File"), ("better organized file", "Better Organized File"),
        ("newer copy", "Newer Copy"), ("final version", "Final Version"), ("non-draft file", "Non-Draft File"),
        ("superseded by", "Superseded Version"),
    ]
    version = choose(*[(_says(reason, phrase), label) for phrase, label in kept])
    shown = {"scan": "Scanned Doc", "screenshot": "Screenshot", "diagram": "Diagram", "photo": "Photo"}
    tags = F.array_compact(
        F.array(
            F.when(_says(reason, UNCATEGORIZED), "Uncategorized Fix"),
            F.when(_says(reason, "matches existing vault category structure"), "Vault Pattern"),
            F.when(_says(reason, LEARNED), "Learned From Approvals"),
            F.when(_says(reason, "low-confidence refinement"), "Low Confidence"),
            F.when(passed, choose((validation == "duplicate", "Validated Duplicate"), (validation == "review", "Validated Review"), otherwise="Validated Move")),
            version,
            F.when(_says(reason, "flatten noisy copy/export container|shallow clutter folder"), "Clutter Cleanup"),
            choose((extracted & low, "Weak Extraction"), (extracted & medium, "Limited Extraction")),
            F.when(image, "Visual Asset"),
            F.when(image, choose(*[(visual == k, v) for k, v in shown.items()])),
            F.when(ocr, F.when(low, "Weak OCR").otherwise("OCR Read")),
            F.when(image & ~ocr & F.coalesce(conservative, F.lit(False)), "Path-Based"),
        )
    )
    return F.slice(tags, 1, 4)


def review_hint(file_kind: Column, quality: Column, quality_reason: Column, visual: Column, mode: Column) -> Column:
    """One sentence on how extraction quality shaped the suggestion; null when it did not."""
    why = F.nullif(trim(F.coalesce(quality_reason, F.lit(""))), F.lit(""))
    say = lambda text: F.coalesce(F.concat(text, F.lit(": "), why, F.lit(".")), F.concat(text, F.lit(".")))
    thing = choose((visual == "scan", "scanned image"), (one_of(visual, ["screenshot", "diagram", "photo"]), visual), otherwise="image")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    ocr = F.coalesce(mode, F.lit("")) == "ocr"
    extracted = one_of(file_kind, EXTRACTED_KINDS)
    upper = F.upper(file_kind)
    return choose(
        ((file_kind == "image") & ocr & (quality == "low"), say(join("Text was read by OCR from this ", thing, ", but it was weak or noisy"))),
        ((file_kind == "image") & ocr, say(join("Text read by OCR from this ", thing, " guided the suggestion"))),
        (file_kind == "image", say(join("This ", thing, " was treated conservatively using filename and folder clues only"))),
        (extracted & (quality == "low"), say(join("This stays conservative because extracted ", upper, " text was weak or noisy"))),
        (extracted & (quality == "medium"), say(join("This was softened because extracted ", upper, " text was usable but limited"))),
    )


def change_summary(source: ColumnLike, target: ColumnLike) -> Column:
    """Struct of folders and titles before and after, and which of them change; null without a target."""
    folder = lambda p: F.coalesce(F.nullif(parent(strip_notes_root(p)), F.lit("")), F.lit("Vault root"))
    name = lambda p: file_name(strip_notes_root(p))
    return F.when(
        (F.coalesce(col(target), F.lit("")) != "") & (col(source) != ""),
        F.struct(
            folder(source).alias("current_folder"), folder(target).alias("target_folder"),
            name(source).alias("current_title"), name(target).alias("target_title"),
            (F.lower(folder(source)) != F.lower(folder(target))).alias("folder_changed"),
            (F.lower(name(source)) != F.lower(name(target))).alias("title_changed"),
        ),
    )


def folder_evidence(reason: ColumnLike) -> Column:
    """Sentences on why a folder was suggested; never empty."""
    much, better = "target folder is a much stronger fit than the current location", "target folder is a better fit than the current location"
    found = labels(
        (_says(reason, UNCATEGORIZED), "Fixes a note that was still uncategorized or sitting in a generic location."),
        (_says(reason, "matches existing vault category structure"), "Keeps the note inside a folder pattern that already exists in your vault."),
        (_says(reason, LEARNED), "Matches folder choices you already approved for similar notes."),
        (_says(reason, much), "The suggested folder is a much stronger semantic fit than the current location."),
        (~_says(reason, much) & _says(reason, better), "The suggested folder fits this note better than the current location."),
    )
    default = F.array(F.lit("A cleaner organization path was found from the note content, title, and folder context."))
    return F.when(F.size(found) > 0, found).otherwise(default)


def narrative(kind: ColumnLike, target: ColumnLike, reason: ColumnLike) -> Column:
    """Sentences on why the other file is kept, or why a file needs review; null for other operations."""
    where = F.coalesce(strip_notes_root(target), F.lit("another file"))
    say = lambda a, b="": F.concat(F.lit(a), where, F.lit(b))
    pick = lambda *pairs: F.array_compact(F.array(*[F.when(c, t) for c, t in pairs]))
    merge = pick(
        (_says(reason, "cleaner canonical file"), say("The cleaner canonical file is kept at ", ".")),
        (_says(reason, "newer copy"), say("The newer copy is kept at ", ".")),
        (_says(reason, "final version"), F.lit("The final version is kept over the draft-like version here.")),
        (_says(reason, "non-draft file"), F.lit("The non-draft file is kept over the draft variant.")),
        (_says(reason, "superseded by"), say("This file appears to be superseded by ", ".")),
    )
    review = labels(
        (has_word(reason, "unreadable|unsupported|failed|corrupt|broken"), "There is a real quality problem that needs manual review."),
        (has_word(reason, "empty|blank"), "The file looks empty or effectively blank, so an automatic placement is not trusted."),
        (has_word(reason, "junk|garbage|temporary|temp"), "The file looks like low-value clutter and may need manual cleanup."),
    )
    or_else = lambda items, default: F.when(F.size(items) > 0, items).otherwise(F.array(default))
    return choose(
        (col(kind) == "merge", or_else(merge, say("Strong overlap with ", " suggests that these be merged or consolidated."))),
        (
            (col(kind) == "move") & F.startswith(col(target), F.lit("Review/")),
            or_else(review, F.lit("There is enough risk to avoid organizing this file automatically.")),
        ),
    )
