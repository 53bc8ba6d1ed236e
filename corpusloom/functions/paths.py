"""Path projections and scope predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.columns import ColumnLike, choose, col, let, non_empty, one_of, trim

# File name extensions and reserved names.
TEXT_EXTENSIONS = ["md", "markdown", "mdx", "txt", "text", "rst", "org", "adoc", "asciidoc"]
DOCUMENT_EXTENSIONS = ["pdf", "docx", "pptx", "xlsx", "csv"]
VISUAL_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "heic", "svg"]
BINARY_EXTENSIONS = [
    "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "odt", "ods", "odp",
    "png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "heic", "svg",
    "mp3", "wav", "m4a", "aac", "flac", "mp4", "mov", "mkv", "avi",
    "zip", "rar", "7z", "gz", "tar",
]
INTERNAL_NAMES = ["index.json", "embeddings.json", ".index.json", ".embeddings.json"]
ANALYSIS_INTERNAL_NAMES = ["index.json", "embeddings.json"]
SYSTEM_FOLDER = ".vn-system"
UNCATEGORIZED_FOLDERS = ["untitled", "notes", "misc", "general", "tmp", "temp"]
OCR_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "heic", "tiff", "tif", "svg"]
IMAGE_SOURCE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "heic"]
SOURCE_LABELS = {
    "pdf": "PDF document",
    "docx": "DOCX document",
    "pptx": "PPTX presentation",
    "xlsx": "XLSX spreadsheet",
    "csv": "CSV data file",
}


def normalize_path(path: ColumnLike) -> Column:
    return F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), "^/+", "")


def strip_notes_root(path: ColumnLike) -> Column:
    return F.regexp_replace(col(path), "(?i)^notes/", "")


def segments(path: ColumnLike) -> Column:
    return non_empty(F.split(col(path), "/"))


def file_name(path: ColumnLike) -> Column:
    last = F.substring_index(col(path), "/", -1)
    return F.when(last == "", col(path)).otherwise(last)


def lower_extension(path: ColumnLike) -> Column:
    name = F.lower(file_name(path))
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")


def dotted_extension(path: ColumnLike) -> Column:
    """Extension with its dot; a leading dot starts a name, not an extension."""
    return F.regexp_extract(file_name(path), "^.+(\\.[^.]*)$", 1)


def drop_extension(name: ColumnLike) -> Column:
    return F.regexp_replace(col(name), "^(.+)\\.[^.]*$", "$1")


def stem(path: ColumnLike) -> Column:
    return drop_extension(file_name(path))


def parent(path: ColumnLike) -> Column:
    return F.regexp_extract(col(path), "^(.*)/[^/]*$", 1)


def top_level(path: ColumnLike) -> Column:
    return F.substring_index(col(path), "/", 1)


def second_level(path: ColumnLike) -> Column:
    return F.coalesce(F.get(F.split(col(path), "/"), F.lit(1)), F.lit(""))


def folder_depth(path: ColumnLike) -> Column:
    return F.greatest(F.size(segments(path)) - 1, F.lit(0))


def _scoped(path: ColumnLike) -> Column:
    return F.regexp_replace(F.lower(trim(normalize_path(path))), "^notes/", "")


def _in_scope(scoped: Column, include_trash: bool, include_system: bool) -> Column:
    keep = (scoped != "") & ~one_of(file_name(scoped), INTERNAL_NAMES)
    if not include_trash:
        keep &= ~F.startswith(scoped, F.lit("trash/"))
    # A dot segment hides the file; the system folder is let through on request, as first segment only.
    visible = F.regexp_replace(scoped, "^\\.vn-system(/|$)", "") if include_system else scoped
    return keep & ~F.regexp_like(visible, F.lit("(^|/)\\."))


def _scope(path: ColumnLike, rule, include_trash: bool, include_system: bool) -> Column:
    return let(
        _scoped(path),
        lambda scoped: _in_scope(scoped, include_trash, include_system) & rule(lower_extension(scoped)),
    )


def is_indexable(path: ColumnLike, include_trash: bool = False, include_system: bool = False) -> Column:
    return _scope(path, lambda ext: one_of(ext, ["", *TEXT_EXTENSIONS]), include_trash, include_system)


def is_document_readable(path: ColumnLike, include_trash: bool = False, include_system: bool = False) -> Column:
    allowed = ["", *TEXT_EXTENSIONS, *DOCUMENT_EXTENSIONS]
    return _scope(path, lambda ext: one_of(ext, allowed), include_trash, include_system)


def is_visual(path: ColumnLike, include_trash: bool = False, include_system: bool = False) -> Column:
    return _scope(path, lambda ext: one_of(ext, VISUAL_EXTENSIONS), include_trash, include_system)


def is_reorganizable(path: ColumnLike, include_trash: bool = False, include_system: bool = False) -> Column:
    """Readable or visual; the same test decides whether a path may be retrieved."""
    allowed = ["", *TEXT_EXTENSIONS, *DOCUMENT_EXTENSIONS, *VISUAL_EXTENSIONS]
    return _scope(path, lambda ext: one_of(ext, allowed), include_trash, include_system)


is_retrievable = is_reorganizable


def is_skipped_by_analysis(path: ColumnLike) -> Column:
    relative = strip_notes_root(normalize_path(path))
    return (
        one_of(file_name(relative), ANALYSIS_INTERNAL_NAMES)
        | (lower_extension(relative) == "base")
        | F.regexp_like(relative, F.lit("^(Trash|Recovered|\\.vn-system)/"))
    )


def looks_uncategorized(path: ColumnLike) -> Column:
    return let(
        segments(strip_notes_root(path)),
        lambda parts: (F.size(parts) <= 1)
        | one_of(F.lower(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))), UNCATEGORIZED_FOLDERS),
    )


def document_kind(extension: ColumnLike) -> Column:
    ext = F.lower(col(extension))
    return choose(
        (one_of(ext, DOCUMENT_EXTENSIONS), ext), (one_of(ext, OCR_EXTENSIONS), "image"), otherwise="text"
    )


def source_label(path: ColumnLike, read_by_ocr: Column | bool = False) -> Column:
    name = F.substring_index(col(path), "/", -1)
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    image = one_of(ext, IMAGE_SOURCE_EXTENSIONS)
    ocr = read_by_ocr if isinstance(read_by_ocr, Column) else F.lit(read_by_ocr)
    fixed = [(ext == extension, label) for extension, label in SOURCE_LABELS.items()]
    return choose((image & ocr, "OCR image source"), *fixed, (image, "Image file"), otherwise="Note file")


def candidate_paths(path: ColumnLike) -> Column:
    """The spellings under which a path may be stored: with and without the notes root."""
    return let(
        normalize_path(path),
        lambda p: F.array_distinct(
            non_empty(
                F.array(
                    p,
                    F.when(F.startswith(p, F.lit("notes/")), F.regexp_replace(p, "^(notes/)+", "")).otherwise(
                        F.concat(F.lit("notes/"), p)
                    ),
                )
            )
        ),
    )


def clean_segment(segment: ColumnLike) -> Column:
    return trim(F.regexp_replace(col(segment), '[/\\\\:*?"<>|]', "-"))


def title_of(path: ColumnLike) -> Column:
    """File name without extension, made safe as a path segment; never empty."""
    cleaned = clean_segment(F.regexp_replace(F.substring_index(col(path), "/", -1), "\\.[^/.]+$", ""))
    return F.when(cleaned == "", "Note").otherwise(cleaned)


def has_generic_title(path: ColumnLike) -> Column:
    return F.regexp_like(title_of(path), F.lit("(?i)^(untitled|note|new note|(untitled|note) .*)$"))


def is_structured(path: ColumnLike) -> Column:
    relative = strip_notes_root(normalize_path(path))
    depth = F.size(segments(relative))
    return (depth >= 2) & ~looks_uncategorized(relative) & ((depth >= 3) | ~has_generic_title(relative))


# Words in a file name that point to a folder, in order of precedence.
NAME_FOLDERS = [
    ("interview|resume|job|career", "Career/Interview Prep"),
    ("research|analysis|report|competitive", "Work/Research"),
    ("prompt", "Resources/AI Prompts"),
    ("meeting|script", "Work/Meetings"),
    ("health|routine|skincare", "Personal/Health"),
    ("tip|question|command", "Learning/Notes"),
]


def suggest_path_from_name(path: ColumnLike) -> Column:
    relative = strip_notes_root(path)
    name = F.substring_index(relative, "/", -1)
    name = F.when(name == "", "Note.md").otherwise(name)
    folder = choose(
        *[(F.regexp_like(F.lower(name), F.lit(words)), target) for words, target in NAME_FOLDERS],
        otherwise="Unsorted",
    )
    return F.concat_ws("/", folder, name)


def _strip_repeated(name: Column, extension: Column) -> Column:
    """Remove the extension from the end as often as it occurs, ignoring case."""
    width = F.length(extension)
    times = F.sequence(F.lit(0), F.floor(F.length(name) / F.greatest(width, F.lit(1))).cast("int"))
    return F.aggregate(
        times,
        name,
        lambda acc, _: F.when(
            (width > 0) & F.endswith(F.lower(acc), F.lower(extension)), F.left(acc, F.length(acc) - width)
        ).otherwise(acc),
    )


def normalize_suggested_path(suggested: ColumnLike, source: ColumnLike) -> Column:
    """A suggested relative path with at least a folder and a name, and the source's extension once."""
    source_name = file_name(strip_notes_root(source))
    extension = dotted_extension(source_name)
    base = drop_extension(source_name)
    cleaned = F.regexp_replace(
        normalize_path(trim(F.coalesce(col(suggested), F.lit("")))), "(?i)^(notes/)+", ""
    )
    parts = non_empty(F.transform(F.split(cleaned, "/"), trim))

    def assemble(p: Column) -> Column:
        folders = F.when(F.size(p) >= 2, F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(1)))).otherwise(
            F.array(F.lit("Unsorted"))
        )
        last = F.coalesce(F.get(p, F.size(p) - 1), F.when(base == "", "Note").otherwise(base))
        kept = F.when(
            F.endswith(F.lower(last), F.lower(extension)), drop_extension(_strip_repeated(last, extension))
        ).otherwise(drop_extension(last))
        return F.concat_ws("/", F.array_join(folders, "/"), F.concat(kept, extension))

    return let(parts, assemble)


def suggestion_level(current: ColumnLike, target: ColumnLike) -> Column:
    """How strongly a move from ``current`` to ``target`` is suggested."""

    def level(here: Column, there: Column) -> Column:
        same_top = F.coalesce(F.get(here, F.lit(0)), F.lit("")) == F.coalesce(F.get(there, F.lit(0)), F.lit(""))
        deep = (F.size(here) >= 3) & (F.size(there) >= 3)
        level_depth = F.size(here) == F.size(there)
        return F.when((here == there) | (same_top & (deep | level_depth)), "optional").otherwise("recommended")

    return F.when(looks_uncategorized(current), "strong").otherwise(
        let(
            segments(F.lower(col(current))),
            lambda here: let(segments(F.lower(col(target))), lambda there: level(here, there)),
        )
    )


def relative_path(source: ColumnLike, target: ColumnLike) -> Column:
    """``target`` as seen from the folder of ``source``, with ``..`` segments."""

    def build(here: Column, there: Column) -> Column:
        differs = F.filter(
            F.sequence(F.lit(0), F.size(here)),
            lambda i: (i >= F.size(here)) | (i >= F.size(there)) | (F.get(here, i) != F.get(there, i)),
        )
        shared = F.array_min(differs)
        up = F.array_repeat(F.lit(".."), F.size(here) - shared)
        down = F.slice(there, shared + 1, F.size(there))
        joined = F.array_join(F.concat(up, down), "/")
        return F.when(joined == "", F.get(there, F.size(there) - 1)).otherwise(joined)

    return let(
        segments(parent(normalize_path(source))),
        lambda here: let(segments(normalize_path(target)), lambda there: build(here, there)),
    )
