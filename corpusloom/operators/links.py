"""Links between documents: extraction, resolution, repair, mentions, suggestions and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.columns import WORD_END, WORD_START, choose, matches, trim
from corpusloom.functions.paths import file_name, normalize_path, parent, relative_path, strip_notes_root
from corpusloom.operators.positions import number_rows
from corpusloom.session import stored

# Link syntax, and the extensions a link may leave out, in order of precedence.
WIKI_LINK = "\\[\\[([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]"
MARKDOWN_LINK = "(!?\\[[^\\]]*\\])\\(([^)]+)\\)"
LINK_EXTENSIONS = [
    ".md", ".markdown", ".txt", ".mdx", ".pdf", ".docx", ".pptx", ".xlsx", ".csv", ".doc",
    ".png", ".jpg", ".jpeg", ".svg", ".webp",
]
AMBIGUOUS_SHOWN = 8
BACKLINKS = 20
LINK_SUGGESTIONS = 3


def extract_links(documents: DataFrame) -> DataFrame:
    """One row for each wiki or markdown link: (path, kind, full, target, label, nth).

    A text is gone through once for each kind; target and label are taken from the link itself.
    """
    part = lambda link, pattern, group: F.regexp_extract(link, pattern, group)
    found = lambda kind, pattern, target, label: F.transform(
        matches("content", pattern, 0),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), m.alias("full"), part(m, pattern, target).alias("target"), part(m, pattern, label).alias("label")
        ),
    )
    both = F.concat(found("wiki", WIKI_LINK, 1, 2), found("markdown", MARKDOWN_LINK, 2, 1))
    outside = F.regexp_like("target", F.lit("(?i)^https?://")) | F.startswith("target", F.lit("#"))
    return (
        documents.select("path", F.explode(both).alias("l"))
        .select("path", "l.kind", "l.nth", "l.full", trim("l.target").alias("target"), trim("l.label").alias("label"))
        .filter((F.col("target") != "") & ((F.col("kind") == "wiki") | ~outside))
    )


def split_wiki_target(target: Column, alias: Column) -> Column:
    """Target without its anchor, and the label shown: the alias, else the target as written."""
    return F.struct(
        trim(F.substring_index(target, "#", 1)).alias("target"),
        F.when(trim(alias) == "", trim(target)).otherwise(trim(alias)).alias("label"),
    )


def _title(path: Column) -> Column:
    return F.lower(F.regexp_replace(file_name(path), "\\.[^.]+$", ""))


def resolve_targets(targets: DataFrame, paths: DataFrame, strip_anchor: bool = True) -> DataFrame:
    """Resolution of each distinct target: (target, resolved, reason, candidates, n_candidates).

    Each target is looked up under its candidate spellings by an equi-join, then by title. Only distinct targets
    travel, so a link that occurs everywhere costs as much as any other.
    """
    files = paths.select(normalize_path("path").alias("file")).distinct()
    raw = F.regexp_replace(F.col("target"), "#.*$", "") if strip_anchor else F.col("target")
    wanted = targets.select("target").distinct().withColumn(
        "normalized", trim(F.regexp_replace(normalize_path(raw), "^\\./", ""))
    )
    stem = F.regexp_replace("normalized", "\\.[^.]+$", "")
    keys = F.array(F.col("normalized"), stem, *[F.concat(stem, F.lit(e)) for e in LINK_EXTENSIONS])
    spelled = wanted.filter(F.col("normalized") != "").select("target", F.posexplode(F.transform(keys, F.lower)).alias("rank", "spelling"))
    by_path = files.groupBy(F.lower("file").alias("spelling")).agg(F.max("file").alias("file"))
    exact = spelled.join(by_path, "spelling").groupBy("target").agg(F.min_by("file", "rank").alias("exact"))
    titled = files.select("file", _title(F.col("file")).alias("title"))
    order = Window.partitionBy("title").orderBy("file")
    shown = (
        titled.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= AMBIGUOUS_SHOWN)
        .groupBy("title")
        .agg(F.sort_array(F.collect_list("file")).alias("files"))
    )
    by_title = shown.join(titled.groupBy("title").agg(F.count(F.lit(1)).alias("n")), "title")
    joined = wanted.join(exact, "target", "left").withColumn("title", _title(F.col("normalized"))).join(by_title, "title", "left")
    missing = (F.col("normalized") == "") | F.col("n").isNull()
    reason = choose(
        (F.col("exact").isNotNull(), "exact"), (missing, "missing"), (F.col("n") == 1, "title"), otherwise="ambiguous"
    )
    only = F.get("files", F.lit(0))
    none = F.array().cast("array<string>")
    return joined.withColumn("reason", reason).select(
        "target",
        choose((F.col("reason") == "exact", F.col("exact")), (F.col("reason") == "title", only)).alias("resolved"),
        "reason",
        choose((F.col("reason") == "exact", F.array("exact")), (F.col("reason") == "missing", none), otherwise=F.col("files")).alias("candidates"),
    )


def broken_references(documents: DataFrame, paths: DataFrame, strip_anchor: bool = True) -> DataFrame:
    """Links that lead nowhere or to several documents."""
    links = stored(extract_links(documents))  # read again for the distinct targets
    resolved = resolve_targets(links, paths, strip_anchor)
    return links.join(resolved.filter(F.col("resolved").isNull()), "target").select(
        "path", "kind", "nth", "target", "reason", "candidates"
    )


def _replace_all(documents: DataFrame, replacements: DataFrame) -> DataFrame:
    """Documents with literal replacements (path, full, new) of links carried out; others are left out.

    A document tries its own links only: where many documents have one path, they share its list.
    """
    lists = replacements.groupBy("path").agg(
        F.map_from_entries(F.collect_set(F.struct("full", "new"))).alias("swaps"), F.sum("times").alias("replaced")
    )
    own = F.array_sort(F.array_distinct(F.concat(matches("content", WIKI_LINK, 0), matches("content", MARKDOWN_LINK, 0))))
    swapped = lambda text, full: F.replace(text, full, F.try_element_at("swaps", full))
    return documents.join(lists, "path").withColumn(
        "content", F.aggregate(own, F.col("content"), lambda text, full: F.coalesce(swapped(text, full), text))
    ).drop("swaps")


def repair_references(documents: DataFrame, paths: DataFrame, strip_anchor: bool = True) -> DataFrame:
    """Documents whose links resolve only by title, rewritten to name the file: (…, content, replaced)."""
    links = stored(extract_links(documents))  # read again for the distinct targets
    by_title = resolve_targets(links, paths, strip_anchor).filter(F.col("reason") == "title").select("target", "resolved")
    found = links.join(by_title, "target")
    wiki = F.when(F.col("label") == "", F.concat(F.lit("[["), "resolved", F.lit("]]"))).otherwise(
        F.concat(F.lit("[["), "resolved", F.lit("|"), "label", F.lit("]]"))
    )
    markdown = F.concat("label", F.lit("("), relative_path("path", "resolved"), F.lit(")"))
    new = F.when(F.col("kind") == "wiki", wiki).otherwise(markdown)
    swaps = found.groupBy("path", "full", new.alias("new")).agg(F.count(F.lit(1)).alias("times"))
    return _replace_all(documents, swaps)


def remove_wiki_links(documents: DataFrame, removals: DataFrame) -> DataFrame:
    """Replace the wiki links to a target (path, target_path) by their text: (…, content, replaced)."""
    display = lambda p: F.lower(trim(F.regexp_replace(strip_notes_root(p), "(?i)\\.md$", "")))
    wanted = removals.select("path", display(F.col("target_path")).alias("to_path"), display(file_name("target_path")).alias("to_title"))
    links = extract_links(documents).filter(F.col("kind") == "wiki").join(wanted, "path")
    named = display(F.col("target"))
    hit = (named == F.col("to_path")) | (F.substring_index(named, "/", -1) == F.col("to_title"))
    text = F.when(F.col("label") != "", F.col("label")).otherwise(trim(F.substring_index("target", "/", -1)))
    swaps = links.filter(hit).groupBy("path", "full", text.alias("new")).agg(F.count(F.lit(1)).alias("times"))
    return _replace_all(documents, swaps)


def _literal(text: Column) -> Column:
    """Pattern matching a text literally as whole words, ignoring case."""
    escaped = F.regexp_replace(text, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")
    return F.concat(F.lit("(?i)" + WORD_START), escaped, F.lit(WORD_END))


WORD = "[a-z0-9_]+"
# The rows of a title that very many texts mention are spread over so many salts.
TITLE_SALTS = 16
# Runs of words are first looked up among so many bits (2 MB), 64 to a number; a choice that moves work, never the result.
TITLE_BITS = 1 << 24


def _shape(title: Column) -> Column:
    """How many words a title has, and how many characters stand before the first and after the last one."""
    between = F.split(title, WORD)
    return F.struct(
        (F.size(between) - 1).alias("words"), F.length(F.element_at(between, 1)).alias("lead"), F.length(F.element_at(between, -1)).alias("tail")
    )


def _shingles(words: int, lead: int, tail: int) -> Column:
    """From arrays w (words) and s (what stands before, between and after them): the texts of one shape, as they are.

    A text that begins or ends outside a word counts only if no word touches it there.
    """
    n = F.size("w")
    at = lambda name, i: F.get(F.col(name), i)

    def text(i: Column) -> Column:
        parts = [F.right(at("s", i), F.lit(lead))] if lead else []
        for j in range(words):
            parts += [at("w", i + j)] + ([at("s", i + j + 1)] if j + 1 < words else [])
        return F.concat(*parts, *([F.left(at("s", i + words), F.lit(tail))] if tail else []))

    def fits(i: Column) -> Column:
        before, after = F.length(at("s", i)), F.length(at("s", i + words))
        left = (before > lead) | ((before == lead) & (i == 0)) if lead else F.lit(True)
        right = (after > tail) | ((after == tail) & (i + words == n)) if tail else F.lit(True)
        return left & right

    starts = F.when(n >= words, F.sequence(F.lit(0), n - words)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, fits), lambda i: F.unhex(F.md5(text(i).cast("binary"))))


def _bit(digest: Column) -> tuple[Column, Column]:
    """The number that holds a digest's bit, and the bit's place in it."""
    bit = F.pmod(F.xxhash64(digest), F.lit(TITLE_BITS)).cast("int")
    return F.shiftright(bit, 6), bit % 64


def _title_bits(titles: DataFrame) -> Column:
    """The bits of all titles' digests, as one array of numbers; of one size, however many titles there are."""
    number, place = _bit(F.col("digest"))
    marks = titles.select(number.alias("at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place).alias("bit"))
    marks = marks.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    slots = titles.sparkSession.range(TITLE_BITS // 64).select(F.col("id").cast("int").alias("at"))
    dense = slots.join(marks, "at", "left").select("at", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "bits"))), lambda s: s["bits"])).scalar()


def _may_be_title(digest: Column, bits: Column) -> Column:
    number, place = _bit(digest)
    return F.call_function("shiftright", F.get(bits, number), place).bitwiseAND(F.lit(1).cast("bigint")) == 1


def mention_backlinks(documents: DataFrame, limit: int = BACKLINKS) -> DataFrame:
    """Documents that mention the title of another one as whole words: (path, source, score, rank).

    Runs of as many words as titles have are cut from each text, with what stands between the words, and meet the titles
    by their digests; texts themselves never move, and of their runs only those whose bit some title has. A text that mentions a title holds all its words, so what the text adds
    to the score follows from the title. Equal titles are looked up once. A title without an ASCII word is not looked up.
    """
    display = F.regexp_replace(file_name(strip_notes_root("path")), "(?i)\\.md$", "")
    titled = documents.select("path", F.lower(trim(display)).alias("title")).filter(F.length("title") >= 2)
    titles = titled.select("title").distinct().withColumn("shape", _shape(F.col("title"))).filter("shape.words > 0")
    # A few: as many as titles differ in their numbers of words and in the characters around them.
    shapes = sorted((r.shape.words, r.shape.lead, r.shape.tail) for r in titles.select("shape").distinct().collect())
    if not shapes:
        return documents.sparkSession.createDataFrame([], "path string, source string, score int, rank int")
    lowered = documents.select(F.col("path").alias("source"), F.lower("content").alias("c"))
    cut = lowered.select("source", matches(F.col("c"), WORD).alias("w"), F.split("c", WORD).alias("s"))
    rows = cut.select("source", F.explode(F.concat(*(_shingles(*shape) for shape in shapes))).alias("digest"))
    titles = stored(titles.select("title", F.unhex(F.md5(F.col("title").cast("binary"))).alias("digest")))
    rows = rows.where(_may_be_title(F.col("digest"), _title_bits(titles)))
    asked = titles.select("title", "digest", F.explode(F.sequence(F.lit(0), F.lit(TITLE_SALTS - 1))).alias("salt"))
    found = rows.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(TITLE_SALTS)).cast("int")).join(asked, ["digest", "salt"]).select("title", "source").distinct()
    name, where = F.lower(file_name("source")), F.lower("source")
    tokens = F.filter(F.split("title", "\\s+"), lambda t: t != "")
    count = lambda field: F.size(F.filter(tokens, lambda t: F.contains(field, t)))
    whole = lambda field, weight: F.when(F.contains(field, F.col("title")), weight).otherwise(0)
    score = whole(name, 120) + whole(where, 60) + 40 + 20 * count(name) + 10 * count(where) + 4 * F.size(tokens)
    # One more than the limit, since a document may mention itself.
    best = Window.partitionBy("title").orderBy(F.desc("score"), "source")
    top = found.select("title", "source", score.alias("score")).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= limit + 1)
    order = Window.partitionBy("path").orderBy("n")
    return (
        titled.join(top, "title")
        .filter(F.col("source") != F.col("path"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("path", "source", "score", "rank")
    )


def link_suggestions(
    edges: DataFrame, documents: DataFrame, dismissed: DataFrame, rejections: DataFrame, limit: int = LINK_SUGGESTIONS
) -> DataFrame:
    """Strongly related documents whose title a document mentions without linking it.

    ``edges(source, target, score, confidence, reason, rank)``, ``dismissed(source, id)``, ``rejections(target, n)``.
    """
    shown = F.regexp_replace(strip_notes_root("target"), "(?i)\\.md$", "")
    named = (
        edges.filter((F.col("confidence") == "high") | (F.col("score") >= 0.72))
        .withColumn("target_path", shown)
        .withColumn("title", F.substring_index("target_path", "/", -1))
        .filter(F.length("title") >= 3)
        .withColumn("id", F.concat_ws("::", F.lower("target_path"), F.lower("title")))
        .join(dismissed.select("source", "id"), ["source", "id"], "left_anti")
        .join(rejections.select("target", F.col("n").alias("rejected")), "target", "left")
    )
    rejected = F.coalesce("rejected", F.lit(0))
    allowed = named.filter(
        ~((rejected >= 3) & (F.col("score") < 0.86)) & ~((rejected >= 2) & (F.col("confidence") != "high"))
    )
    escape = lambda t: F.regexp_replace(t, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")
    linked = F.concat(F.lit("(?i)\\[\\[(?:"), escape(F.col("target_path")), F.lit("|"), escape(F.col("title")), F.lit(")(?:\\||#|\\]\\])"))
    placed = (
        allowed.join(documents.select(F.col("path").alias("source"), "content"), "source")
        .filter(~F.regexp_like("content", linked))
        .withColumn("mention", F.regexp_substr("content", _literal(F.col("title"))))
        .filter(F.col("mention").isNotNull())
        .withColumn("at", F.regexp_instr("content", _literal(F.col("title"))))
        .withColumn("before", F.left("content", F.col("at") - 1))
    )
    since_open = F.substring_index("before", "[[", -1)
    inside = F.contains("before", F.lit("[[")) & ~F.contains(since_open, F.lit("]]")) & F.contains(
        F.substring("content", F.col("at"), F.length("content")), F.lit("]]")
    )
    order = Window.partitionBy("source").orderBy("rank")
    return (
        placed.filter(~inside)
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= limit)
        .select("source", "target", "id", "target_path", F.col("mention").alias("title"), "reason", "confidence", "score", "n")
    )


def nearby_siblings(documents: DataFrame, open_paths: DataFrame, limit: int = 5) -> DataFrame:
    """The nearest files of the same folder that are not open: (path, sibling, rank).

    Files are numbered in one global sort; neighbours meet by an equi-join on number, so no folder is handled whole.
    """
    files = documents.select("path", parent("path").alias("folder"), F.lower(file_name("path")).alias("name"))
    is_open = open_paths.select("path").distinct().withColumn("open", F.lit(True))
    closed_last = files.join(is_open, "path", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    numbered = number_rows(closed_last, "folder", "name", "path")
    closed = number_rows(numbered.filter(~F.col("open")).withColumnRenamed("position", "at"), "at").withColumnRenamed("position", "slot")
    steps = F.array(*[F.lit(i) for i in range(-limit, limit + 1) if i])
    own = closed.select("path", "folder", "at", F.explode(steps).alias("step"), "slot").withColumn("want", F.col("slot") + F.col("step"))
    asked = own.unionByName(_slots_of_open(numbered, limit))
    other = closed.select(F.col("slot").alias("want"), F.col("path").alias("sibling"), F.col("folder").alias("f2"), F.col("at").alias("at2"))
    found = asked.join(other, "want").filter(F.col("folder") == F.col("f2"))
    distance = F.abs(F.col("at2") - F.col("at"))
    order = Window.partitionBy("path").orderBy(distance, F.col("at2") > F.col("at"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("path", "sibling", "rank")


def _slots_of_open(numbered: DataFrame, limit: int) -> DataFrame:
    """Open files with the closed slots around them: the number of closed files before them is their place."""
    opened = number_rows(numbered.filter("open").withColumnRenamed("position", "at"), "at").select(
        "path", "folder", "at", F.col("position").alias("open_before")
    )
    placed = opened.withColumn("slot", F.col("at") - F.col("open_before"))
    steps = F.array(*[F.lit(i) for i in range(-limit, limit)])
    return placed.select("path", "folder", "at", F.explode(steps).alias("step"), "slot").withColumn("want", F.col("slot") + F.col("step"))


def recent_documents(touches: DataFrame, limit: int = 5) -> DataFrame:
    """The most recently touched distinct paths: ``touches(path, ts)``."""
    return touches.filter(F.col("path") != "").groupBy("path").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "path").limit(limit)


def prune_collection(collection: DataFrame, documents: DataFrame) -> DataFrame:
    return collection.join(documents.select("path"), "path", "left_semi")
