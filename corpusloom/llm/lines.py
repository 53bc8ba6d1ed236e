"""Line deduplication with a suffix array over line-id sequences, in DataFrame operations only.

The lines of all documents form one sequence of positions, with a gap between documents. Prefix doubling ranks the
suffixes that start at repeated lines: at level k a suffix's rank is the number of suffixes whose first 2^k lines are
smaller (of those still in the doubling), so that equal ranks are one interval of the suffix array with a longest common prefix of 2^k lines or more.
A suffix that is alone in its interval leaves the doubling.

A run of lines is worth deleting if it has `min_words` words. Whether such a run occurs earlier follows from two
overlapping intervals of the level just below its length, so doubling ends at log2(min_words) levels however long the
repeated runs are: a longer run is covered by the minimal runs inside it. Overlapping minimal runs are merged into
maximal ones, and the copies that come later in document order are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import salt_mask, salt_of, salts_in, saved, spare

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def running_total(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """Add the sum of `weight` over all rows that come before in `order` (ties: any order, but no overlap).

    A range sort, one total for each partition, and a running sum within each: no task sees more than its range.
    """
    ranged = saved(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part").agg(F.sum(weight).alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__sum", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return summed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__sum") + F.col("__offset")).drop("__part", "__sum", "__offset")


def _word_lines(text: Column) -> Column:
    """The lines that hold a word, each with its place among all lines. Lines without a word belong to no run."""
    numbered = F.transform(F.split(text, "\n"), lambda line, at: F.struct(at.alias("line"), line.alias("content")))
    return F.filter(numbered, lambda x: x.content.rlike(WORD))


def repeated_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From doc_id, text_hash, text: the lines that occur more than once, and the documents' places.

    The lines: doc (the position of a document's first line), pos, line, words, rank. The places: d, h (a document's id
    and text hash), doc.
    """
    sizes = docs.select("doc_id", "text_hash", (F.size(_word_lines(F.col("text"))) + 1).cast("long").alias("n")).distinct()
    bases = saved(
        running_total(sizes, ["doc_id", "text_hash"], "n", "doc").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "doc"),
        "places",
    )
    lines = docs.select("doc_id", "text_hash", F.posexplode(_word_lines(F.col("text"))).alias("at", "x")).select(
        "doc_id", "text_hash", "at", "x.line", F.unhex(F.sha2("x.content", 256)).alias("digest"),
        F.regexp_count("x.content", F.lit(WORD)).alias("words"), salt_of(F.col("doc_id"), F.col("at")).alias("salt"),
    )
    counted = saved(lines.distinct(), "lines")
    repeated = counted.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), salt_mask("salt").alias("mask")).where("n > 1")
    ranked = running_total(repeated, ["digest"], "n", "rank").select("digest", "rank", salts_in("mask").alias("salt"))
    found = counted.join(ranked, ["digest", "salt"])
    placed = found.join(bases, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    return placed.select("doc", (F.col("doc") + F.col("at")).alias("pos"), "line", "words", "rank"), bases


def double(level: DataFrame, k: int) -> DataFrame:
    """From the ranks of 2^k lines (doc, pos, rank) those of 2^(k+1) lines; suffixes that nothing equals are left out."""
    ahead = Window.partitionBy("doc").orderBy("pos").rangeBetween(1 << k, 1 << k)
    pairs = saved(
        level.select("doc", "pos", "rank", F.max("rank").over(ahead).alias("next"), salt_of(F.col("pos")).alias("salt")).where(
            "next is not null"
        ),
        "pairs",
    )
    groups = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"), salt_mask("salt").alias("mask"))
    # Numbered over the whole table: one very common line may have any number of next lines.
    groups = running_total(groups, ["rank", "next"], "n", "refined").where("n > 1").select("rank", "next", "refined", salts_in("mask").alias("salt"))
    return pairs.join(groups, ["rank", "next", "salt"]).select("doc", "pos", F.col("refined").alias("rank"))


def minimal_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """Runs of neighbouring repeated lines that reach min_words and would not without their first or their last line.

    doc, first and last (positions), first_line and last_line (places in the document's text).
    """
    in_doc = Window.partitionBy("doc").orderBy("pos")
    islands = lines.withColumn("island", F.col("pos") - F.row_number().over(in_doc))
    in_island = Window.partitionBy("doc", "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = islands.withColumn("until", F.sum("words").over(in_island)).withColumn("before", F.col("until") - F.col("words"))
    place = F.struct("pos", "line")
    none = F.lit(None).cast("struct<pos:bigint,line:int>")
    # From each first line the nearest last line, met by sorting word counts downwards: a line ends at `until`, and a
    # run that starts at `before` has to end at `before` + min_words or later. From each last line likewise upwards.
    event = lambda key, rank, start, end, ask: F.struct(key.alias("key"), rank.alias("turn"), start.alias("start"), end.alias("end"), F.lit(ask).alias("ask"))
    ends = summed.select("doc", "island", F.explode(F.array(
        event(F.col("until"), F.lit(0), none, place, False), event(F.col("before") + min_words, F.lit(1), place, none, True)
    )).alias("e")).select("doc", "island", "e.*")
    downwards = Window.partitionBy("doc", "island").orderBy(F.desc("key"), "turn", F.desc("end.pos")).rowsBetween(Window.unboundedPreceding, 0)
    forward = ends.select("doc", "ask", "start", F.last("end", ignorenulls=True).over(downwards).alias("end")).where("ask and end is not null")
    starts = summed.select("doc", "island", F.explode(F.array(
        event(F.col("before"), F.lit(0), place, none, False), event(F.col("until") - min_words, F.lit(1), none, place, True)
    )).alias("e")).select("doc", "island", "e.*")
    upwards = Window.partitionBy("doc", "island").orderBy("key", "turn", "start.pos").rowsBetween(Window.unboundedPreceding, 0)
    backward = starts.select("doc", "ask", F.last("start", ignorenulls=True).over(upwards).alias("start"), "end").where("ask and start is not null")
    return forward.select("doc", "start", "end").union(backward.select("doc", "start", "end")).select(
        "doc", F.col("start.pos").alias("first"), F.col("end.pos").alias("last"),
        F.col("start.line").alias("first_line"), F.col("end.line").alias("last_line"),
    ).distinct()


def later_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The maximal runs of lines to delete: doc, first_line, last_line."""
    lines = saved(lines, "repeated-lines")
    level = lines.select("doc", "pos", "rank")
    ranks = level.withColumn("k", F.lit(0))
    for k in range(max(0, (min_words - 1).bit_length())):  # a minimal run has min_words lines at most, of a word each
        level = saved(double(level, k), "level")
        ranks = ranks.union(level.withColumn("k", F.lit(k + 1)))
    length = F.col("last") - F.col("first") + 1
    runs = minimal_runs(lines, min_words).withColumn("length", length).withColumn("k", (F.length(F.bin("length")) - 1).cast("int"))
    runs = runs.withColumn("tail", F.col("last") + 1 - F.expr("shiftleft(1L, k)"))
    named = runs.join(ranks.select("k", F.col("pos").alias("first"), F.col("rank").alias("head_rank")), ["k", "first"]).join(
        ranks.select("k", F.col("pos").alias("tail"), F.col("rank").alias("tail_rank")), ["k", "tail"]
    )
    keys = ["length", "head_rank", "tail_rank"]
    named = saved(named.select("doc", "first", "last", "first_line", "last_line", *keys, salt_of(F.col("first")).alias("salt")), "runs")
    earliest = (
        named.groupBy(*keys).agg(F.min("first").alias("earliest"), F.count(F.lit(1)).alias("n"), salt_mask("salt").alias("mask"))
        .where("n > 1").select(*keys, "earliest", salts_in("mask").alias("salt"))
    )
    later = named.join(earliest, [*keys, "salt"]).where("first > earliest").select("doc", "first", "last", "first_line", "last_line")
    by_start = Window.partitionBy("doc").orderBy("first", "last")
    reached = F.max("last").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("opens", F.coalesce(F.col("first") > reached + 1, F.lit(True)).cast("int"))
    numbered = opened.withColumn("run", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "run").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line")).drop("run")


def delete_repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, chars_col: str | None = "n_chars"
) -> DataFrame:
    """All documents and columns, without the lines of repeated runs of `min_words` words or more but for their first copy.

    Copies are ordered by document id (null first), then by place; a run may overlap its own earlier copy. Lines end at
    line feeds only and are compared as they are. Lines without a word belong to no run, but go with the lines on both
    sides of them. A text whose every line goes becomes empty; null texts stay null. Rows with equal id and text are one
    document: they are changed alike. `chars_col`, where the input has it, is set to the new length. Adds n_removed, the
    number of lines deleted; an own column of that name is replaced.
    """
    hashed, runs_of, doc, text = (spare(name, docs) for name in ("text_hash", "runs", "run_doc", "run_text"))
    keyed = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    texts = keyed.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(hashed).alias("text_hash"), F.col(text_col).alias("text")
    )
    lines, places = repeated_lines(texts)
    runs = later_runs(lines, min_words).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("first_line", "last_line"))).alias("runs"))
    gone = runs.join(places, "doc").select(F.col("d").alias(doc), F.col("h").alias(text), F.col("runs").alias(runs_of))
    joined = keyed.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(hashed) == F.col(text)), "left")
    pieces = F.split(F.col(text_col), "\n")
    # What lies between the runs, which are apart and in order.
    starts = F.concat(F.array(F.lit(0)), F.transform(runs_of, lambda run: run.last_line + 1))
    ends = F.concat(F.transform(runs_of, lambda run: run.first_line), F.array(F.size(pieces)))
    kept = F.flatten(F.zip_with(starts, ends, lambda start, end: F.slice(pieces, start + 1, F.greatest(end - start, F.lit(0)))))
    changed = F.col(runs_of).isNotNull() & F.col(text_col).isNotNull()
    removed = F.aggregate(runs_of, F.lit(0), lambda n, run: n + run.last_line - run.first_line + 1)
    out = joined.withColumn("n_removed", F.when(changed, removed).otherwise(F.lit(0))).withColumn(
        text_col, F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    )
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(changed, F.length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out.select(*docs.columns, *([] if "n_removed" in docs.columns else ["n_removed"]))
