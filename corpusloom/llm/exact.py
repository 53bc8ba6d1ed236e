"""Exact deduplication by skew-safe combining.

Equal texts meet in three stages, and every stage groups by the full content beside its digest: equal rows of a task
are combined before they leave it, groups are merged for each digest and salt, and the salts' winners are merged for
each digest. A text that fills a third of the table therefore reaches no task with more than one row for each
(task, salt), and later one row for each salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SALTS, salt_mask, salt_of, salts_in, saved


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """One row for each document: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after `normalise`; a null text counts as empty. The row with the largest id of a
    group stays. Rows with the same id and text are one document seen several times: each is returned, counted and, if
    it has the group's largest id, kept. A group whose ids are all null keeps null ids (keep_id null, kept true); null
    ids lose to any other. Other columns of the input are ignored. An empty table gives no rows.

    `digest` only brings equal texts together: texts that share a digest by accident are told apart by content. The
    default is the SHA-256 that the result names texts by, and two texts that shared it would be one there in any case.
    """
    if not 1 <= salts <= SALTS:
        raise ValueError(f"salts must be between 1 and {SALTS}")
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns(
        {"digest": digest(F.col("text")), "salt": salt_of(F.col("doc_id"), salts=salts)}
    )
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = saved(
        salted.groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), salt_mask("salt").alias("mask"))
        .select("digest", "keep_id", "group_size", "mask"),
        "exact-groups",
    )
    accidents = groups.groupBy("digest").count().where("count > 1").select("digest")
    members = rows.select("doc_id", "digest", "salt", F.sha2("text", 256).alias("text_sha256"))
    if digest is not sha256 and not accidents.isEmpty():
        # Several texts under one digest: their groups are found by content, read again from each group's own winner.
        members = rows.select("doc_id", "digest", "salt", F.sha2("text", 256).alias("text_sha256"), "text")
        contents = rows.groupBy("digest", "text").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), salt_mask("salt").alias("mask")
        )
        placed = members.join(contents.select("digest", "text", "keep_id", "group_size", salts_in("mask", salts).alias("salt")), ["digest", "salt", "text"])
    else:
        placed = members.join(groups.select("digest", "keep_id", "group_size", salts_in("mask", salts).alias("salt")), ["digest", "salt"])
    return placed.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
