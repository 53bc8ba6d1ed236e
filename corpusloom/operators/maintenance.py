"""Keeping the vector index fresh: status, staleness, orphans and incremental re-embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.columns import ColumnLike, col, trim
from corpusloom.functions.paths import is_indexable, is_retrievable, normalize_path
from corpusloom.functions.text import content_hash
from corpusloom.operators.vectors import latest_embeddings
from corpusloom.session import cut_lineage


def normalize_model(model: ColumnLike) -> Column:
    return F.regexp_replace(F.lower(trim(F.coalesce(col(model), F.lit("")))), "@sha256:[a-f0-9]+$", "")


def model_matches(requested: ColumnLike, available: ColumnLike) -> Column:
    """Equal after normalization, or the available one is a tag of the requested one."""
    want, have = normalize_model(requested), normalize_model(available)
    return (want != "") & (have != "") & ((want == have) | F.startswith(have, F.concat(want, F.lit(":"))))


def _paths(df: DataFrame) -> DataFrame:
    return df.select("path").filter(trim("path") != "").distinct()


def stale_or_missing(paths: DataFrame, latest: DataFrame, model: str) -> DataFrame:
    """Paths with no vector or a vector of another model."""
    have = latest.select("path", F.col("model").alias("have"))
    return (
        _paths(paths)
        .join(have, "path", "left")
        .filter(F.col("have").isNull() | ~model_matches(F.lit(model), F.col("have")))
        .select("path", F.when(F.col("have").isNull(), "missing").otherwise("stale").alias("state"))
    )


def reembed_targets(candidates: DataFrame, latest: DataFrame, model: str, max_count: int) -> DataFrame:
    """First ``max_count`` candidates (path, position) that need a vector, in candidate order."""
    first = candidates.filter(trim("path") != "").groupBy("path").agg(F.min("position").alias("position"))
    wanting = first.join(stale_or_missing(first, latest, model), "path")
    return wanting.orderBy("position", "path").limit(max(0, max_count))


def orphan_embeddings(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """Index paths inside the scope that no document carries any more."""
    valid = documents.select(normalize_path("path").alias("path")).filter(is_indexable("path"))
    indexed = embeddings.select(normalize_path("path").alias("path")).filter(is_indexable("path")).distinct()
    return indexed.join(valid, "path", "left_anti")


def prune_embeddings(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    return embeddings.withColumn("path", normalize_path("path")).join(
        orphan_embeddings(embeddings, documents), "path", "left_anti"
    )


def latest_failures(store: DataFrame, history: DataFrame) -> DataFrame:
    """Last known failure of each path: the persistent store first, else the queue's history.

    Both have (path, at, message); ``retries`` counts the history's failures of the path.
    """
    kept = store.select(normalize_path("path").alias("path"), "at", "message", F.lit(0).alias("rank"))
    queued = history.select(normalize_path("path").alias("path"), "at", "message", F.lit(1).alias("rank"))
    return (
        kept.unionByName(queued)
        .groupBy("path")
        .agg(
            F.min_by(F.struct("at", "message"), F.struct("rank", (-F.unix_micros("at")).alias("age"), "message")).alias("f"),
            F.count_if(F.col("rank") == 1).alias("retries"),
        )
        .select("path", "f.at", "f.message", "retries")
    )


def retry_failed(failures: DataFrame, limit: int = 8) -> DataFrame:
    """The most recently failed paths."""
    return failures.groupBy("path").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "path").limit(max(1, limit))


def index_health(paths: DataFrame, latest: DataFrame, failures: DataFrame, model: str) -> DataFrame:
    """One row for each issue; a path can be both stale or missing and failed."""
    have = latest.select("path", F.col("model").alias("have"))
    failed = failures.select("path", F.col("message"), F.col("at"))
    joined = _paths(paths).join(have, "path", "left").join(failed, "path", "left")

    def issue(rank: int, kind: str, reason: Column, detail: Column, at: Column | None = None) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"), F.lit(kind).alias("type"), reason.alias("reason"), detail.alias("detail"),
            (F.lit(None).cast("timestamp") if at is None else at).alias("last_attempt_at"),
        )

    known = F.nullif(F.col("have"), F.lit(""))
    stale = F.col("have").isNotNull() & ~model_matches(F.lit(model), F.col("have"))
    issues = F.array_compact(
        F.array(
            F.when(
                F.col("at").isNotNull(),
                issue(0, "failed", F.lit("Last embedding attempt failed"), F.col("message"), F.col("at")),
            ),
            F.when(
                F.col("have").isNull(),
                issue(
                    1, "missing", F.lit("No embedding found for this eligible note"),
                    F.lit("Generate or rebuild embeddings so Q&A can use this note."),
                ),
            ),
            F.when(
                stale,
                issue(
                    2, "stale",
                    F.concat(F.lit("Indexed with "), F.coalesce(known, F.lit("an older model")), F.lit(f" instead of {model}")),
                    F.coalesce(
                        F.concat(F.lit("Current embedding model on file: "), known),
                        F.lit("Existing embedding has no recorded model."),
                    ),
                ),
            ),
        )
    )
    return joined.select("path", F.explode(issues).alias("i")).select("path", "i.*")


def index_health_status(paths: DataFrame, latest: DataFrame, failures: DataFrame, model: str) -> DataFrame:
    """Counts over all eligible paths, in one row."""
    have = latest.select("path", F.col("model").alias("have"))
    joined = _paths(paths).join(have, "path", "left").join(failures.select("path", "at"), "path", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count("have").alias("indexed"),
        F.count_if(F.col("have").isNotNull() & ~model_matches(F.lit(model), F.col("have"))).alias("stale"),
        F.count("at").alias("failed"),
    )


def model_status(paths: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Totals and the distinct observed models (a handful) of the paths' latest records."""
    records = (
        embeddings.withColumn("path", normalize_path("path"))
        .join(_paths(paths), "path", "left_semi")
        .groupBy("path")
        .agg(F.max(F.struct(F.coalesce("created_at", F.lit("")), F.coalesce("model", F.lit("")).alias("model"))).getField("model").alias("model"))
    )
    by_model = records.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    fresh = model_matches(F.lit(model), F.col("model"))
    return by_model.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(fresh, F.col("n"))), F.lit(0)).alias("up_to_date"),
        F.coalesce(F.sum(F.when(~fresh, F.col("n"))), F.lit(0)).alias("stale"),
        F.sort_array(F.collect_list(F.when(trim("model") != "", F.col("model")))).alias("observed_models"),
    )


def embedding_work(documents: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Documents with the reason to embed or skip them: empty, unchanged, new, stale or changed."""
    latest = latest_embeddings(embeddings).select("path", F.col("model").alias("have"), F.col("content_hash").alias("old_hash"))
    docs = documents.select(normalize_path("path").alias("path"), "content", content_hash("content").alias("content_hash"))
    state = (
        F.when(trim("content") == "", "empty")
        .when(F.col("have").isNull(), "new")
        .when(~model_matches(F.lit(model), F.col("have")), "stale")
        .when(F.col("old_hash") == F.col("content_hash"), "unchanged")
        .otherwise("changed")
    )
    return docs.filter(is_retrievable("path")).join(latest, "path", "left").select("path", "content", "content_hash", state.alias("state"))


def incremental_embed(documents: DataFrame, embeddings: DataFrame, model: str, embed) -> tuple[DataFrame, DataFrame]:
    """New index and one row of counts. ``embed`` maps (path, content) to embedding records with an error column."""
    work = embedding_work(documents, embeddings, model)
    todo = work.filter(F.col("state").isin("new", "stale", "changed"))
    made = embed(todo.select("path", "content")).join(todo.select("path", "content_hash"), "path")
    good = made.filter(F.col("error").isNull()).drop("error")
    kept = prune_embeddings(embeddings, documents).join(good.select("path"), "path", "left_anti")
    columns = [c for c in good.columns if c in embeddings.columns]
    merged = kept.select(*columns).unionByName(good.select(*columns))
    counts = work.groupBy().agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("state").isin("empty", "unchanged")).alias("skipped"),
    )
    done = good.agg(F.count(F.lit(1)).alias("embedded"))
    orphans = orphan_embeddings(embeddings, documents).agg(F.count(F.lit(1)).alias("pruned"))
    # One-row tables, side by side.
    summary = counts.select("*", F.lit(1).alias("k")).join(done.withColumn("k", F.lit(1)), "k").join(
        orphans.withColumn("k", F.lit(1)), "k"
    ).drop("k")
    return merged, summary


# What is recorded of a document that gave no vector.
EMPTY_MESSAGE = "Note is empty, so no embedding was generated."
FAILED_MESSAGE = "Embedding failed"


def repair_embeddings(candidates: DataFrame, documents: DataFrame, embeddings: DataFrame, failures: DataFrame, embed, at: Column) -> tuple[DataFrame, DataFrame]:
    """Embed the candidates (path) anew, whatever the index says of them: the new index, and the failures (path, at, message).

    Candidates are the failed, stale or missing paths of an index, or any others; each counts once, and only in scope. A
    success replaces the records of its path and clears its failure; an empty document, one that is not there, or an
    error of ``embed`` replaces the failure and leaves the index as it is.
    """
    wanted = candidates.select(normalize_path("path").alias("path")).filter(is_retrievable("path")).distinct()
    texts = documents.select(normalize_path("path").alias("path"), "content")
    asked = wanted.join(texts, "path", "left").withColumn("content_hash", content_hash("content"))
    filled = asked.filter(trim("content") != "")
    made = cut_lineage(embed(filled.select("path", "content")).join(filled.select("path", "content_hash"), "path"))
    good = made.filter(F.col("error").isNull()).drop("error")
    said = asked.select("path", F.when(F.col("content").isNull(), FAILED_MESSAGE).when(trim("content") == "", EMPTY_MESSAGE).alias("message")).filter(F.col("message").isNotNull())
    failed = said.union(made.filter(F.col("error").isNotNull()).select("path", "error"))
    columns = [c for c in good.columns if c in embeddings.columns]
    kept = embeddings.withColumn("path", normalize_path("path")).join(good.select("path"), "path", "left_anti").select(*columns)
    left = failures.select("path", "at", "message").join(wanted, "path", "left_anti")
    return kept.unionByName(good.select(*columns)), left.unionByName(failed.select("path", at.alias("at"), "message"))


def retry_state(task_log: DataFrame, as_of: Column, cooldown_seconds: int = 60) -> DataFrame:
    """Whether each path may be tried again: its last failure is older than the cool-down, or a success followed it."""
    last = task_log.groupBy("path").agg(
        F.max(F.when(F.col("outcome") == "failed", F.col("finished_at"))).alias("failed_at"),
        F.max(F.when(F.col("outcome") == "success", F.col("finished_at"))).alias("succeeded_at"),
    )
    cleared = F.col("failed_at").isNull() | (F.coalesce(F.col("succeeded_at") > F.col("failed_at"), F.lit(False)))
    elapsed = as_of > F.col("failed_at") + F.make_dt_interval(secs=F.lit(cooldown_seconds))
    return last.select("path", "failed_at", "succeeded_at", (cleared | elapsed).alias("can_retry"))


def accept_for_queue(requested: DataFrame, queued: DataFrame, state: DataFrame) -> DataFrame:
    """Requested paths (path, force), once each, that are retrievable, not queued yet and out of cool-down."""
    asked = (
        requested.select(normalize_path("path").alias("path"), "force")
        .filter(is_retrievable("path"))
        .groupBy("path")
        .agg(F.max("force").alias("force"))
    )
    return (
        asked.join(queued.select("path"), "path", "left_anti")
        .join(state.select("path", "can_retry"), "path", "left")
        .filter(F.col("force") | F.coalesce("can_retry", F.lit(True)))
        .select("path")
    )


def failures_since_success(task_log: DataFrame) -> DataFrame:
    """Number of failures of each path after its last success, and the latest of them."""
    ok = task_log.filter(F.col("outcome") == "success").groupBy("path").agg(F.max("finished_at").alias("ok_at"))
    failed = task_log.filter(F.col("outcome") == "failed").join(ok, "path", "left")
    later = failed.filter(F.col("ok_at").isNull() | (F.col("finished_at") > F.col("ok_at")))
    return later.groupBy("path").agg(
        F.count(F.lit(1)).alias("retries"),
        F.max("finished_at").alias("at"),
        F.max_by("error", F.struct("finished_at", "error")).alias("message"),
    )
