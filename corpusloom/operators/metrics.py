"""Latency summaries, bottlenecks, task telemetry and typing activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.columns import choose

LAST_SAMPLES = 180
LAST_TASKS = 24
LAST_WAITS = 96
ACTIVITY_MS = 3200
IDLE_MS = 1350

# Label, watch and slow thresholds in milliseconds of each live metric and each scan operation.
LIVE_THRESHOLDS = {
    "file_open_ms": ("File Open", 120, 260),
    "vault_tree_load_ms": ("Vault Tree Load", 120, 280),
    "keyword_search_ms": ("Keyword Search", 160, 320),
    "sidebar_related_ms": ("Related Notes Sidebar", 180, 360),
    "sidebar_backlinks_ms": ("Backlinks Sidebar", 180, 360),
    "ai_readable_load_ms": ("AI Document Load", 260, 550),
    "search_retrieval_ms": ("Search Retrieval", 220, 480),
    "qa_single_ms": ("Q&A (Single)", 2400, 5200),
    "qa_multi_ms": ("Q&A (Multi)", 3200, 7000),
    "reorg_analyze_ms": ("Vault Analyze", 4500, 9000),
    "regen_all_embeddings_ms": ("Embed Regenerate (All)", 10000, 25000),
    "regen_stale_embeddings_ms": ("Embed Regenerate (Stale)", 6000, 16000),
}
SCAN_THRESHOLDS = {
    "scan_tree_load": ("Vault tree load", 120, 280),
    "scan_text_read": ("Text note read", 80, 180),
    "scan_ai_doc_read": ("AI document read", 260, 550),
    "scan_keyword_search": ("Keyword search", 140, 320),
}


def round_tenth(value: Column) -> Column:
    """Round half up to one decimal."""
    return F.floor(value * 10 + 0.5) / 10


def _last(df: DataFrame, key: str, ts: str, n: int, tie: str) -> DataFrame:
    """The last ``n`` rows of each key. The group limit keeps n rows of a key in each task, so hot keys are no burden."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n)


def latency_summary(samples: DataFrame, last: int = LAST_SAMPLES) -> DataFrame:
    """Count, last, p50, p95 (nearest rank) and mean of the last samples: ``samples(metric, ts, sample_id, elapsed_ms)``."""
    clean = samples.withColumn(
        "elapsed_ms", F.when(F.isnan("elapsed_ms") | F.col("elapsed_ms").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("elapsed_ms")))
    )
    recent = _last(clean, "metric", "ts", last, "sample_id")
    return recent.groupBy("metric").agg(
        F.count(F.lit(1)).alias("count"),
        round_tenth(F.max(F.when(F.col("_n") == 1, F.col("elapsed_ms")))).alias("last_ms"),
        round_tenth(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY elapsed_ms)")).alias("p50_ms"),
        round_tenth(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY elapsed_ms)")).alias("p95_ms"),
        round_tenth(F.avg("elapsed_ms")).alias("mean_ms"),
    )


def severity(value: Column, watch: Column, slow: Column) -> Column:
    return choose((value >= slow, "slow"), (value >= watch, "watch"), otherwise="good")


def _thresholds(df: DataFrame, key: str, table: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Add label, watch and slow by a literal map; keys outside the table get nulls."""
    entries = [v for name, (label, watch, slow) in table.items() for v in (F.lit(name), F.struct(F.lit(label).alias("label"), F.lit(watch).alias("watch"), F.lit(slow).alias("slow")))]
    return df.withColumn("_t", F.try_element_at(F.create_map(*entries), F.col(key))).select("*", "_t.*").drop("_t")


def bottlenecks(summaries: DataFrame, limit: int = 5) -> DataFrame:
    """Metrics whose p95 is beyond its watch threshold, slowest first."""
    rated = _thresholds(summaries.filter(F.col("count") > 0), "metric", LIVE_THRESHOLDS).filter(F.col("label").isNotNull())
    return (
        rated.withColumn("severity", severity(F.col("p95_ms"), F.col("watch"), F.col("slow")))
        .filter(F.col("severity") != "good")
        .orderBy(F.desc("p95_ms"), "metric")
        .limit(limit)
        .select(F.col("metric").alias("key"), "label", F.col("p95_ms").alias("observed_ms"), F.col("watch").alias("threshold_ms"), "severity", F.lit("live").alias("source"))
    )


def scan_operations(samples: DataFrame) -> DataFrame:
    """Runs, average, maximum and severity of scan operations: ``samples(operation, elapsed_ms)``."""
    summed = samples.groupBy("operation").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("elapsed_ms").alias("avg"), F.max("elapsed_ms").alias("max")
    )
    rated = _thresholds(summed, "operation", SCAN_THRESHOLDS).filter(F.col("label").isNotNull())
    return rated.select(
        F.col("operation").alias("key"), "label", "runs", round_tenth(F.col("avg")).alias("avg_ms"), round_tenth(F.col("max")).alias("max_ms"),
        severity(F.col("max"), F.col("watch"), F.col("slow")).alias("severity"), F.col("watch").alias("threshold_ms"),
    )


def merged_bottlenecks(operations: DataFrame, live: DataFrame, limit: int = 6) -> DataFrame:
    scanned = operations.filter(F.col("severity") != "good").select(
        "key", "label", F.col("max_ms").alias("observed_ms"), "threshold_ms", "severity", F.lit("scan").alias("source")
    )
    return scanned.unionByName(live).orderBy(F.desc("observed_ms"), "key").limit(limit)


def recommendations(operations: DataFrame, live: DataFrame) -> DataFrame:
    """At most four sentences of advice, in order: (position, advice)."""
    states = operations.agg(
        *[F.max(F.when(F.col("key") == k, F.col("severity"))).alias(k) for k in SCAN_THRESHOLDS]
    )
    slow_answers = live.filter(F.col("key").isin("qa_multi_ms", "qa_single_ms")).agg(F.count(F.lit(1)))
    bad = lambda k: F.coalesce(F.col(k) != "good", F.lit(True))
    notes = F.array_compact(
        F.array(
            F.when(bad("scan_tree_load"), "Tree loading is trending slow: keep folders collapsed and avoid many file operations in a row."),
            F.when(F.col("scan_text_read") == "slow", "Text reads are slower than expected: trim or split large notes of one folder."),
            F.when(bad("scan_ai_doc_read"), "Document extraction is a hotspot: keep very large documents out of active work, or open them once to warm the cache."),
            F.when(bad("scan_keyword_search"), "Keyword search is a bottleneck: favor narrower searches and let the query cache warm."),
            F.when(F.col("answers") > 0, "Answering is one of the slower paths: faster models or smaller contexts help most."),
        )
    )
    listed = states.withColumn("answers", slow_answers.scalar()).withColumn("notes", notes)
    healthy = F.array(F.lit("The sampled paths look healthy right now."))
    return listed.select(F.posexplode(F.slice(F.when(F.size("notes") > 0, F.col("notes")).otherwise(healthy), 1, 4)).alias("position", "advice"))


def backlog_tier(size: Column) -> Column:
    return choose((size >= 420, "very_large"), (size >= 180, "large"), (size >= 80, "medium"), otherwise="small")


def task_telemetry(tasks: DataFrame, key: str = "queue") -> DataFrame:
    """State of each queue over its last tasks: ``tasks(queue, task_id, queued_at, started_at, finished_at, outcome, active_hit)``."""
    ms = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1000
    timed = tasks.withColumn("duration", F.greatest(F.lit(0.0), ms("started_at", "finished_at"))).withColumn(
        "wait", F.greatest(F.lit(0.0), ms("queued_at", "started_at"))
    )
    recent = _last(timed, key, "finished_at", max(LAST_TASKS, LAST_WAITS), "task_id")
    tasks_only = lambda c: F.when(F.col("_n") <= LAST_TASKS, c)
    waits_only = lambda c: F.when(F.col("_n") <= LAST_WAITS, c)
    with_parts = recent.withColumn("d", tasks_only(F.col("duration"))).withColumn("w", waits_only(F.col("wait")))
    return with_parts.groupBy(key).agg(
        F.avg("d").alias("avg_task_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY d)").alias("p95_task_ms"),
        F.avg(tasks_only((F.col("outcome") == "failed").cast("int"))).alias("failure_rate"),
        F.avg("w").alias("avg_wait_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY w)").alias("p95_wait_ms"),
        F.avg(waits_only(F.col("active_hit").cast("int"))).alias("hit_rate"),
        F.count("w").alias("hit_samples"),
    )


def clamp_chars(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(256), F.floor(chars + 0.5).cast("int")))


def pressure(chars_in_window: Column, idle_ms: Column) -> Column:
    per_second = chars_in_window / (ACTIVITY_MS / 1000)
    return choose((idle_ms > IDLE_MS, "idle"), (per_second >= 8, "high"), (per_second >= 4, "medium"), otherwise="low")


def activity_pressure(events: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Characters and events in the 3.2 s up to each event, and the pressure they mean: ``events(user_id, ts, chars)``.

    Rows are spread by user and hour; an event near the start of an hour is reached by copies of the few events of
    the seconds before it, so a single busy user is split over many tasks.
    """
    micros = F.unix_micros("ts")
    size = bucket_seconds * 1_000_000
    base = events.withColumn("us", micros).withColumn("chars", clamp_chars(F.col("chars")))
    own = base.withColumn("bucket", F.floor(F.col("us") / size)).withColumn("own", F.lit(True))
    late = base.filter(F.col("us") % size >= size - ACTIVITY_MS * 1000).withColumn("bucket", F.floor(F.col("us") / size) + 1).withColumn("own", F.lit(False))
    frame = Window.partitionBy("user_id", "bucket").orderBy("us").rangeBetween(-ACTIVITY_MS * 1000, 0)
    measured = own.unionByName(late).withColumn("chars_in_window", F.sum("chars").over(frame)).withColumn("events_in_window", F.count(F.lit(1)).over(frame))
    return measured.filter("own").select(
        *[c for c in events.columns if c != "chars"], "chars_in_window", "events_in_window",
        (F.col("chars_in_window") / (ACTIVITY_MS / 1000)).alias("chars_per_second"),
        pressure(F.col("chars_in_window"), F.lit(0)).alias("pressure"),
    )


def activity_snapshot(events: DataFrame, now: Column) -> DataFrame:
    """Each user's activity at one moment; the filter reaches the scan, so only the last seconds are read."""
    age = (F.unix_micros(now) - F.unix_micros("ts")) / 1000
    recent = events.filter((age >= 0) & (age <= ACTIVITY_MS)).withColumn("age", age).withColumn("chars", clamp_chars(F.col("chars")))
    summed = recent.groupBy("user_id").agg(F.sum("chars").alias("chars_in_window"), F.count(F.lit(1)).alias("events_in_window"), F.min("age").alias("idle_ms"))
    return summed.withColumn("pressure", pressure(F.col("chars_in_window"), F.col("idle_ms")))
