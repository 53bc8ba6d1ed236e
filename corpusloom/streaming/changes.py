"""Document changes as a stream: debouncing, skipping what did not change, and retry cool-down."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import content_hash

EMBED_GAP = "1200 milliseconds"
POST_PROCESS_GAP = "2200 milliseconds"
WATERMARK = "10 seconds"
COOLDOWN = timedelta(seconds=60)


def settled_changes(changes: DataFrame, gap: str = POST_PROCESS_GAP, watermark: str = WATERMARK) -> DataFrame:
    """One row for each burst of edits of a path: ``changes(path, content, priority, ts)``.

    A burst ends when nothing happens for ``gap``: an edit exactly that much later begins the next. The latest content wins (of several at one time, the greatest); the burst is of high priority if any edit
    was. Works on batch and streaming tables; a stream emits a burst once, after the watermark has passed it.
    """
    source = changes.withWatermark("ts", watermark) if changes.isStreaming else changes
    # Session windows that touch are merged, so they are the least step shorter than the gap.
    return (
        source.groupBy(F.session_window("ts", f"{gap} -1 microseconds").alias("s"), "path")
        .agg(
            F.max_by("content", F.struct("ts", "content")).alias("content"),
            F.max(F.col("priority") == "high").alias("high"),
            F.max("ts").alias("last_at"),
            F.count(F.lit(1)).alias("edits"),
        )
        .select("path", F.col("s.start").alias("first_at"), "last_at", "edits", "content", F.when(F.col("high"), "high").otherwise("normal").alias("priority"))
    )


def read_seen(spark: SparkSession, store: str) -> DataFrame:
    """Last processed hash of each path; empty before the first batch."""
    return _seen_before(spark, store, None)


def _seen_before(spark: SparkSession, store: str, batch_id: int | None) -> DataFrame:
    """What batches before one have recorded. A store that cannot be read is an error; one that does not exist is empty."""
    try:
        entries = spark.read.schema("path string, content_hash string, last_at timestamp, batch long").parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, content_hash string")
    earlier = entries if batch_id is None else entries.filter(F.col("batch") < batch_id)
    latest = F.max_by("content_hash", F.struct("batch", "last_at", "content_hash"))
    return earlier.groupBy("path").agg(latest.alias("content_hash"))


def changed_only(settled: DataFrame, seen: DataFrame) -> DataFrame:
    """Bursts whose content differs from what was last processed, the last one of each path."""
    hashed = settled.withColumn("content_hash", content_hash("content"))
    row = F.struct(*[c for c in hashed.columns if c != "path"])
    last = hashed.groupBy("path").agg(F.max_by(row, F.struct("last_at", row)).alias("r")).select("path", "r.*")
    return last.join(seen, ["path", "content_hash"], "left_anti")


def process_batches(settled: DataFrame, store: str, checkpoint: str, handle=None, available_now: bool = True):
    """Start a query that hands changed documents to ``handle(df, batch_id)`` and records their hashes under ``store``.

    Each batch overwrites its own folder, so a batch that runs again after a failure leaves the same result. A
    re-run sees its own hashes as new: only entries of earlier batches count as seen.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = changed_only(batch, _seen_before(batch.sparkSession, store, batch_id)).persist()
        try:
            if handle is not None:
                handle(fresh, batch_id)
            fresh.select("path", "content_hash", "last_at").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        finally:
            fresh.unpersist()

    writer = settled.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


GATE_SCHEMA = "path string, ts timestamp, accepted boolean"


def _gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    failed_at = pd.Timestamp(state.get[0], unit="ms") if state.exists else None
    rows = []
    for event in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples():
        if event.kind == "failed":
            failed_at = event.ts
        elif event.kind == "success":
            failed_at = None
        else:
            rows.append((key[0], event.ts, failed_at is None or event.ts - failed_at > COOLDOWN))
    if failed_at is None:
        if state.exists:
            state.remove()
    else:
        millis = int(failed_at.value // 1_000_000)
        state.update((millis,))
        state.setTimeoutTimestamp(max(millis + int(COOLDOWN.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(rows, columns=["path", "ts", "accepted"])


def retry_gate(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Which requests of a path are let through: ``events(path, ts, kind)``, kind request, failed or success.

    A path whose last attempt failed is held back for 60 s. State lives only for paths in cool-down and times out.
    """
    return (
        events.withWatermark("ts", watermark)
        .groupBy("path")
        .applyInPandasWithState(_gate, GATE_SCHEMA, "failed_ms long", "append", GroupStateTimeout.EventTimeTimeout)
    )
