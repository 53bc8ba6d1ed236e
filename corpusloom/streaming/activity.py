"""Typing activity as a stream: a sliding approximation of the trailing window the batch operator computes exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.metrics import ACTIVITY_MS, clamp_chars, pressure

WATERMARK = "10 seconds"


def activity_stream(events: DataFrame, slide_ms: int = 400, watermark: str = WATERMARK) -> DataFrame:
    """Pressure of each user over windows of 3.2 s that start every ``slide_ms``: ``events(user_id, ts, chars)``.

    Partial sums are combined before the shuffle; state is dropped once the watermark passes a window.
    """
    window = F.window("ts", f"{ACTIVITY_MS} milliseconds", f"{slide_ms} milliseconds")
    summed = (
        events.withWatermark("ts", watermark)
        .groupBy(window.alias("w"), "user_id")
        .agg(F.sum(clamp_chars(F.col("chars"))).alias("chars_in_window"), F.count(F.lit(1)).alias("events_in_window"), F.max("ts").alias("last_at"))
    )
    idle = (F.unix_micros("w.end") - F.unix_micros("last_at")) / 1000
    return summed.select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "chars_in_window", "events_in_window",
        pressure(F.col("chars_in_window"), idle).alias("pressure"),
    )
