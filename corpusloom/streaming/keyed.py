"""Streams with keyed state and event-time timers: bursts of edits that changed something, and users who stop typing.

Both keep what is not settled yet and decide when the watermark has passed, so that the order in which rows arrive makes
no difference. State is held by Spark's RocksDB store and goes with the stream's checkpoint: a restarted stream goes on
where it was, and each result is emitted once. Set ``STATE_STORE`` before the stream starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from corpusloom.operators.metrics import IDLE_MS

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
WATERMARK = "10 seconds"
GAP_MS = 2200
# How long the digest of a path's last content is remembered after its last burst.
KEEP_MS = 30 * 24 * 3600 * 1000

BURST = "first long, last long, edits int, at long, content string, high boolean"
CHANGED = "path string, first_at timestamp, last_at timestamp, edits int, content string, priority string"
IDLE = "user_id long, last_at timestamp, idle_at timestamp"


def _moment(millis: int) -> pd.Timestamp:
    return pd.Timestamp(millis, unit="ms")


def _millis(column: pd.Series) -> list[int]:
    return (pd.to_datetime(column).astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()


def merged(bursts: list[tuple], gap_ms: int) -> list[tuple]:
    """Bursts less than a gap apart become one; the latest content counts (of several at one time, the greatest)."""
    out: list[tuple] = []
    for first, last, edits, at, content, high in sorted(bursts):
        if out and first - out[-1][1] < gap_ms:
            f, l, e, a, c, h = out.pop()
            a, c = max((a, c), (at, content))
            first, last, edits, at, content, high = f, max(l, last), e + edits, a, c, h or high
        out.append((first, last, edits, at, content, high))
    return out


class _Changes(StatefulProcessor):
    def __init__(self, gap_ms: int, keep_ms: int):
        self.gap_ms, self.keep_ms = gap_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", BURST)
        self.done = handle.getValueState("done", "digest string, until long")

    def _plan(self, bursts: list[tuple]) -> None:
        """One timer for each end of a burst, and one for the end of the memory."""
        self.open.clear()
        if bursts:
            self.open.put(bursts)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for _, last, *_ in bursts:
            self.handle.registerTimer(last + self.gap_ms)
        if self.done.exists():
            self.handle.registerTimer(self.done.get()[1])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found = [tuple(b) for b in self.open.get()] if self.open.exists() else []
        for frame in rows:
            found += [(t, t, 1, t, content, priority == "high") for t, content, priority in zip(_millis(frame["ts"]), frame["content"], frame["priority"])]
        self._plan(merged(found, self.gap_ms))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, left = expiredTimerInfo.getExpiryTimeInMs(), [], []
        for burst in sorted(tuple(b) for b in self.open.get()) if self.open.exists() else []:
            first, last, edits, _, content, high = burst
            if last + self.gap_ms > now:
                left.append(burst)
                continue
            digest = hashlib.sha256((content or "").encode()).hexdigest()
            if not self.done.exists() or self.done.get()[0] != digest:
                out.append((key[0], _moment(first), _moment(last), edits, content, "high" if high else "normal"))
            self.done.update((digest, last + self.gap_ms + self.keep_ms))
        if self.done.exists() and self.done.get()[1] <= now:
            self.done.clear()
        self._plan(left)
        if out:
            yield pd.DataFrame(out, columns=["path", "first_at", "last_at", "edits", "content", "priority"])


def changed_bursts(changes: DataFrame, gap_ms: int = GAP_MS, keep_ms: int = KEEP_MS, watermark: str = WATERMARK) -> DataFrame:
    """One row for each burst of edits of a path that left another content than its last burst did.

    ``changes(path, content, priority, ts)`` is a stream. The state of a path is its open bursts and one digest, which is
    forgotten ``keep_ms`` after the last burst: state is bounded by the paths that are alive.
    """
    rows = changes.select("path", F.coalesce("content", F.lit("")).alias("content"), "priority", "ts").withWatermark("ts", watermark)
    return rows.groupBy("path").transformWithStateInPandas(_Changes(gap_ms, keep_ms), CHANGED, "Append", "EventTime")


class _Idle(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times = set(self.times.get()[0]) if self.times.exists() else set()
        fresh = {t for frame in rows for t in _millis(frame["ts"])} - times
        for t in fresh:
            self.handle.registerTimer(t + self.idle_ms + 1)
        self.times.update((sorted(times | fresh),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        event = expiredTimerInfo.getExpiryTimeInMs() - self.idle_ms - 1
        times = list(self.times.get()[0]) if self.times.exists() else []
        later = [t for t in times if t > event]
        if later:
            self.times.update((later,))
        else:
            self.times.clear()
        if not any(t <= event + self.idle_ms for t in later):
            yield pd.DataFrame([(key[0], _moment(event), _moment(event + self.idle_ms))], columns=["user_id", "last_at", "idle_at"])


def idle_users(events: DataFrame, idle_ms: int = IDLE_MS, watermark: str = WATERMARK) -> DataFrame:
    """One row for each time a user stops: ``events(user_id, ts)`` -> user_id, last_at, idle_at.

    A timer of each event asks, when the watermark has passed, whether another one followed within ``idle_ms``. State is
    the moments that the watermark has not passed yet.
    """
    rows = events.select("user_id", "ts").withWatermark("ts", watermark)
    return rows.groupBy("user_id").transformWithStateInPandas(_Idle(idle_ms), IDLE, "Append", "EventTime")
