"""Streaming forms: heartbeat state with expiry, probe windows, append logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REGISTRY = "worker string, event string, last_seen timestamp, queue_length long, beats long"
_STATE = "last_seen timestamp, queue_length long, beats long"


def registry(beats: DataFrame, ttl_seconds: int = 30, delay: str = "10 seconds") -> DataFrame:
    """Worker registry over a stream (worker, ts, queue_length): an update per batch and worker, and 'expired' once no heartbeat came for the time to live in event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, queue, n = state.get
            state.remove()
            yield pd.DataFrame({"worker": [key[0]], "event": ["expired"], "last_seen": [last], "queue_length": [queue], "beats": [n]})
            return
        last, queue, n = state.get if state.exists else (None, 0, 0)
        for b in batches:
            if b.empty:
                continue
            n += len(b)
            top = b.sort_values("ts").iloc[-1]
            if last is None or top["ts"] >= last:
                last, queue = top["ts"], int(top["queue_length"])
        if last is None:
            return
        state.update((last, queue, n))
        due = int(last.timestamp() * 1000) + ttl_seconds * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"worker": [key[0]], "event": ["beat"], "last_seen": [last], "queue_length": [queue], "beats": [n]})

    return beats.withWatermark("ts", delay).groupBy("worker").applyInPandasWithState(step, REGISTRY, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, at: str, size: str, slide: str | None, key: str, value: str, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key, late rows dropped after the delay."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def session_counts(events: DataFrame, at: str, gap: str, key: str, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def append_stream(rows: DataFrame, path: str, checkpoint: str, at: str):
    """An append-only log, a folder per day, exactly once by its checkpoint."""
    return rows.withColumn("date", F.to_date(at)).writeStream.format("json").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stop_trimmed(text, stop: str):
    """A chunk's text without the stop string at its end."""
    return F.when(F.endswith(text, F.lit(stop)), F.substring(text, F.lit(1), F.length(text) - len(stop))).otherwise(text)
