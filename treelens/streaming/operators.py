"""Structured Streaming operators; each has a batch twin with the same rows.

Late data: an old clock never reopens a bucket, so the watermark has no delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SECONDS = 60


def rolling_counters(events: DataFrame) -> DataFrame:
    """(event_type, sec, rolled): sum over the last 60 seconds, this one included.

    Seconds are summed first, with partial aggregation, so a busy lane's window has a row per second.
    """
    per = events.groupBy("event_type", "sec").agg(F.sum("value").alias("v"))
    w = Window.partitionBy("event_type").orderBy("sec").rangeBetween(1 - WINDOW_SECONDS, 0)
    return per.select("event_type", "sec", F.sum("v").over(w).cast("decimal(28,2)").alias("rolled"))


def stream_counters(events: DataFrame) -> DataFrame:
    """The same sums for a stream with an event time ``ts``: a sliding window per second."""
    seen = events.withWatermark("ts", "0 seconds")
    slide = F.window("ts", f"{WINDOW_SECONDS} seconds", "1 second")
    return seen.groupBy(slide.alias("w"), "event_type").agg(F.sum("value").alias("rolled")).select(
        "event_type", (F.unix_timestamp("w.end") - 1).alias("sec"), "rolled"
    )


def coalesce_updates(events: DataFrame) -> DataFrame:
    """(user_id, library, latest): a slow reader gets only the newest update per library."""
    newest = F.max_by("event_id", F.struct("sec", "event_id"))
    return events.groupBy("user_id", "library").agg(newest.alias("latest"))


def fan_out(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Each event to each subscriber of its library; a stream joins a static table."""
    return events.join(subscribers, "library")


def once_per(events: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """At most one event per key within a gap of event time (suppressed fault reports)."""
    return events.withWatermark("ts", gap).dropDuplicatesWithinWatermark(keys)


def liveness(pings: DataFrame, timeout: str = "90 seconds") -> DataFrame:
    """Sessions of a client: it is gone once no ping came for the timeout."""
    return pings.withWatermark("ts", timeout).groupBy(F.session_window("ts", timeout).alias("w"), "client").agg(
        F.count(F.lit(1)).alias("pings")
    )


def stream_token_bucket(events: DataFrame, key: str, capacity: float, refill_seconds: float) -> DataFrame:
    """(event_id, allowed) with the bucket of each key as state; rows of a batch go by time."""

    def step(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["sec", "event_id"])
        tokens, last = state.get if state.exists else (float(capacity), None)
        allowed = []
        for sec in rows["sec"]:
            if last is not None:
                tokens = min(capacity, tokens + max(0, sec - last) / refill_seconds)
            last = int(sec) if last is None else max(last, int(sec))
            allowed.append(bool(tokens >= 1))
            tokens -= 1 if tokens >= 1 else 0
        state.update((float(tokens), last))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    return events.groupBy(key).applyInPandasWithState(
        step, "event_id long, allowed boolean", "tokens double, last long", "append", "NoTimeout"
    )
