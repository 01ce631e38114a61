"""Event streams: counts in windows, rate limits, idempotent intake, throttled capture.

Inputs need a ``ts`` of type timestamp (watermarks refuse timestamp_ntz).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timeline_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def rate_violations(events: DataFrame, key: str = "user_id", most: int = 100, size: str = "60 seconds", step: str = "1 second", late: str = "10 seconds") -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select(F.col("window.end").alias("at"), key, "n")


def idempotent(events: DataFrame, key: str = "idempotency_key", keep: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", keep).dropDuplicatesWithinWatermark([key])


def throttled(events: DataFrame, gap_minutes: int = 10) -> DataFrame:
    """user_id, first_ts, last_ts, n: a session's events gathered until ``gap_minutes`` after the last emission."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n, sent = state.get if state.exists else (0, 0, 0)
        rows = []
        ts = sorted(int(t.value // 1000) for f in frames for t in f["ts"])
        for t in ts:
            first, n = (first or t), n + 1
            if t - (sent or first) >= gap_minutes * 60_000_000:
                rows.append((key[0], pd.Timestamp(first, unit="us"), pd.Timestamp(t, unit="us"), n))
                first, n, sent = 0, 0, t
            elif not sent:
                sent = first
        state.update((first, n, sent))
        if rows:
            yield pd.DataFrame(rows, columns=["user_id", "first_ts", "last_ts", "n"])

    return events.groupBy("user_id").applyInPandasWithState(gather, "user_id long, first_ts timestamp, last_ts timestamp, n long", "first long, n long, sent long", "append", GroupStateTimeout.NoTimeout)
