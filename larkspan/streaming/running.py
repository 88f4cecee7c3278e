"""Structured Streaming forms: windowed means with watermarks, sessions of detections, running backgrounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_means(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Mean and count of value by sliding window and event type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def detection_sessions(events: DataFrame, threshold: float, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Detections (value at least threshold) of a user that follow within gap: clusters in wall time."""
    hits = events.where(F.col("value") >= threshold).withWatermark("ts", late)
    return hits.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("best"))


def running_background(events: DataFrame) -> DataFrame:
    """user_id, n, mean: each user's mean so far, updated with each micro-batch; the state is two numbers a user."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [total / n if n else None]})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, n long, mean double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
