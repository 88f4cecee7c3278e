"""Table functions for SQL: windows of an ordered table, patches of an array. register() makes them known to a session."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class _Windows:
    """windows_of(TABLE(t) PARTITION BY (utt) ORDER BY (frame), width, hop): each whole window of t's values (utt,
    frame, value). A task holds one window, however long the utterance is. Null values count as 0."""

    def __init__(self) -> None:
        self.held: deque[float] = deque()
        self.seen = 0

    def eval(self, row: Row, width: int, hop: int) -> Iterator[tuple]:
        if self.seen == 0:
            self.held = deque(maxlen=width)
        self.held.append(0.0 if row["value"] is None else float(row["value"]))
        self.seen += 1
        if self.seen >= width and (self.seen - width) % hop == 0:
            yield row["utt"], (self.seen - width) // hop, list(self.held)


class _Patches:
    """patches_of(array, width, step): each whole patch of neighbouring values, with its first position."""

    def eval(self, values: list[float], width: int, step: int) -> Iterator[tuple]:
        for at in range(0, len(values or ()) - width + 1, step):
            yield at, values[at : at + width]


def register(spark: SparkSession) -> None:
    """Registers windows_of and patches_of for spark.sql; rows pass to and from Python as Arrow batches."""
    spark.udtf.register("windows_of", udtf(_Windows, returnType="utt bigint, win bigint, s array<double>", useArrow=True))
    spark.udtf.register("patches_of", udtf(_Patches, returnType="start int, s array<double>", useArrow=True))
