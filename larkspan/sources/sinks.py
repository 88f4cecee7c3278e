"""Sinks: tables by run, mixture counts as text, WAV bytes."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_run(df: DataFrame, path: str, run: str, *by: str) -> None:
    """Rows under path/run=.../; writing a run again replaces that run alone."""
    rows = df.withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", *by).parquet(path)


def mixture_counts(affinities: DataFrame) -> DataFrame:
    """value: a line `components total c0 c1 ...` for each label, from (label, comp, n)."""
    by = affinities.groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("comp", "n"))).alias("c"))  # one row a component
    line = F.concat(F.array(F.col("k").cast("string"), F.col("total").cast("string")), F.transform("c", lambda x: x["n"].cast("string")))
    return by.select("label", F.array_join(line, " ").alias("value"))


def write_mixture_counts(affinities: DataFrame, path: str) -> None:
    mixture_counts(affinities).write.mode("overwrite").partitionBy("label").text(path)


def wav_bytes(signal: Column, rate: int) -> Column:
    """A signal in [-1, 1] as the bytes of a 16-bit mono WAV file; values beyond are cut, null stays null."""

    @F.pandas_udf("binary")
    def run(signals: pd.Series) -> pd.Series:
        def one(s: np.ndarray | None) -> bytes | None:
            if s is None:
                return None
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(rate)
                w.writeframes(np.rint(np.clip(s, -1, 1) * 32767).astype("<i2").tobytes())
            return out.getvalue()

        return signals.map(one, na_action=None).astype(object)

    return run(signal)
