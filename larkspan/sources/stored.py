"""Fitted models as tables: arrays by name, with metadata and a version, on any store that Spark writes."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The version of the layout; a model of another one isn't read.
VERSION = 1


def save_model(spark: SparkSession, path: str, kind: str, arrays: dict[str, np.ndarray], **metadata: object) -> None:
    """Writes a model of some kind, replacing what is at path: one row an array, and its kind, version and metadata."""
    told = json.dumps({"kind": kind, "version": VERSION} | metadata, sort_keys=True)
    rows = [(name, list(a.shape), a.astype(float).ravel().tolist(), told) for name, a in sorted(arrays.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, v array<double>, metadata string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, np.ndarray], dict]:
    """(arrays, metadata) of what save_model() wrote; another kind or version is an error."""
    rows = spark.read.parquet(path).collect()  # a model's arrays
    metadata = json.loads(rows[0]["metadata"])
    if (metadata["kind"], metadata["version"]) != (kind, VERSION):
        raise ValueError(f"{path} holds a {metadata['kind']} of version {metadata['version']}, not a {kind} of version {VERSION}")
    return {r["name"]: np.array(r["v"], float).reshape(r["shape"]) for r in rows}, metadata


def templates_table(spark: SparkSession, templates: np.ndarray) -> DataFrame:
    """(comp, dt, feat, p) of templates by component, frame and feature."""
    rows = [(k, t, f, float(p)) for k, one in enumerate(templates) for t, frame in enumerate(one) for f, p in enumerate(frame)]
    return spark.createDataFrame(rows, "comp int, dt int, feat int, p double")


def filters_of(templates: DataFrame, background: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bank: comp, dt, f, w; bias: comp, len, c) of templates (comp, dt, feat, p) against a background (feat, p), as
    detection takes them."""
    b = background.select("feat", F.col("p").alias("b"))
    p, q = F.col("p"), F.col("b")
    cells = templates.join(b, "feat").select("comp", "dt", F.col("feat").alias("f"), F.ln(p / q * (1 - q) / (1 - p)).alias("w"), F.ln((1 - p) / (1 - q)).alias("c"))
    return cells.drop("c"), cells.groupBy("comp").agg((F.max("dt") + 1).alias("len"), F.sum("c").alias("c"))
