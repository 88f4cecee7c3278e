"""Scans: parquet tables, WAV files with label tracks, label text files, arrays, settings."""

from __future__ import annotations

import ast
import configparser
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt, frame, phn, value: a user's events in time order, equal times by event_id, nulls last, as an utterance of one-frame labels."""
    order = W.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("utt"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("event_type").alias("phn"), "value"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, feat, x: one row a component."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("feat", "x")).select("vec_id", "label", "feat", F.col("x").cast("double").alias("x"))


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_rate, s: 16-bit mono WAV files, scaled by 1 / (2^15 - 1); others keep their first channel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    s = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())[:, 0] / 32767.0
                    yield pd.DataFrame({"path": [name], "sample_rate": [w.getframerate()], "s": [s]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "path string, sample_rate int, s array<double>")


def read_labels(spark: SparkSession, path: str, glob: str = "*.phn") -> DataFrame:
    """path, start, end, phn from text files with lines `start end label`."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema("start long, end long, phn string").csv(path, sep=" ")
    return rows.select(F.input_file_name().alias("path"), "start", "end", "phn")


def add_noise(signal: DataFrame, noise: DataFrame, db: float) -> DataFrame:
    """signal (key, s) with the noise array (one row, column s) tiled to its length and scaled so that the
    signal's norm is 10^(db / 20) times the noise's."""
    both = signal.crossJoin(F.broadcast(noise.select(F.col("s").alias("_n")).limit(1)))  # one row
    tiled = F.transform("s", lambda x, i: F.element_at("_n", (i % F.size("_n") + 1).cast("int")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    both = both.withColumn("_t", tiled)
    scale = norm("s") / norm("_t") / F.lit(10 ** (db / 20))
    both = both.withColumn("_k", scale)
    return both.withColumn("s", F.zip_with("s", "_t", lambda a, b: a + b * F.col("_k"))).drop("_n", "_t", "_k")


def read_npy(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """path, shape, x: numeric arrays in .npy files, one row a file, flattened in row order. Files with
    pickled objects are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"path": [name], "shape": [list(a.shape)], "x": [a.astype(np.float64).ravel()]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, shape array<int>, x array<double>")


def file_numbers(spark: SparkSession, path: str, pattern: str = r"([0-9]+)s\.npy$") -> DataFrame:
    """path, number: the files whose name holds the pattern, by its first group; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.withColumn("number", F.regexp_extract("path", pattern, 1)).where("number <> ''").withColumn("number", F.col("number").cast("long"))


def read_text_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, x: the numbers of white-space separated text files, one row a file."""
    text = F.split(F.btrim(F.regexp_replace("value", r"\s+", " ")), " ")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.transform(F.filter(text, lambda w: w != ""), lambda w: w.cast("double")).alias("x"))


def with_files(manifest: DataFrame, signals: DataFrame, labels: DataFrame) -> DataFrame:
    """manifest (utt, signal_path, label_path) with the signal s and the label rows as an array, for the
    utterances that have both. Paths are compared by what follows the last slash."""
    name = lambda c: F.substring_index(c, "/", -1)
    tracks = labels.groupBy(name("path").alias("_l")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "phn"))).alias("labels"))  # one utterance's labels
    out = manifest.withColumns({"_s": name("signal_path"), "_l": name("label_path")})
    return out.join(signals.select(name("path").alias("_s"), "s"), "_s").join(tracks, "_l").select("utt", "s", "labels")


def settings(path: str) -> dict[str, dict[str, object]]:
    """The sections of an INI file; values are Python literals or text, and `[name]` stands for that section.
    Nothing is evaluated as code."""
    parser = configparser.ConfigParser()
    parser.optionxform = str
    with open(path) as f:
        parser.read_file(f)
    out: dict[str, dict[str, object]] = {name: {} for name in parser.sections()}
    for name in out:
        for key, value in parser.items(name):
            inner = value.strip()[1:-1] if value.strip().startswith("[") else ""
            try:
                out[name][key] = out[inner] if inner in out else ast.literal_eval(value)
            except (ValueError, SyntaxError):
                out[name][key] = value
    return out
