"""Shared helpers: table reading, word splitting, and tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word contract here: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"

_fallback: dict[str, str] = {}
_roots: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Puts this package's folder on the path of Python workers that see it and don't have it there yet."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a file or a folder of part files, on any store that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which every executor sees.

    Where the setting is absent (tests, a single machine) a temporary folder serves;
    on a cluster that would be a machine-local path, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _fallback.setdefault("dir", tempfile.mkdtemp(prefix="larkspan-"))
    root = f"{base.rstrip('/')}/larkspan-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_forget, spark, root)
    return root


def _forget(spark: SparkSession, root: str) -> None:
    try:
        remove(spark, root)
    except Exception:  # the JVM may have gone already; the folder is only scratch space
        pass


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders through Spark's own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: a cut of the lineage that
    outlives executors, and a table whose size the planner knows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what written() made, when nothing reads it any more."""
    remove(df.sparkSession, *{f.rpartition("/")[0] for f in df.inputFiles()})


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array, JVM-side; null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANKS}]+"))


def count_of(text: Column, kind: str) -> Column:
    """How many of the text's code points match a regular expression for one character."""
    return F.regexp_count(text, F.lit(kind)).cast("long")


def by_share(rows: DataFrame, right: DataFrame, key: str, share: float) -> DataFrame:
    """rows joined with right (key, others, n), a written table with each key once and the number n of its rows.

    Keys that hold this share of all rows or more, so at most 1 / share keys, are broadcast, and their rows
    stay where they are; the rows of the others are shuffled by key."""
    total = right.agg(F.sum("n")).first()[0] or 0
    often = right.where(F.col("n") >= share * total).drop("n")
    rest = right.where(F.col("n") < share * total).drop("n")
    others = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(often), key).unionByName(others)
