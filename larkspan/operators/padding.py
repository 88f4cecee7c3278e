"""Padding of examples with noise that is a function of seed, example and cell: the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *at: Column) -> Column:
    """From 0 to below 1: the first 52 bits of the MD5 hash of the seed and the place, joined by colons."""
    text = F.concat_ws(":", F.lit(str(seed)), *[a.cast("string") for a in at])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def normal(seed: int, *at: Column) -> Column:
    """A standard normal value, from two uniform ones."""
    u, v = (uniform(seed, *at, F.lit(k)) for k in (0, 1))
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * F.pi() * v)


def _missing(examples: DataFrame, length: int) -> DataFrame:
    """(ex, dt) of the frames that examples (ex, len) lack to the full length."""
    dt = F.explode(F.sequence(F.greatest("len", F.lit(0)).cast("long"), F.lit(length - 1).cast("long")))
    return examples.where(F.col("len") < length).select("ex", dt.alias("dt"))


def pad_bits(bits: DataFrame, examples: DataFrame, background: Sequence[float], length: int, seed: int) -> DataFrame:
    """(ex, dt, feat) of examples' bits and, in the frames they lack to `length`, of bits that are set with each
    feature's probability in background. Examples (ex, len) that are as long or longer stay as they are."""
    cells = _missing(examples, length).select("ex", "dt", F.posexplode(F.array(*[F.lit(float(p)) for p in background])).alias("feat", "p"))
    noise = cells.where(uniform(seed, F.col("ex"), F.col("dt"), F.col("feat")) <= F.col("p"))
    return bits.select("ex", "dt", "feat").unionByName(noise.select("ex", "dt", "feat"))


def pad_values(values: DataFrame, examples: DataFrame, means: Sequence[float], spreads: Sequence[float], length: int, seed: int) -> DataFrame:
    """(ex, dt, feat, x) likewise for real-valued features, with normal noise of each feature's mean and spread; a
    spread of 0 pads with the mean alone."""
    stats = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(means, spreads, strict=True)])
    cells = _missing(examples, length).select("ex", "dt", F.posexplode(stats).alias("feat", "_st"))
    x = F.col("_st.m") + F.col("_st.s") * normal(seed, F.col("ex"), F.col("dt"), F.col("feat"))
    return values.select("ex", "dt", "feat", "x").unionByName(cells.select("ex", "dt", "feat", x.alias("x")))
