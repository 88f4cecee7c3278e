"""Starting centres for mixtures: distances-squared sampling in a few rounds over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(seed: int, turn: int, key: str = "ex") -> Column:
    """A number from 0 to below 1 for each key and turn, fixed by the seed: the top 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(turn), F.col(key).cast("long")), 11) / F.lit(float(1 << 53))


def spread_of(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(means, standard deviations) of the features of examples (x array); a constant feature has 1."""
    by = examples.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("f").toPandas()  # a row a feature
    s = by["s"].to_numpy()
    return by["m"].to_numpy(), np.where(s > 0, s, 1.0)


def _least(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance to the nearest centre, its number), the first on ties."""
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    return d.min(axis=1), d.argmin(axis=1)


def spread_centres(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of weighted points, each drawn by weight times its squared distance to those drawn before."""
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < k:
        mass = weights * _least(points, points[chosen])[0]
        if not mass.sum() > 0:
            break
        chosen.append(int(rng.choice(len(points), p=mass / mass.sum())))
    return points[chosen]


def centres(examples: DataFrame, k: int, seed: int, rounds: int = 4, each: float = 2.0) -> np.ndarray:
    """k starting centres, or as many as there are different rows, of examples (ex, x), in the examples' own units.

    Distances are between features less their mean by their standard deviation. The first candidate has the
    smallest draw. In each round a row becomes one with probability each k d / D, where d is its squared
    distance to the nearest candidate and D the sum over all rows; rows and rounds have draws of their own.
    So about rounds * each * k rows come to the driver, whatever the input, where the candidates, weighed by
    the rows nearest to them, are thinned out to k in the same way, one by one. Reruns agree."""
    mean, scale = spread_of(examples)
    rows = examples.select("ex", "x")
    first = rows.withColumn("_d", draw(seed, 0)).orderBy("_d", "ex").limit(1).toPandas()
    if not len(first):
        return np.empty((0, 0))
    found = (np.stack(first["x"].to_numpy()) - mean) / scale

    def near(with_draws: DataFrame, held: np.ndarray, total: float | None) -> DataFrame:
        """(ex, d, comp) of all rows, or where total is given (ex, x) of the rows that are drawn."""
        shared = examples.sparkSession.sparkContext.broadcast((held, mean, scale))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, mean, scale = shared.value
            for b in batches:
                if not len(b):
                    continue
                d, comp = _least((np.stack(b["x"].to_numpy()) - mean) / scale, held)
                if total is None:
                    yield pd.DataFrame({"d": [d.sum()], "comp": [None], "n": [0]}).astype({"comp": "Int64"})
                    counts = np.bincount(comp, minlength=len(held))
                    yield pd.DataFrame({"d": 0.0, "comp": pd.array(np.flatnonzero(counts), dtype="Int64"), "n": counts[counts > 0]})
                else:
                    yield b.loc[b["_d"].to_numpy() * total < each * k * d, ["ex", "x"]]

        return with_draws.mapInPandas(run, "d double, comp long, n long" if total is None else "ex long, x array<double>")

    for turn in range(1, rounds + 1):
        total = near(rows, found, None).agg(F.sum("d").alias("d")).first()["d"]
        if not total > 0:
            break
        more = near(rows.withColumn("_d", draw(seed, turn)), found, total).orderBy("ex").toPandas()
        if len(more):
            found = np.concatenate((found, (np.stack(more["x"].to_numpy()) - mean) / scale))
    counts = near(rows, found, None).where("comp IS NOT NULL").groupBy("comp").agg(F.sum("n").alias("n")).toPandas()  # a row a candidate
    weights = np.zeros(len(found))
    weights[counts["comp"].to_numpy()] = counts["n"].to_numpy()
    return spread_centres(found, weights, k, np.random.default_rng(seed)) * scale + mean
