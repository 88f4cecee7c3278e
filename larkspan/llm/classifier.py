"""Operator 7: quality classifier, a logistic regression on hashed word n-grams, trained by FTRL-Proximal."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import table

#: Hash space of the weights; at most so many labelled documents are learnt from.
BITS = 20
TRAIN_ROWS = 6000
EPOCHS = 2
#: Letters, digits and other characters beyond ASCII to one byte each, the rest as it stands.
CLASSES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


#: Words that are turned into n-grams at once.
CHUNK = 1 << 17
#: (of words or shapes, words in an n-gram).
FAMILIES = (("word", 1), ("word", 2), ("shape", 1), ("shape", 2), ("shape", 3))


def vectors(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse inputs of whole texts as (text's place, hash slot, value), sorted by place in each family.

    Families are n-grams of lower-cased words (1, 2) and of word shapes (1, 2, 3): the classes of a word's
    first and last three characters, marked if the word before is the same. A value is the square root of
    the slot's share in its family's n-grams of that text.
    """
    parts = [(t or b"").split() for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = list(chain.from_iterable(parts))
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    joined = b" ".join(flat)
    h = np.fromiter(map(zlib.crc32, joined.lower().split(b" ")), np.uint64, len(flat))
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    last = np.cumsum(length + 1) - 2
    kinds = np.frombuffer(joined.translate(CLASSES), np.uint8)
    shape = kinds[last - length + 1].astype(np.uint64)
    for back in range(3):
        shape = shape << np.uint64(8) | np.where(length > back, kinds[np.maximum(last - back, 0)], 0).astype(np.uint64)
    place = np.repeat(np.arange(len(texts)), sizes)
    same = (h[1:] == h[:-1]) & (place[1:] == place[:-1])
    shape[1:] += same.astype(np.uint64) << np.uint64(33)
    out = []
    for kind, (view, n) in enumerate(FAMILIES, start=1):
        units, m = (h if view == "word" else shape), len(h) - n + 1
        if m < 1:
            continue
        acc = np.full(m, kind, np.uint64)
        for i in range(n):
            acc = (acc ^ units[i : m + i]) * _MIX[0]
            acc ^= acc >> np.uint64(29)
        slot = (acc * _MIX[1]) >> np.uint64(64 - BITS)
        both = (place[:m].astype(np.uint64) << np.uint64(BITS) | slot)[place[:m] == place[n - 1 :]]
        both.sort()
        cut = np.flatnonzero(np.concatenate((both[:1] == both[:1], both[1:] != both[:-1])))
        count = np.diff(np.append(cut, len(both)))
        where = (both[cut] >> np.uint64(BITS)).astype(np.int64)
        out.append((where, (both[cut] & np.uint64((1 << BITS) - 1)).astype(np.int64), np.sqrt(count / (sizes[where] - n + 1))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def chunks(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Runs of texts with about CHUNK words by their length; one text alone if it is longer."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or b"") // 4
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


class Model(NamedTuple):
    weights: np.ndarray  # float32, one a slot; the last is the bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """The probability of label 1 for each whole text: a sparse dot product and the bias."""
        out = [np.empty(0)]
        for some in chunks(texts):
            place, slot, value = vectors(some)
            z = self.weights[-1] + np.bincount(place, self.weights[slot] * value, len(some))
            out.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        return np.concatenate(out)


def train(texts: list[bytes | None], labels: np.ndarray, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = EPOCHS) -> Model:
    """FTRL-Proximal: per-coordinate steps over the rows in their order, epochs times; classes weigh alike.
    No rows give a model that scores 0.5 everywhere."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    share = np.clip(np.mean(labels) if len(labels) else 0.5, 0.05, 0.95)
    weigh = {1: 0.5 / share, 0: 0.5 / (1 - share)}

    def solved(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        done = 0
        for some in chunks(texts):  # inputs are made anew each epoch; kept, they would be 40 times the weights
            place, slot, value = vectors(some)
            order = np.argsort(place, kind="stable")
            slot, value = slot[order], value[order]
            cuts = np.searchsorted(place[order], np.arange(len(some) + 1)).tolist()
            for k, y in enumerate(labels[done : done + len(some)].tolist()):
                at, x = np.append(slot[cuts[k] : cuts[k + 1]], size - 1), np.append(value[cuts[k] : cuts[k + 1]], 1.0)
                w = solved(at)
                p = 1 / (1 + np.exp(-np.clip((w * x).sum(), -35, 35)))  # w @ x may wait forever in a threaded library on a driver
                g = weigh[y] * (p - y) * x
                step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
                z[at] += g - step * w
                n[at] += g * g
            done += len(some)
    return Model(solved(slice(None)).astype(np.float32))


def held_out() -> F.Column:
    """True for rows that never serve for learning: crc32 of doc_id as text leaves remainder 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns `labels.quality` from at most train_rows labelled documents outside the held-out third.

    The rows are those whose ids hash lowest, so they are spread over the table and the same each time;
    they are chosen among the ids first, so that one scan of the texts meets a small table. Of rows that
    share an id the smallest text serves, chosen before anything comes to the driver, which so holds at most
    train_rows whole texts. Null texts are empty; empty tables give the model that scores 0.5 everywhere.
    """
    chosen = labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).join(F.broadcast(chosen), "doc_id")  # chosen: at most train_rows rows of two numbers
    got = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas()
    got = got.assign(o=[zlib.crc32(b"%d" % d) for d in got["doc_id"]]).sort_values(["o", "doc_id"])
    return train([bytes(t) for t in got["text"]], got["quality"].to_numpy(np.int64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score: the probability of label 1, from the whole text; empty and null texts get the bias. Repeated
    rows each get their score, and an empty table has no rows; a very long text is turned into inputs alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)  # 4 MB, whatever the input
    out = docs.drop("score").withColumn("score", F.lit(0.0))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(Model(shared.value).scores(list(text)), dtype="float64")

    return out.withColumn("score", score(F.col("text").cast("binary")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents; null ids aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
