"""Operator 9: exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from larkspan.llm.common import table, written

BITS = 64
SEGMENT = 16
PARTS = BITS // SEGMENT
#: Distinct codes of a block that is indexed in one task, and queries that are answered together there.
CODES, QUERIES = 1 << 18, 1 << 9


def code(vector: Column) -> Column:
    """A vector's 64 signs as a long, bit i set if component i is over 0; null if it hasn't 64 components.
    A null component counts as not over 0."""
    bit = lambda i: F.when(F.coalesce(F.get(vector, F.lit(i)) > 0, F.lit(False)), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    out = bit(0)
    for i in range(1, BITS):
        out = out.bitwiseOR(bit(i))
    return F.when(F.size(vector) == BITS, out)


@cache
def _masks(radius: int) -> np.ndarray:
    """The segment values with exactly `radius` bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), radius)], np.uint16)


class Index:
    """Distinct codes of a block with the ids of each, sorted by each segment's value."""

    def __init__(self, codes: np.ndarray, ids: list[np.ndarray]) -> None:
        self.codes, self.ids = codes, ids
        segments = codes.view("<u2").reshape(-1, PARTS)
        self.order = [np.argsort(segments[:, p], kind="stable") for p in range(PARTS)]
        self.first = [np.searchsorted(segments[o, p], np.arange((1 << SEGMENT) + 1)) for p, o in enumerate(self.order)]

    def nearest(self, query: np.uint64, k: int, asker: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest distinct ids but the asker's, by distance and id; an id of several
        codes counts once, at its smallest distance.

        After all segments were probed up to radius r, and the first p at r + 1, whatever is not seen yet
        differs in at least PARTS * (r + 1) + p bits: the radii grow one segment at a time until the codes
        verified below that hold k such ids, or everything has been seen.
        """
        own = np.array([query], np.uint64).view("<u2")
        seen = np.zeros(len(self.codes), bool)
        at, dist = np.empty(0, np.int64), np.empty(0, np.uint8)
        for radius in range(SEGMENT + 1):
            masks = _masks(radius)
            for p in range(PARTS):
                keys = own[p] ^ masks
                lo, hi = self.first[p][keys], self.first[p][keys.astype(np.int64) + 1]
                full = hi > lo
                if full.any():
                    n = (hi - lo)[full]
                    spans = np.repeat(lo[full] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    new = self.order[p][spans]
                    new = new[~seen[new]]
                    seen[new] = True
                    at = np.concatenate((at, new))
                    dist = np.concatenate((dist, np.bitwise_count(self.codes[new] ^ query)))
                covered = PARTS * radius + p  # distances up to this one are complete
                if len(at) == len(self.codes):
                    return self._first(at, dist, k, asker)
                below = dist <= covered
                if below.any():
                    found, far = self._first(at[below], dist[below], k, asker)
                    if len(found) == k:
                        return found, far
        return self._first(at, dist, k, asker)

    def _first(self, at: np.ndarray, dist: np.ndarray, k: int, asker: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k distinct ids of the codes at these places, and their distances."""
        ids = np.concatenate([self.ids[i] for i in at.tolist()]) if len(at) else np.empty(0, np.int64)
        far = np.repeat(dist, [len(self.ids[i]) for i in at.tolist()])
        order = np.lexsort((ids, far))
        order = order[ids[order] != asker]
        first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
        return ids[order[first]], far[order[first]]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, codes: int = CODES, per_cell: int = QUERIES) -> DataFrame:
    """query_id, rank (1 to k), neighbor_id, distance: for each query (id, code) the k rows (id, code) at the
    smallest Hamming distance, ties by smallest id, the query's own id left out. Exact.

    Equal codes are searched once: a code keeps its k + 1 smallest ids, cut in each partition before they
    meet, so a code that a third of the rows share moves few rows. Distinct codes are dealt over blocks,
    queries over cells; a task indexes one block, answers one cell of queries, and returns the ids up to
    the kth distance, ties cut by id. Null codes and ids neither ask nor answer; a repeated id counts once,
    at its smallest distance; fewer than k rows give fewer ranks; without rows or without queries there are none.
    Other columns are left out, whatever their names.
    """
    spark = rows.sparkSession
    by_id = W.partitionBy("code").orderBy("id")
    kept = rows.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    kept = kept.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    index = written(kept.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "topk-index")
    asked = written(queries.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct(), "topk-queries")
    blocks, cells = max(1, -(-index.count() // codes)), max(1, -(-asked.count() // per_cell))
    number = lambda what, n: F.pmod(F.xxhash64(what), F.lit(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = index.select(number("code", blocks).alias("block"), F.explode(every(cells)).alias("cell"), F.lit(None).cast("long").alias("id"), "code", "ids")
    right = asked.select(F.explode(every(blocks)).alias("block"), number("id", cells).alias("cell"), "id", "code", F.lit(None).cast("array<long>").alias("ids"))

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        here = pdf["id"].isna().to_numpy()
        own = Index(pdf["code"].to_numpy()[here].view(np.uint64), [np.asarray(x, np.int64) for x in pdf["ids"].to_numpy()[here]])
        out: list[tuple[int, int, int]] = []
        if here.any():
            for q, c in zip(pdf["id"].to_numpy()[~here].astype(np.int64).tolist(), pdf["code"].to_numpy()[~here].view(np.uint64), strict=True):
                found, far = own.nearest(c, k, q)
                out += [(q, i, d) for i, d in zip(found.tolist(), far.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "neighbor_id", "distance"])

    found = left.unionByName(right).groupBy("block", "cell").applyInPandas(search, "query_id long, neighbor_id long, distance int")
    found = found.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbor_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 20, among all vectors, by signs."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.where(F.col("id") % 20 == 0))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, len(list_filter(range(1, 65), lambda i: q.b[i] <> r.b[i])) AS distance
  FROM e q JOIN e r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, distance::INTEGER AS distance FROM n WHERE rank <= 10
"""
