"""Operator 4: SimHash near-duplicates, candidates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. At most 4 differing bits leave one of
these patterns: two segments with at most one error each, or one segment without any and two errors in
each of the others.

* Two segments with at most one error (three choices of the pair). The perfect Golay code [23, 12, 7]
  puts every 23-bit word within 3 bits of exactly one codeword. If two words differ in at most one bit,
  the codeword of the one lies within 4 bits of the other: it is among the codewords that the other and
  its 23 neighbours decode to, 5.3 of them on average. One side lists (nearby codewords of segment 1,
  codeword of segment 2), the other (codeword of segment 1, nearby codewords of segment 2), and a linked
  pair meets in one of these 24-bit keys.
* One segment without error and another with two: the clean segment and that third of the other segment
  which holds none of its errors, 25 to 31 bits.

Rows that share a key are compared in blocks, and only links that join what was apart are kept, so a
group of n near copies gives n - 1 links and not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from larkspan.llm.common import discard, remove, scratch_path, table, written

SEED = 42
SHINGLE = 4
MOST_BITS = 4
#: (first bit, bits) of the three segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the binary Golay code
#: Fingerprints of one key that are compared in one block; more are dealt over pairs of blocks.
BLOCK = 1 << 16
#: A key with this share of a table's rows is joined apart; there are at most as many as its inverse.
OFTEN = 1 / 1000
#: Parts over which the links of one node are dealt in a components round.
SALTS = 16


def fingerprint(text: bytes | None) -> int:
    """SimHash of a whole text: 4-word shingles of `[^\\x20\\x09-\\x0D]+` words, repeats included, A-Z in
    lower case, XXH64 with seed 42; a bit is 1 if set in over half of the hashes. No words: 0."""
    ws = (text or b"").lower().split()
    if not ws:
        return 0
    flat = b" ".join(ws)
    ends = np.cumsum([len(w) for w in ws]) + np.arange(len(ws))
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: max(1, len(ws) - SHINGLE + 1)].tolist(), ends[min(SHINGLE, len(ws)) - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(first)
    for at in range(0, n, 1 << 16):
        hashes = np.array([one(flat[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInPandas(run, "doc_id long, fp long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(codewords of the 4096 messages, and the codeword index that each of the 2^23 words decodes to).

    The code is perfect: its words and their changes in up to 3 bits fill the space once each."""
    messages = np.arange(4096, dtype=np.uint32)
    code = np.zeros(4096, np.uint32)
    for bit in range(12):
        code ^= np.where(messages >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0)).astype(np.uint32)
    near = np.full(1 << 23, 65535, np.uint16)
    ones = [1 << i for i in range(23)]
    errors = [0, *ones, *(a | b for i, a in enumerate(ones) for b in ones[:i]), *(a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j])]
    for e in errors:
        near[code ^ np.uint32(e)] = messages
    return code, near


def _nearby(words: np.ndarray, bits: int) -> np.ndarray:
    """For each word the codeword indices that it and its neighbours in one of the first `bits` bits decode
    to; repeats as -1."""
    near = _golay()[1]
    found = np.stack([near[words], *(near[words ^ np.uint32(1 << i)] for i in range(bits))], axis=1).astype(np.int32)
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key) of all keys of the fingerprints; a key's top bits tell its kind."""
    bits = fps.astype(np.int64).view(np.uint64)
    seg = [((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.uint32) for a, n in SEGMENTS]
    near, code = [_nearby(s, n) for s, (_, n) in zip(seg, SEGMENTS, strict=True)], [_golay()[1][s].astype(np.int64) for s in seg]
    rows, out = [], []
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for listed, plain, up in ((near[i], code[j], True), (near[j], code[i], False)):
            at, col = np.nonzero(listed >= 0)
            got = listed[at, col].astype(np.int64)
            rows.append(at)
            out.append((np.int64(kind) << 40) | ((got << 12 | plain[at]) if up else (plain[at] << 12 | got)))
    for kind, (clean, other) in enumerate(((0, 1), (1, 2), (2, 0)), start=3):
        n = SEGMENTS[other][1]
        cuts = [0, n // 3, 2 * n // 3, n]
        for part in range(3):
            piece = (seg[other] >> np.uint32(cuts[part])) & np.uint32((1 << (cuts[part + 1] - cuts[part])) - 1)
            rows.append(np.arange(len(bits)))
            out.append((np.int64(kind * 3 + part) << 40) | (seg[clean].astype(np.int64) << 8) | piece.astype(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (a fingerprint, one it is linked to) that join what fps holds as all links within MOST_BITS do.

    A search by breadth: who is reached leaves the set still to be compared, so a group of near copies costs
    little more than its size, and one of strangers at most the square of a block."""
    left, out = np.unique(fps.view(np.uint64)), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            head, front = front[0], front[1:]
            hit = np.bitwise_count(left ^ head) <= MOST_BITS
            if hit.any():
                new = left[hit]
                out += [(int(x), int(head)) for x in new.view(np.int64)]
                front, left = np.concatenate((front, new)), left[~hit]
    return [(x, int(np.uint64(h).astype(np.int64))) for x, h in out]


class Union:
    """Joins sets of integers; roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        at = x
        while (y := self.up.setdefault(at, at)) != at:
            at = y
        while self.up[x] != at:
            self.up[x], x = at, self.up[x]
        return at

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _stars(batches: Iterator[pd.DataFrame], links: Iterator) -> Iterator[pd.DataFrame]:
    union = Union()
    for a, b in links:
        union.join(a, b)
    got = [(x, union.root(x)) for x in union.up]
    got = [(a, b) for a, b in got if a != b]
    for at in range(0, len(got), 50_000):
        yield pd.DataFrame(got[at : at + 50_000], columns=["a", "b"])


def _block_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links among rows (key, cell, fp) that come sorted by key and cell, one group after the other."""

    def links() -> Iterator[tuple[int, int]]:
        held, open_group = [], None
        for b in batches:
            k, c, v = (b[n].to_numpy() for n in ("key", "cell", "fp"))
            cuts = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))).tolist() + [len(k)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if (k[s], c[s]) != open_group:
                    if sum(map(len, held)) > 1:
                        yield from forest(np.concatenate(held))
                    held, open_group = [], (k[s], c[s])
                held.append(v[s:e])
        if sum(map(len, held)) > 1:
            yield from forest(np.concatenate(held))

    yield from _stars(batches, links())


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) long with b < a: links among distinct fingerprints (fp) that connect just what all links do.

    A key with over `block` rows, by a count that is summed before it moves, is dealt by hash over g parts,
    and each two parts are compared in a task of their own. Rows alone in their key and parts are left out
    before Python sees them.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy()
            for at in range(0, len(fps), 4096):
                some = fps[at : at + 4096]
                rows, ks = keys(some)
                yield pd.DataFrame({"key": ks, "fp": some[rows]}).drop_duplicates()

    keyed = written(distinct.mapInPandas(emit, "key long, fp long"), "golay-keys")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    large = written(counts.where(F.col("n") > block), "golay-large")
    if large.isEmpty():
        cells = keyed.withColumn("cell", F.lit(0).cast("long"))
    else:
        part = F.pmod(F.xxhash64("fp"), F.col("_g"))
        other = F.sequence(F.lit(0).cast("long"), F.col("_g") - 1)
        cells = keyed.join(large.select("key", F.ceil(F.col("n") / (block // 2)).alias("_g")), "key", "left").withColumn("_g", F.coalesce("_g", F.lit(1).cast("long")))
        cells = cells.withColumn("_p", part).withColumn("_o", F.explode(other))
        cells = cells.select("key", "fp", (F.least("_p", "_o") * F.col("_g") + F.greatest("_p", "_o")).alias("cell"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a group has about `block` rows at most, and the window needs no exchange beyond this one
    dealt = cells.repartition(n, "key", "cell").withColumn("_n", F.count("*").over(W.partitionBy("key", "cell")))
    dealt = dealt.where("_n > 1").drop("_n").sortWithinPartitions("key", "cell")
    out = written(dealt.mapInPandas(_block_links, "a long, b long"), "golay-links")
    discard(keyed)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (a, b) the smallest node it is connected with.

    Rounds of large star and small star: a node links its larger neighbours, then its smaller ones and
    itself, to the smallest neighbour it has. Only smallest neighbours are gathered by node, summed before
    they move, and dealt over SALTS copies for the joins, so the links of one node, up to all of them, spread
    over as many tasks. Each round's edges are written, and the rounds end when the edges stay as they are.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")

    def met(edges: DataFrame, least: DataFrame) -> DataFrame:
        copies = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("n", "a")
        # sort-merge: the planner's sizes don't count the copies, so it might broadcast 16 times what it means to
        return edges.withColumn("_s", salt).join(copies.hint("merge"), ["a", "_s"])

    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"), None
    while (state := mark(now)) != before:
        before = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        large = met(both, least).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        mid = written(large.where("a <> b").distinct(), "cc")
        least = mid.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = met(mid, least).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("n", "m"))
        after = written(small.where("a <> b").distinct(), "cc")
        discard(mid)
        discard(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def rooted(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp, others) with root, the smallest fingerprint of the group."""
    roots = written(components(links(distinct.select("fp"), block)), "prints-roots")
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def survivors(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row): of rows (doc_id, text, row), where row tells rows apart and equal ones have equal texts, one for
    each group of near-duplicates: the smallest doc_id, null ids last, then the smallest row.

    The smallest is taken by fingerprint and then by group, summed before it moves each time."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in text], dtype=np.uint64).view(np.int64))

    prints = rows.select("doc_id", "row", fp(F.col("text").cast("binary")).alias("fp"))
    prints = written(prints, "prints")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    distinct = written(prints.groupBy("fp").agg(F.min(best).alias("best")), "prints-distinct")
    return rooted(distinct, block).groupBy("root").agg(F.min("best").alias("best")).select("best.row")


def by_key(rows: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """rows joined with right (key, others, n), a written table with each key once and its n rows of `rows`.

    Keys that hold a share of OFTEN or more are broadcast, so their rows, up to all of them, stay where they
    are; they are at most 1 / OFTEN, whatever the input. The rows of the others are shuffled by key."""
    total = right.agg(F.sum("n")).first()[0] or 0
    often = right.where(F.col("n") >= OFTEN * total).drop("n")
    rest = right.where(F.col("n") < OFTEN * total).drop("n")
    others = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(often), key).unionByName(others)


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among all documents that can be reached over links of at most 4
    differing bits, the document's own included. Texts are read once; what follows works on distinct
    fingerprints. Empty and null texts have fingerprint 0 and are linked like any other; repeated rows
    each get a row; a null doc_id never is a component's id unless all of its ids are null. An empty table
    gives no rows; a very long text is hashed in runs of shingles.
    """
    prints = written(fingerprints(docs), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "prints-distinct")
    named = written(rooted(distinct, block), "prints-rooted")
    smallest = written(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "prints-groups")
    named = by_key(named.select("fp", "root", F.col("rows").alias("_rows")), smallest, "root")
    named = written(named.select("fp", "component_id", F.col("_rows").alias("n")), "prints-named")
    return by_key(prints, named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
