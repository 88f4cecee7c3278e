"""Operator 11: join of documents by the Jaccard similarity of their word 5-grams.

Rows meet in tiles: they share a shingle of their prefixes and lie in neighbouring bands of set sizes. In a
tile, hashed bitmaps of the sets are held against each other; the bits that differ bound the overlap from
above, and only pairs that pass have their sorted arrays intersected.

* Prefixes. Sets that link share one of the first floor(a / 5) + 1 shingles of each, in any order of all
  shingles. The order is that of hashes, but shingles that too many rows hold go to the end, rarer ones first;
  a table of fixed size tells them, from a sample of the texts, so every text's prefix is made as it is first read.
* Bitmaps. A set of n shingles has the parities of its hashes in at least n bits. Two sets differ in at least
  as many shingles as their bitmaps, brought to one width, differ in bits; they link if they differ in a
  ninth of their sizes' sum or less.
* Two rounds. First each row meets others in one tile only, and most links are found. Then the tiles that
  hold rows of several components are searched for the links between components, of which one is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from larkspan.llm.common import by_share, discard, table, written
from larkspan.llm.simhash import Union, components

SHINGLE = 5
SEED = 11
#: Sets link if 100 * intersection >= 80 * union; that is, if 9 * (shingles in one of them only) <= sum of sizes.
LEAST = 80
#: Rows of a tile that are compared in one task; more are dealt over pairs of parts.
BLOCK = 2048
#: Shingles of the sets that one task compares; more are dealt likewise.
WEIGHT = 1 << 22
#: A key with this share of all rows or more is joined by broadcast; there are at most as many as its inverse.
OFTEN = 1 / 1000
#: Bits of the address of a shingle in the table of levels, which every task holds: a byte each, 1 MB.
ADDRESS = 20
#: Bits of the address of a word in the bitmap of wanted texts, which is broadcast: 2^17 words of 64 bits at most.
WANTED = 17


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; the whole of a text with fewer words; none without words."""
    ws = (text or b"").lower().split()
    if not ws:
        return np.empty(0, np.int64)
    flat = b" ".join(ws)
    ends = np.cumsum([len(w) for w in ws]) + np.arange(len(ws))
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: max(1, len(ws) - SHINGLE + 1)].tolist(), ends[min(SHINGLE, len(ws)) - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    return np.unique(np.array([one(flat[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64).view(np.int64))


def bitmap(held: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes by their low bits, as 64-bit words: a power of two of bits, one a shingle or more."""
    width = max(64, 1 << (len(held) - 1).bit_length())
    return np.packbits(np.bincount(held & (width - 1), minlength=width) & 1, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap brought to fewer words: bits that fall together add up as parities do."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def prefix(n: int) -> int:
    """How many shingles of a set of n another set must meet in to link: at most this many are the other's not."""
    return n * (100 - LEAST) // 100 + 1


def band(n: np.ndarray) -> np.ndarray:
    """Sets that link lie in the same band of sizes or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(100 / LEAST) + 1e-9).astype(np.int64)


def candidates(n: np.ndarray, bits: list[np.ndarray], group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of positions that may link by their bitmaps, i and j of different groups, tile by tile of
    size bands; each pair once."""
    order = np.argsort(n, kind="stable")
    bands = band(n[order])
    starts = np.searchsorted(bands, np.unique(bands))
    for s in starts.tolist():
        t = bands[s]
        own, end = np.searchsorted(bands, t, "right"), np.searchsorted(bands, t + 1, "right")
        if end - s < 2:
            continue
        at = order[s:end]
        words = min(len(bits[i]) for i in at[: own - s])
        held = np.stack([folded(bits[i], words) for i in at])
        size = n[at]
        step = max(1, (1 << 22) // (words * len(at)))
        for a in range(0, own - s, step):
            b = min(a + step, own - s)
            apart = np.bitwise_count(held[a:b, None, :] ^ held[None, a:, :]).sum(axis=2, dtype=np.int64)
            ok = (9 * apart <= size[a:b, None] + size[None, a:]) & (group[at[a:b], None] != group[None, at[a:]])
            i, j = np.nonzero(ok)
            keep = i < j
            if keep.any():
                yield at[a + i[keep]], at[a + j[keep]]


def linked(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Which of many sorted arrays link with one, by their intersections."""
    sizes = np.array([len(x) for x in many])
    flat = np.concatenate(many)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
    return 100 * both >= LEAST * (len(one) + sizes - both)


def forest(rows: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (row, row) that connect what all links among the sets do.

    A search by breadth: who is reached isn't compared any more, so near copies cost little more than their number."""
    n, bits, out = np.array([len(x) for x in sets]), [bitmap(x) for x in sets], []
    wide, stacked = np.array([len(x) for x in bits]), {}
    left = np.argsort(n, kind="stable")
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            head = front.pop()
            near = left[(100 * n[left] >= LEAST * n[head]) & (LEAST * n[left] <= 100 * n[head])]
            if not len(near):
                continue
            words = int(min(wide[head], wide[near].min()))
            if words not in stacked:
                stacked[words] = np.stack([folded(x, words) if len(x) >= words else np.zeros(words, np.uint64) for x in bits])
            apart = np.bitwise_count(stacked[words][near] ^ stacked[words][head]).sum(axis=1, dtype=np.int64)
            near = near[9 * apart <= n[near] + n[head]]
            if len(near):
                near = near[linked(sets[head], [sets[i] for i in near])]
                out += [(int(rows[i]), int(rows[head])) for i in near]
                front += near.tolist()
                left = left[~np.isin(left, near)]
    return out


def bridges(hub: int, rows: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (row, row) that join rows of the root hub with those of others, one for each two that have any, or
    none where others have joined them."""
    union, out = Union(), []
    for i, j in candidates(np.array([len(x) for x in sets]), [bitmap(x) for x in sets], root):
        ours = (root[i] == hub) | (root[j] == hub)
        i, j = i[ours], j[ours]
        for at in np.unique(i):
            near = np.array([x for x in j[i == at] if union.root(int(root[x])) != union.root(int(root[at]))], np.int64)
            if not len(near):
                continue
            for x in near[linked(sets[at], [sets[x] for x in near])]:
                if union.root(int(root[x])) != union.root(int(root[at])):
                    union.join(int(root[x]), int(root[at]))
                    out.append((int(rows[at]), int(rows[x])))
    return out


def _runs(batches: Iterator[pd.DataFrame], by: list[str], cols: list[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(values of by, arrays of cols) of each group of rows that come sorted by `by`."""
    held: tuple[tuple, list] | None = None
    close = lambda parts: [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts, strict=True)]
    for b in batches:
        if not len(b):
            continue
        keys, vals = [b[c].to_numpy() for c in by], [b[c].to_numpy() for c in cols]
        new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(b)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            k, part = tuple(x[s] for x in keys), [v[s:e] for v in vals]
            if held and held[0] == k:
                held[1].append(part)
                continue
            if held:
                yield held[0], close(held[1])
            held = (k, [part])
    if held:
        yield held[0], close(held[1])


def _bits(col: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in col]


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 4096) -> Iterator[pd.DataFrame]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def identity(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def levels(docs: DataFrame, block: int) -> np.ndarray:
    """For each address of a shingle the eighths of an octave by which, about, over `block` texts hold the most
    frequent shingle there, or zero.

    It is counted on the texts whose hash falls in one of `block` / 64 parts, so that `block` texts are some 64 of these.
    It serves for the order of shingles alone, which may be any, so neither this nor shared addresses lose a link."""
    k = max(1, block // 64)
    texts = docs.select(identity(F.col("text")).alias("t"), F.col("text").cast("binary").alias("text"))
    once = texts.where(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(k)) == 0).groupBy("t").agg(F.any_value("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["text"]:
                yield pd.DataFrame({"key": shingles(x)})

    counts = once.select("text").mapInPandas(run, "key long").groupBy("key").agg((F.count("*") * k).alias("n")).where(F.col("n") > block)
    level = F.least(F.floor(8 * F.log2(F.col("n") / block)) + 1, F.lit(255)).cast("int")
    found = counts.groupBy(F.shiftrightunsigned("key", 64 - ADDRESS).alias("at")).agg(F.max(level).alias("level")).toArrow()
    out = np.zeros(1 << ADDRESS, np.uint8)
    out[found["at"].to_numpy()] = found["level"].to_numpy()
    return out


def first(held: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The prefix of a sorted set: shingles at low levels come before those at higher ones, equal ones by hash."""
    if not len(held):
        return held
    return held[np.argsort(level[held.view(np.uint64) >> np.uint64(64 - ADDRESS)], kind="stable")[: prefix(len(held))]]


def prints(docs: DataFrame, block: int) -> DataFrame:
    """(doc_id, t, size, bits, keys) of docs (doc_id, text): what tells a text, its number of shingles, their
    bitmap, and the first of their hashes, frequent ones last."""
    order = docs.sparkSession.sparkContext.broadcast(levels(docs, block))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at : at + 256]
                sets = [shingles(x) for x in some["text"]]
                yield some[["doc_id", "t"]].astype({"doc_id": "Int64"}).assign(size=[len(x) for x in sets], bits=[bitmap(x).tobytes() if len(x) else b"" for x in sets], keys=[first(x, order.value) for x in sets])

    rows = docs.select(F.col("doc_id").cast("long"), identity(F.col("text")).alias("t"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "doc_id long, t binary, size long, bits binary, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, held): the shingles of the texts of wanted (row, t), read again from docs.

    A bitmap of what is wanted, of a fixed size, is broadcast and keeps back most other texts; copies fall
    together before they move."""
    word, bit = F.shiftrightunsigned(F.xxhash64("t"), 64 - WANTED), F.expr("shiftleft(1L, int(xxhash64(t) & 63))")
    words = wanted.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_in"))
    texts = docs.select(identity(F.col("text")).alias("t"), "text").withColumns({"_w": word, "_b": bit})
    some = texts.join(F.broadcast(words), "_w").where(F.col("_in").bitwiseAND(F.col("_b")) != 0)
    once = some.groupBy("t").agg(F.any_value("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at : at + 256]
                yield pd.DataFrame({"row": some["row"].to_numpy(), "held": [shingles(x) for x in some["text"]]})

    found = once.join(wanted.select("row", "t"), "t").select("row", F.col("text").cast("binary").alias("text"))
    return found.mapInPandas(run, "row long, held array<long>")


def exploded(keys: DataFrame) -> DataFrame:
    return keys.select("row", F.explode("keys").alias("key"))


def estimated(keyed: DataFrame, block: int) -> DataFrame:
    """(key, n): about how many rows (row, key) have each key, from every kth row by hash, so that `block` rows are some
    64 of these. It serves for how work is dealt."""
    k = max(1, block // 64)
    some = keyed.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(k)) == 0)
    return some.groupBy("key").agg((F.count("*") * k).alias("n"))


def shared(keyed: DataFrame, often: DataFrame) -> DataFrame:
    """The rows (row, key) whose key others have too. Keys in often, a broadcast's worth, have others; the rest are
    counted where they come together."""
    many = keyed.join(F.broadcast(often), "key")
    rest = keyed.join(F.broadcast(often), "key", "left_anti").withColumn("_n", F.count("*").over(W.partitionBy("key")))
    return many.select("row", "key").unionByName(rest.where("_n > 1").select("row", "key"))


def dealt(rows: DataFrame, counts: DataFrame, by: list[str], weight: str, most: int) -> DataFrame:
    """rows (by, row, others) with cell, sorted by `by` and cell: groups of counts (by, and their weight) beyond
    `most` are dealt by hash over parts, and each two parts meet in a cell."""
    large = written(counts.where(F.col(weight) > most).select(*by, F.ceil(F.col(weight) / (most / 2)).alias("_g")), "jaccard-large")
    rows = rows.join(large, by, "left").withColumn("_g", F.coalesce("_g", F.lit(1).cast("long")))
    part, other = F.pmod(F.xxhash64("row"), F.col("_g")), F.sequence(F.lit(0).cast("long"), F.col("_g") - 1)
    rows = rows.withColumn("_p", part).withColumn("_o", F.explode(other))
    rows = rows.withColumn("cell", F.least("_p", "_o") * F.col("_g") + F.greatest("_p", "_o")).drop("_p", "_o", "_g")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by, "cell").sortWithinPartitions(*by, "cell")


def first_links(docs: DataFrame, reps: DataFrame, alive: DataFrame, block: int) -> DataFrame:
    """(a, b): links among rows that meet in the smallest key each has of those that others share.

    A row is in one group only; groups beyond `block` are parted by hash, since what is missed here is found later."""
    one = alive.groupBy("row").agg(F.min("key").alias("key"))
    one = written(one.join(reps.select("row", "t", "size", "bits"), "row"), "jaccard-one")
    counts = one.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    counts = written(counts.withColumn("parts", F.ceil(F.col("n") / block)), "jaccard-firsts")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = by_share(one, counts, "key", OFTEN).withColumn("cell", F.pmod(F.xxhash64("row"), F.col("parts")))
    sorted_ = parts.repartition(n, "key", "cell").sortWithinPartitions("key", "cell")

    def flagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for (key, cell), (row, t, size, bits) in _runs(batches, ["key", "cell"], ["row", "t", "size", "bits"]):
                hit = {x for pair in candidates(size, _bits(bits), row) for side in pair for x in side.tolist()}
                yield from ((key, cell, row[x], t[x]) for x in sorted(hit))

        yield from _frames(found(), ["key", "cell", "row", "t"])

    near = written(sorted_.select("key", "cell", "row", "t", "size", "bits").mapInPandas(flagged, "key long, cell long, row long, t binary"), "jaccard-near")
    discard(one)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links = (x for _, (row, held) in _runs(batches, ["key", "cell"], ["row", "held"]) for x in forest(row, list(held)))
        yield from _frames(links, ["a", "b"])

    sets = sets_of(docs, near).join(near.select("row", "key", "cell"), "row")
    out = written(sets.repartition(n, "key", "cell").sortWithinPartitions("key", "cell").mapInPandas(exact, "a long, b long"), "jaccard-links")
    discard(near)
    return out


def other_links(docs: DataFrame, reps: DataFrame, alive: DataFrame, roots: DataFrame, block: int, weight: int) -> DataFrame:
    """(a, b): for components, given by roots (node, root), that have links between them, one of each two or more.

    Keys whose rows are all of one component have nothing to give, and of keys with just the same rows one is
    enough; rows are told by two hashes of all of a key's rows. Bitmaps find the pairs of components that may link,
    and the rows that make them do. Of each pair the component with more such rows is the hub; its rows meet
    those of all its partners, once, and their sets are compared."""
    own = alive.join(roots.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    own = written(own, "jaccard-own")
    discard(alive)
    told = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"_{i}") for i in range(2)]
    keys = own.groupBy("key").agg(F.count("*").alias("n"), *told, F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b")
    keys = written(keys.groupBy("n", "_0", "_1").agg(F.min("key").alias("key")).select("key", "n"), "jaccard-mixed")
    members = by_share(own, keys, "key", OFTEN).join(reps.select("row", "size", "bits"), "row")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            """Rows (root, row, None) that may link with another component's, and pairs (root, None, other root)."""
            for _, (row, root, size, bits) in _runs(batches, ["key", "cell"], ["row", "root", "size", "bits"]):
                rows, pairs = set(), set()
                for i, j in candidates(size, _bits(bits), root):
                    low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
                    pairs.update(zip(low.tolist(), high.tolist(), strict=True))
                    rows.update(np.concatenate((i, j)).tolist())
                yield from ((int(root[i]), int(row[i]), None) for i in rows)
                yield from ((a, None, b) for a, b in pairs)

        for out in _frames(found(), ["root", "row", "other"]):
            yield out.astype({"row": "Int64", "other": "Int64"})

    met = dealt(members, keys, ["key"], "n", block).select("key", "cell", "row", "root", "size", "bits").mapInPandas(near, "root long, row long, other long")
    met = written(met.distinct(), "jaccard-met")
    discard(own)
    rows = met.where("other IS NULL").select("row", "root").join(reps.select("row", "t", "size"), "row")
    rows = written(rows, "jaccard-wanted")
    counts = rows.groupBy("root").agg(F.count("*").alias("k"))
    pairs = met.where("other IS NOT NULL").select("root", "other").join(counts, "root")
    pairs = pairs.join(counts.select(F.col("root").alias("other"), F.col("k").alias("l")), "other")
    first = F.struct("k", "root") >= F.struct("l", "other")
    hubs = pairs.select(F.when(first, F.col("root")).otherwise(F.col("other")).alias("hub"), F.when(first, F.col("other")).otherwise(F.col("root")).alias("root"))
    hubs = written(hubs.unionByName(hubs.select("hub", F.col("hub").alias("root")).distinct()), "jaccard-hubs")
    groups = hubs.join(rows.select("row", "root", "size"), "root")
    weights = written(groups.groupBy("hub").agg(F.sum("size").alias("w")), "jaccard-weights")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = _runs(batches, ["hub", "cell"], ["row", "root", "held"])
        yield from _frames((x for (hub, _), (row, root, held) in groups for x in bridges(hub, row, root, list(held))), ["a", "b"])

    sets = sets_of(docs, rows).join(groups.drop("size"), "row")
    out = dealt(sets, weights, ["hub"], "w", weight).select("hub", "cell", "row", "root", "held").mapInPandas(exact, "a long, b long")
    return written(out, "jaccard-links")


def jaccard_join(docs: DataFrame, block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that can be reached over links, the document's own included. Copies
    of a text are one row until the end. A text without words is linked with nothing, so its component is its
    own id; a null doc_id is never a component's id unless all its ids are null; repeated rows each get a row;
    other columns of docs are left out, whatever their names; an empty table gives no rows. A very long text
    takes memory in proportion to it.
    """
    docs = docs.select("doc_id", "text")
    found = written(prints(docs, block), "jaccard-prints")
    full = found.where("size > 0")
    once = full.groupBy("t").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("size", "bits", "keys")])
    reps = written(once.withColumn("row", F.monotonically_increasing_id()), "jaccard-reps")
    slim = written(found.select("doc_id", "t", "size"), "jaccard-slim")
    discard(found)
    keyed = exploded(reps)
    total = reps.agg(F.sum(F.size("keys"))).first()[0] or 0
    often = written(estimated(keyed, block).where((F.col("n") > block) & (F.col("n") >= OFTEN * total)).select("key"), "jaccard-often")
    alive = written(shared(keyed, often), "jaccard-alive")
    whole, reps = reps, written(reps.drop("keys"), "jaccard-rows")
    discard(whole)
    links = first_links(docs, reps, alive, block)
    roots = written(components(links), "jaccard-roots")
    more = other_links(docs, reps, alive, roots, block, weight)
    roots = written(components(links.unionByName(more)), "jaccard-roots")
    nodes = written(roots.withColumnRenamed("node", "row").join(reps.select("row", "first"), "row"), "jaccard-nodes")
    smallest = written(nodes.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "jaccard-components")
    named = by_share(nodes.select("row", "root"), smallest, "root", OFTEN).select("row", "component_id", F.lit(True).alias("_in"))
    named = reps.join(named, "row", "left").select("t", F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"), F.col("copies").alias("n"))
    named = written(named, "jaccard-named")
    out = by_share(slim.where("size > 0"), named, "t", OFTEN).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return out.unionByName(slim.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
