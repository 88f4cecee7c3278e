"""Operator 5: packing documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from larkspan.llm.common import table, written

LENGTH = 4096
END_ID = 2
#: Lengths are planned in units of so many tokens; a piece takes the next whole number of units.
UNIT = 8
#: Parts over which the pieces of one size are dealt to be ranked.
SALTS = 256
VOCABULARY = "word_bpe_49k.json"
#: The bytes of Latin-1 that the fast way takes, but for white space: printable ASCII and U+00C0 to U+00FF.
_PLAIN = bytes([*range(33, 127), *range(0xC0, 0x100)])
_SPACE = b" \t\n\x0b\x0c\r"
#: Latin-1 in lower case.
_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
#: The tokenizer's pattern for pieces, over these bytes in lower case.
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class _Known(dict):
    """What was met before, with its ids as little-endian unsigned 32-bit bytes; the rest is made on demand.
    Beyond `most` entries a new generation begins, which takes over what it meets of the last one, and the
    one before is forgotten; so a worker's memory is bounded, and what is frequent stays."""

    def __init__(self, make: Callable[[bytes], list[int]], most: int) -> None:
        self.make, self.most, self.last = make, most, {}

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= self.most:
            self.last = dict(self)
            self.clear()
        got = self.last.get(key)
        if got is None:
            ids = self.make(key)
            got = struct.pack(f"<{len(ids)}I", *ids)
        self[key] = got
        return got


class WordIds:
    """A tokenizer's ids, just as its own encode() gives them without special tokens added; up to `most`
    pieces and their ids are kept.

    The strings of special tokens (<|endoftext|> and the like) stand for their ids wherever they occur in
    a text, so the text is parted at them first. The vocabulary drops white space and never joins characters
    across it. Words of printable ASCII and the letters U+00C0 to U+00FF are cut here into the pieces of the
    tokenizer's own pattern, of which most were met before, and new pieces go to its merge model; no normal
    form but lower case applies to these characters. Any other word goes through the tokenizer.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        tokenize = self.tok.model.tokenize
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]  # bytes that stand for themselves
        letters = {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in shown)}
        self.added = {t.content: struct.pack("<I", i) for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

        def piece(raw: bytes) -> list[int]:
            shown = raw.decode("latin-1")
            return [t.id for t in tokenize(shown if raw.isascii() else shown.encode().decode("latin-1").translate(letters))]

        self.pieces = _Known(piece, most)
        self.odd = _Known(lambda raw: self.tok.encode(raw.decode("utf-8"), add_special_tokens=False).ids, most // 8)

    def _plain(self, raw: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(raw.translate(_LOWER))))

    def _part(self, text: str) -> bytes:
        try:
            raw = text.encode("latin-1")
            if not raw.translate(None, _PLAIN + _SPACE):
                return self._plain(raw)
        except UnicodeEncodeError:
            pass
        out = []
        for word in text.encode("utf-8", "replace").split():
            raw = word if word.isascii() else word.decode().encode("latin-1", "ignore")
            plain = len(raw) == len(word.decode()) and not raw.translate(None, _PLAIN)
            out.append(self._plain(raw) if plain else self.odd[word])
        return b"".join(out)

    def of(self, text: str) -> np.ndarray:
        if self.cut and "<|" in text:
            raw = b"".join(self.added[t] if t in self.added else self._part(t) for t in self.cut.split(text))
        else:
            raw = self._part(text)
        return np.frombuffer(raw, "<u4")


_shared: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, row (one number a row of docs), start, length, ids_crc32, doc_tokens: each document's ids, and
    end_id after them, cut into pieces of `length` and a rest. A null text has the end_id alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _shared.get(path) or _shared.setdefault(path, WordIds(path))
        for b in batches:
            out = []
            for doc, row, text in zip(b["doc_id"], b["row"], b["text"], strict=True):
                ids = np.append(tok.of(text or ""), np.array([end_id], "<u4"))
                out += [(doc, row, at, min(length, len(ids) - at), zlib.crc32(ids[at : at + length].tobytes()), len(ids)) for at in range(0, len(ids), length)]
            yield pd.DataFrame(out, columns=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInPandas(run, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")


def price(duals: np.ndarray, units: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best pattern's worth at these prices, and its counts: an unbounded knapsack by dynamic
    programming. units ascend. In increasing room each optimum is found from smaller ones."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(units, np.arange(room + 1), side="right")
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        if n := fits[r]:
            values = duals[:n] + best[r - units[:n]]
            k = values.argmax()
            if values[k] > best[r] + 1e-12:
                best[r], took[r] = values[k], k
    counts, r = np.zeros(len(units), np.int64), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            counts[took[r]] += 1
            r -= int(units[took[r]])
    return float(best[room]), counts


def best_fit(left: dict[int, int], room: int) -> Counter:
    """Patterns, each a sorted tuple of (units, pieces), and how often they are used, for pieces {units: pieces}
    placed by decreasing size into the fullest sequence with room. Sequences of the same content are one
    entry here, so the work depends on the sizes and not on the pieces."""
    bins: dict[int, Counter] = {}  # room left: {content: sequences}
    for s in sorted(left, reverse=True):
        n = left[s]
        for free in sorted(bins):
            if free < s or not n:
                continue
            each, entries = free // s, bins.pop(free)
            for content, times in sorted(entries.items()):
                full, part = min(times, n // each), 0
                if full < times:
                    part = n - full * each  # under a whole sequence's, and that sequence exists
                for c, t in ((each, full), (part, 1 if part else 0), (0, times - full - (1 if part else 0))):
                    if t:
                        rest = free - c * s
                        bins.setdefault(rest, Counter())[tuple(sorted((*content, (s, c)))) if c else content] += t
                n -= full * each + part
        each = room // s
        for c, t in ((each, n // each), (n % each, 1 if n % each else 0)):
            if t:
                bins.setdefault(room - c * s, Counter())[((s, c),)] += t
    return sum(bins.values(), Counter())


def fullest(left: np.ndarray, room: int) -> np.ndarray:
    """Counts by size, none above left[size], that fill room as far as can be, by the fewest pieces: a knapsack
    over the sizes from large to small, in which s pieces of a size are taken as 1, 2, 4 .. and the rest."""
    few = np.full(room + 1, 1 << 30)
    few[0], steps = 0, []
    for s in np.flatnonzero(left[1 : room + 1])[::-1] + 1:
        n, k = min(int(left[s]), room // int(s)), 1
        while n:
            k = min(k, n)
            w = k * int(s)
            better = few[:-w] + k < few[w:]
            if better.any():
                steps.append((int(s), k, better))
                few[w:] = np.where(better, few[:-w] + k, few[w:])
            n, k = n - k, 2 * k
    at, counts = int(np.flatnonzero(few < 1 << 30)[-1]), np.zeros(len(left), np.int64)
    for s, k, better in reversed(steps):
        w = k * s
        if at >= w and better[at - w]:
            counts[s] += k
            at -= w
    return counts


def filled(left: dict[int, int], room: int) -> Counter:
    """As best_fit(): patterns found one after the other, each the largest size left and what fills the rest of its
    sequence best, used as often as there are pieces for it."""
    have = np.zeros(room + 1, np.int64)
    for s, n in left.items():
        have[s] = n
    out: Counter = Counter()
    for s in sorted(left, reverse=True):
        while have[s]:
            have[s] -= 1
            counts = fullest(have, room - s) if room > s else np.zeros(room + 1, np.int64)
            have[s] += 1
            counts[s] += 1
            used = np.flatnonzero(counts)
            times = int((have[used] // counts[used]).min())
            have -= times * counts
            out[tuple((int(u), int(counts[u])) for u in used)] += times
    return out


def inverted(matrix: np.ndarray) -> np.ndarray:
    """A matrix's inverse by Gauss-Jordan steps. NumPy's own calls a threaded library, which was seen to
    wait forever on a Spark driver, though not with one thread; the driver's fork of its JVM may be the cause."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        at = k + int(np.abs(both[k:, k]).argmax())
        both[[k, at]] = both[[at, k]]
        both[k] /= both[k, k]
        others = both[:, k].copy()
        others[k] = 0
        both -= np.multiply.outer(others, both[k])
    return both[:, n:].copy()


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """matrix @ vector without the threaded library."""
    return np.einsum("ij,j->i", matrix, vector)


def plan(histogram: dict[int, int], room: int, gap: float = 0.001, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns ({units: pieces}, times used) that hold exactly the pieces of histogram {units: pieces}, in at most as
    many sequences as best_fit() or filled() take.

    Column generation for the cutting-stock problem. Columns are found first by knapsacks over what is left, one
    after the other. Farley's bound (the prices' worth of all pieces over the best pattern's, by a knapsack over
    the prices) tells how few sequences any plan can have; with prices in proportion to sizes it often proves at
    once that at most the share `gap` of the sequences could be saved, or less than one. If it doesn't, a basis
    of one pattern a size is improved by the revised simplex method, where the first columns enter as long as
    one of them pays and then the knapsack's over the present prices, until the bound proves it or none pays.
    The inverse is made anew when it has drifted. The basis solution is rounded down, never beyond what
    there is, and what remains, less than one pattern a size, is placed likewise. Should a degenerate basis
    circle, `rounds` ends it; the better of the plans is taken then as ever. Work depends on the sizes, not on
    how many documents there are.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), np.int64)
    need = np.array([histogram[int(s)] for s in sizes], float)
    if not len(sizes):
        return []
    whole = {int(s): int(n) for s, n in zip(sizes, need, strict=True)}
    best = min(filled(whole, room), best_fit(whole, room), key=Counter.total)

    def proved(duals: np.ndarray, value: float, held: float) -> bool:
        bound = (duals * need).sum() / value
        return bound >= (1 - gap) * held or np.ceil(bound - 1e-6) >= np.ceil(held - 1e-6)

    duals = sizes / room
    if proved(duals, price(duals, sizes, room)[0], best.total()):
        return [(dict(c), n) for c, n in best.items()]
    pool = np.zeros((len(best), len(sizes)))
    for k, pattern in enumerate(best):
        for s, c in pattern:
            pool[k, np.searchsorted(sizes, s)] = c
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / (room // sizes))
    x = _times(inverse, need)
    pivots = 0
    while pivots < rounds:
        duals = inverse.sum(axis=0)
        worth = _times(pool, duals)
        column = pool[int(worth.argmax())]
        if worth.max() <= 1 + 1e-6:
            value, column = price(duals, sizes, room)
            if value <= 1 + 1e-7 or proved(duals, value, min(x.sum(), best.total())):
                break
            if (duals * column).sum() <= 1 + 1e-7:  # it pays by rounding errors only
                break
        direction = _times(inverse, column)
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        basis[:, leave] = column
        x = x - step * direction
        x[leave] = step
        pivot = inverse[leave] / direction[leave]
        inverse -= np.multiply.outer(direction, pivot)
        inverse[leave] = pivot
        pivots += 1
        if pivots % 50 == 0 and (np.abs(_times(basis, x) - need).max() > 1e-7 * need.max() or np.abs(_times(basis.T, inverse.sum(axis=0)) - 1).max() > 1e-7):
            inverse = inverted(basis)
            x = np.maximum(_times(inverse, need), 0)
    times = np.floor(np.maximum(x, 0) + 1e-6).astype(np.int64)
    left = need.astype(np.int64)
    used_: Counter = Counter()
    for k in np.argsort(-(basis * sizes[:, None]).sum(axis=0), kind="stable"):
        counts = np.rint(basis[:, k]).astype(np.int64)
        used = counts > 0
        n = min(int(times[k]), int((left[used] // counts[used]).min()))
        if n > 0:
            left -= n * counts
            used_[tuple((int(s), int(c)) for s, c in zip(sizes[used], counts[used], strict=True))] += n
    rest = {int(s): int(n) for s, n in zip(sizes, left, strict=True) if n}
    used_ += min(filled(rest, room), best_fit(rest, room), key=Counter.total)
    return [(dict(c), n) for c, n in min(best, used_, key=Counter.total).items()]


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size (first rank of a run, its first sequence, pieces of the size in each of its sequences):
    the piece of rank r lies in sequence `first + (r - rank) // pieces`."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for counts, times in patterns:
        for s, c in counts.items():
            out.setdefault(s, []).append((ranks[s], sequence, c))
            ranks[s] += c * times
        sequence += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in out.items()}


def pack(cut: DataFrame, length: int = LENGTH, unit: int = UNIT, salts: int = SALTS) -> DataFrame:
    """cut (row, start, length, others) with sequence_id and offset.

    A piece of `length` tokens is a sequence of its own and moves nowhere; their ids are below zero. Of the
    others the histogram of sizes is at most length / unit numbers; the plan made from it is of the same order,
    so both fit the driver and a broadcast whatever the input. Pieces of a size are ranked without gaps and
    without bringing them together: they are dealt over salts, ranked there, and the salts' counts are
    added up. Rank decides the sequence; inside a sequence pieces lie one after the other from 0, large
    ones first. An empty table gives no rows. cut is read three times and should be a written table.
    """
    whole = cut.where(F.col("length") >= length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    sized = cut.where(F.col("length") < length).withColumn("_size", F.ceil(F.col("length") / unit).cast("int")).withColumn("_salt", F.pmod(F.xxhash64("row", "start"), F.lit(salts)).cast("int"))
    counts = sized.groupBy("_size", "_salt").agg(F.count("*").alias("n"))
    table_ = counts.toPandas().sort_values(["_size", "_salt"])  # at most length / unit * salts rows
    before = (table_.groupby("_size")["n"].cumsum() - table_["n"]).to_numpy()
    starts = np.zeros((length // unit + 1, salts), np.int64)
    starts[table_["_size"], table_["_salt"]] = before
    places = slots(plan({int(s): int(n) for s, n in table_.groupby("_size")["n"].sum().items()}, length // unit))
    context = cut.sparkSession.sparkContext
    shared = context.broadcast((starts, places))
    ranked = sized.withColumn("_rank", F.row_number().over(W.partitionBy("_size", "_salt").orderBy("row", "start")) - 1)

    @F.pandas_udf("long")
    def sequence(size: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.Series:
        starts, places = shared.value
        size, own = size.to_numpy(), rank.to_numpy().astype(np.int64)
        own = own + starts[size, salt.to_numpy()]
        out = np.zeros(len(own), np.int64)
        for s in np.unique(size):
            first, at, each = places[int(s)]
            here = np.flatnonzero(size == s)
            run = np.searchsorted(first, own[here], side="right") - 1
            out[here] = at[run] + (own[here] - first[run]) // each[run]
        return pd.Series(out)

    placed = ranked.withColumn("sequence_id", sequence("_size", "_salt", "_rank")).drop("_size", "_salt", "_rank")
    order = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), "row", "start")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset.cast("long")).unionByName(whole)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) tokenized, cut and packed: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Rows that share a doc_id are documents of their own, null ids too."""
    cut = written(pieces(docs.select("doc_id", "text"), path or tokenizer_path(), length), "pieces")
    return pack(cut, length).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
