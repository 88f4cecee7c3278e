"""Operator 13: alignment of two tokenizers' tokens over the bytes of each text.

Every byte of a text belongs to one token of A and to one of B. The owners are written out byte by byte,
token numbers repeated by token lengths; where the pair of owners changes a new link begins, and where both
change at once the text can be cut. Nothing is searched, so a text's work follows its length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import by_share, table, written

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair with this share of all links or more is broadcast; there are at most as many as its inverse.
OFTEN = 1 / (1 << 17)
#: Texts with a longer run of white space go to the slower library, since the quick one's pattern overflows its stack.
LONG_BLANK = re.compile(r"\s{10000}")
SCHEMA = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_VOCABULARY), public_tokenizers.path(B_VOCABULARY)


class Tokens:
    """Both tokenizers, and the bytes of their tokens.

    A's vocabulary is read from its own file; its ids are in the order of merges, which is all that the quick
    library needs. Special tokens are no part of it, so their strings in a text are plain text."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            held = json.load(f)
        special = {t["content"] for t in held["added_tokens"]}
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]  # bytes that stand for themselves
        byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if piece not in special}
        self.quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = Tokenizer.from_file(path_a)
        self.plain.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_a[i] = piece
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.len_a, self.len_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        both = [str(i).encode() for i in [*range(len(self.bytes_a)), *range(len(self.bytes_b))]]
        #: each id followed by a comma, a bar and a semicolon; B's ids come after A's
        self.shown = [x + end for end in (b",", b"|", b";") for x in both]

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of A and B; None where the text is empty or a tokenizer doesn't give its bytes back."""
        if not text:
            return None
        spaced = " " + text
        raw = spaced.encode()
        a = self.plain.encode(spaced, add_special_tokens=False).ids if LONG_BLANK.search(text) else self.quick.encode_ordinary(spaced)
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw:
            return None
        b = self.b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def aligned(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, byte) of the links of two sequences of token lengths with equal sums, in the
    order of bytes, and `byte` of the cuts: where a token of each begins, but for the first byte."""
    own_a, own_b = (np.repeat(np.arange(len(x), dtype=np.int32), x) for x in (len_a, len_b))
    new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    at = np.concatenate(([0], np.flatnonzero(new_a | new_b) + 1))
    return own_a[at], own_b[at], np.flatnonzero(new_a & new_b) + 1


def one_text(tokens: Tokens, text: str | None) -> tuple:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): pairs are distinct id pairs of links, as
    A's id times B's vocabulary plus B's id, and times says how many links hold each."""
    got = tokens.of(text)
    if got is None:
        return 0, 0, 0, 0, "", [], []
    a, b = got
    la, lb = tokens.len_a[a], tokens.len_b[b]
    ta, tb, cuts = aligned(la, lb)
    begins = np.concatenate((np.cumsum(la) - la, np.cumsum(lb) - lb))
    place = 2 * np.searchsorted(cuts, begins, side="right") + (np.arange(len(begins)) >= len(a))  # group, then side
    order = np.argsort(place, kind="stable")
    ids, place = np.concatenate((a, b + len(tokens.bytes_a)))[order], place[order]
    step = np.zeros(len(ids), np.int64)  # same list: comma; A's list ends: bar; group ends: semicolon
    step[:-1] = (place[1:] != place[:-1]) * (1 + (place[:-1] & 1))
    told = b"".join(map(tokens.shown.__getitem__, (ids + step * (len(tokens.shown) // 3)).tolist()))[:-1]
    pairs, times = np.unique(a[ta] * len(tokens.bytes_b) + b[tb], return_counts=True)
    return len(a), len(b), len(cuts) + 1, len(ta), hashlib.sha256(told).hexdigest(), pairs, times


_shared: dict[tuple[str, str], Tokens] = {}


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, row (one number a row of docs), and what one_text() gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _shared.get((path_a, path_b)) or _shared.setdefault((path_a, path_b), Tokens(path_a, path_b))
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                out = [(doc, row, *one_text(tokens, text)) for doc, row, text in zip(some["doc_id"], some["row"], some["text"], strict=True)]
                yield pd.DataFrame(out, columns=["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInPandas(run, SCHEMA)


def pair_counts(held: DataFrame, vocabulary: int) -> DataFrame:
    """(pair, count, best, n) of held (row, pair, times): the links and documents that hold a pair of ids, and
    whether no pair with the same id of B has more links. Counts are summed before they move."""
    counts = written(held.groupBy("pair").agg(F.sum("times").alias("count"), F.count("*").alias("n")), "align-pairs")
    b = F.pmod("pair", F.lit(vocabulary))
    most = counts.groupBy(b.alias("_b")).agg(F.max("count").alias("_most"))  # at most one row an id of B
    return counts.join(F.broadcast(most), b == F.col("_b")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"), "n")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. Other columns of docs are left out, whatever their names.

    Texts are tokenized once. What a document's links count corpus-wide is joined to its distinct pairs:
    frequent pairs by broadcast, so that their rows, most of all, stay where they are, the others by shuffle.
    Null and empty texts, and those whose bytes a tokenizer doesn't give back, have zeros and '' for the
    groups; repeated rows and rows without an id each have a row, and each one's links count; of equal
    counts all are best; an empty table gives no rows. A very long text takes memory in proportion to it.
    """
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    found = written(alignments(docs, path_a, path_b), "align-found")
    zipped = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    held = zipped.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = written(pair_counts(held, vocabulary), "align-counts")
    met = by_share(held, counts, "pair", OFTEN)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = found.drop("pairs", "times").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *tokenizer_paths())
