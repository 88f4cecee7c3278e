"""Operator 6: licence scans. Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser
evaluates the tags' and/or/with expressions."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import table

#: Phrases whose places count as base, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases of the method, and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache": "apache",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "artistic license": "artistic",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
}
#: Families of licence identifiers, by how the identifier begins.
FAMILIES = ("agpl", "apache", "artistic", "bsd", "bsl", "cc-by", "cc0", "epl", "gfdl", "gpl", "isc", "lgpl", "mit", "mpl", "unlicense", "zlib")
TAG = "spdx-license-identifier:"
#: How sure a finding is.
SCORES = {"tag": 1.0, "phrase": 0.9, "notice": 0.7}
#: Bytes that part words: everything below 0x80 but digits and lower-case letters, after A-Z became a-z.
_TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_KNOWN = re.compile("|".join(map(re.escape, FAMILIES)))
_TAG = re.compile(re.escape(TAG), re.I | re.A)
_NO_LICENCE = frozenset(("none", "noassertion"))
#: What follows a plain word that is an identifier: marks up to the line's end, a bracket or an operator.
_PLAIN_END = re.compile(r"\W*\Z|\s*\)|\s+(?:or|and|with)\s", re.I)
_POWER = {"or": 1, "and": 2, "with": 3}


class Scan(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    expressions: list[str]
    places: list[int]


def family(identifier: str) -> str:
    """The label of a licence identifier: its family, or the identifier itself where none is known."""
    return max((f for f in FAMILIES if identifier.startswith(f)), key=len, default=identifier)


def postfix(expression: str) -> list[str] | None:
    """A licence expression in postfix order by the shunting-yard method: with binds tighter than and, and
    tighter than or; all from the left. None if it isn't an expression."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand must come next
    for t in re.findall(r"[()]|[a-z0-9][a-z0-9.+-]*", expression):
        if t in _POWER:
            if operand:
                return None
            while stack and stack[-1] != "(" and _POWER[stack[-1]] >= _POWER[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif t == "(":
            if not operand:
                return None
            stack.append(t)
        elif t == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> list[frozenset[str]] | None:
    """The ways to satisfy an expression: or gives the choice of either side, and takes one way from each,
    with adds an exception, which is no licence. None if the text isn't an expression. Only the smallest
    ways are kept, so that (a or b) and (a or b) has two. There can be two to the power of the expression's
    length, so this is for expressions known to be short; a scan calls licences()."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[list[frozenset[str]]] = []
    for t in order:
        if t not in _POWER:
            stack.append([frozenset([family(t)])])
            continue
        b, a = stack.pop(), stack.pop()
        ways = a if t == "with" else a + b if t == "or" else [x | y for x in a for y in b]
        ways = list(dict.fromkeys(ways))
        stack.append([w for w in ways if not any(v < w for v in ways)])
    return stack.pop()


def licences(expression: str) -> tuple[set[str], set[str]] | None:
    """(licences that an expression names, those among them that each way to satisfy it needs), exceptions
    after with left out. None if it isn't an expression.

    Either side of an or is named, also one that a shorter way makes superfluous, as b in a or (a and b).
    Both sets are found on the postfix order, the smaller set being put into the larger, so the work is
    about in proportion to the expression, however many ways it has."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[set[str], set[str]]] = []
    for t in order:
        if t not in _POWER:
            stack.append(({family(t)}, {family(t)}))
            continue
        (named_b, needs_b), (named_a, needs_a) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((named_a, needs_a))
            continue
        more, less = (named_a, named_b) if len(named_a) >= len(named_b) else (named_b, named_a)
        more |= less
        if t == "or":
            needs = needs_a & needs_b
        else:
            needs, less = (needs_a, needs_b) if len(needs_a) >= len(needs_b) else (needs_b, needs_a)
            needs |= less
        stack.append((more, needs))
    return stack.pop()


#: A bracket, operator or identifier, with the white space before it.
_OPERAND = re.compile(r"\s*+(?:[()]|[A-Za-z0-9][A-Za-z0-9.+-]*+)")


def _tag_expression(line: str) -> str | None:
    """The longest beginning of a line that is an expression, in lower case; after it prose may follow.

    Any identifier is an operand. A plain word, without digit, hyphen, known family or a second capital, may
    also be prose: it is an operand after an operator in capitals, or if nothing but marks, an operator or a
    bracket follows. NONE and NOASSERTION name no licence."""
    end, at = 0, 0
    parts: list[str] = []
    open_, operand, sure = 0, True, False
    while m := _OPERAND.match(line, at):
        word = m[0].strip().rstrip(".")
        t = word.lower()
        if t in _POWER:
            if operand:
                break
            operand, sure = True, word.isupper()
        elif t == "(":
            if not operand:
                break
            open_ += 1
        elif t == ")":
            if operand or not open_:
                break
            open_ -= 1
        else:
            named = _KNOWN.match(t) or re.search(r"[0-9-]|[A-Z].*[A-Z]", word)
            if not operand or t in _NO_LICENCE or not (named or sure or _PLAIN_END.match(line, m.end())):  # a word of prose
                break
            operand = False
        parts.append(t)
        at = m.end()
        if not operand and not open_:
            end = len(parts)
    return " ".join(parts[:end]) or None


def automaton() -> ahocorasick.Automaton:
    """Phrases of words between single spaces, and what each stands for."""
    out = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICES), ("phrase", BASE)):
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    out.add_word(" spdx license identifier ", ("tag", "", 24))
    out.make_automaton()
    return out


def scan(text: bytes | None, machine: ahocorasick.Automaton) -> Scan:
    """Scans a whole text: words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z."""
    raw = text or b""
    ws = raw.translate(_TO_WORDS).split()
    flat = (" " + b" ".join(ws).decode("utf-8", "replace") + " ") if ws else ""
    base: list[int] = []
    found: set[str] = set()
    own: set[str] = set()
    score, tagged, starts = 0.0, False, None
    for end, (kind, label, length) in machine.iter(flat):
        if kind == "tag":
            tagged = True
            continue
        score = max(score, SCORES[kind])
        if kind == "phrase":
            if starts is None:  # where each word starts in flat
                starts = _starts(flat)
            base.append(bisect_right(starts, end - length + 1) - 1)
            own.add(label)
        else:
            found.add(label)
    expressions = []
    if tagged:
        for line in _TAG.split(raw.decode("utf-8", "replace"))[1:]:
            if expression := _tag_expression(line.split("\n", 1)[0]):
                expressions.append(expression)
                found.update((licences(expression) or ((), ()))[0])
                score = SCORES["tag"]
    base.sort()
    return Scan(len(ws), len(base), base[0] if base else None, base[-1] if base else None, ",".join(sorted(own)), ",".join(sorted(own | found)), score, expressions, base)


def _starts(flat: str) -> list[int]:
    return [m.start() + 1 for m in re.finditer(" ", flat)][:-1]


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, places array<long>"


def license_scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, others) with a struct column scan: the fields of Scan.

    Base: places (word numbers from 0) where a base phrase's words stand consecutively. The method adds
    labels from notice phrases and from the licences of every `SPDX-License-Identifier:` expression, of
    which every licence counts that the expression names, exceptions left out. score: 1 with an expression,
    0.9 with a base phrase, 0.7 with a notice, else 0. Empty and null texts have no words, null places,
    empty labels and score 0; a very long text takes time and memory in proportion to its length; repeated
    rows each get theirs; an empty table gives no rows. A column of docs named scan is replaced.
    """

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for texts in batches:
            got = pd.DataFrame([scan(t, machine) for t in texts], columns=Scan._fields)
            yield got.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn("scan", run(F.col("text").cast("binary")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = license_scan(docs)
    return out.select("doc_id", *[f"scan.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])
