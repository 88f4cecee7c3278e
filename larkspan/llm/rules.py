"""Operator 3: a short-circuit cascade of quality rules, ordered by rejections per unit of cost.

Everything is a DataFrame expression. Rules are ordered on a bounded sample; a document passes if no
rule rejects it, so the order changes the work and never the verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import BLANKS, count_of, table, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


class Rule(NamedTuple):
    """rejects: true where the document goes. work: units it costs on a document (characters or words touched)."""

    name: str
    rejects: Column
    work: Column


def measured(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (all long).

    A null text counts as empty. Lines are compared as they stand, and only lines with a word count.
    Repeated windows are found per row: 64-bit hashes of five-word windows, sorted with their places only
    where some hash occurs twice, so the work is n log n in the text's length at worst and no row moves.
    """
    text = F.col("_text")
    out = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn("_words", words(text))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{BLANKS}]"))))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w)))
    hashed = F.transform(
        F.slice("_wh", F.lit(1), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")),
        lambda h, i: F.xxhash64(h, *[F.get(F.col("_wh"), i + k) for k in range(1, WINDOW)]),
    )
    out = out.withColumn("_win", hashed)
    twice = F.size(F.array_distinct("_win")) < F.size("_win")
    out = out.withColumn("_sorted", F.when(twice, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda i, d: F.get(F.col("_sorted"), i + d)["h"]
    places = F.filter("_sorted", lambda x, i: (F.coalesce(near(i, -1) == x["h"], F.lit(False))) | (F.coalesce(near(i, 1) == x["h"], F.lit(False))))
    out = out.withColumn("_places", F.sort_array(F.transform(places, lambda x: x["i"])))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    out = out.withColumns(
        {
            "word_chars": F.length(text) - count_of(text, f"[{BLANKS}]"),
            "n_symbols": count_of(text, SYMBOLS),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    # a filter on the measures must not be pushed below them: it would repeat all of the above in its condition
    return out.withColumn("_sealed", F.monotonically_increasing_id()).drop("_words", "_lines", "_wh", "_win", "_sorted", "_places")


def default_rules() -> list[Rule]:
    """Reject symbol-ridden, shouting, table-like, repetitive and degenerate texts; clean prose passes."""
    chars, n, letters = F.length("_text"), F.col("n_words"), F.col("word_chars")
    per_word = lambda marks: count_of(F.col("_text"), marks)
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n, F.lit(1.0)),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), F.lit(1.0)),
        Rule("word_length", (letters < 2 * n) | (letters > 25 * n), F.lit(2.0)),
        Rule("exclamations", 10 * per_word("!") > 3 * n, chars.cast("double")),
        Rule("capitals", 10 * per_word("[A-Z]") > 4 * letters, 1.5 * chars),
        Rule("digits", 10 * per_word("[0-9]") > 3 * letters, 1.2 * chars),
        Rule("brackets", 10 * per_word(r"[{}\[\]\\~^_=]") > n, 1.2 * chars),
    ]


def ordered(rows: DataFrame, rules: Sequence[Rule], sample_rows: int = 2000) -> list[Rule]:
    """Rules by rejections per cost on at most sample_rows rows, each given those placed before it.

    The sample is what take() reads of one row in four (by hash), so the job stops after a few partitions.
    """
    bits = F.concat(*[F.when(r.rejects, "1").otherwise("0") for r in rules])
    mine = rows.where(F.pmod(F.xxhash64("_text"), F.lit(4)) == 0)
    seen = mine.select(bits.alias("bits"), *[r.work.cast("double").alias(f"w{i}") for i, r in enumerate(rules)]).take(sample_rows)
    left, out, open_rules = [r for r in seen], [], list(range(len(rules)))
    while open_rules:

        def gain(i: int, left: list = left) -> tuple[float, int]:
            cost = sum(r[f"w{i}"] for r in left) or 1e-9
            return (sum(r["bits"][i] == "1" for r in left) / cost, -i)

        best = max(open_rules, key=gain)
        open_rules.remove(best)
        out.append(rules[best])
        left = [r for r in left if r["bits"][best] == "0"]
    return out


def quality_rules(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """docs (doc_id, text, any others) with the measures, base_failed, failed_rule and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated five-word windows. Else kept is
    the cascade's verdict: a chain of CASE branches, of which a row evaluates those up to its first hit.
    Null or empty texts fail the base; repeated rows each get a row; null ids are kept as they are; an empty
    table gives no rows. Columns of docs that clash with an output name are replaced. A very long text is
    measured whole, its windows sorted in one row.
    """
    rows = measured(docs)
    rules = ordered(rows, list(rules or default_rules()), sample_rows)
    base = (F.col("_sealed") >= 0) & ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    hit = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        hit = hit.when(rule.rejects, F.lit(rule.name))
    out = rows.withColumn("base_failed", base)
    out = out.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(hit))
    return out.withColumn("kept", F.col("failed_rule").isNull()).drop("_text", "_sealed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), win AS (
  SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT w.*, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         length(text) - length(translate(text, '!', '')) AS bangs,
         length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS caps,
         length(text) - length(translate(text, '0123456789', '')) AS digits,
         length(text) - length(translate(text, '{}[]\~^_=', '')) AS brackets
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 10 * bangs > 3 * n_words OR 10 * caps > 4 * word_chars OR 10 * digits > 3 * word_chars OR 10 * brackets > n_words) AS kept
FROM b
"""
