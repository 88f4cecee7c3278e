"""Operator 8: mixing sources to target weights by hash-threshold histograms, DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from larkspan.llm.common import discard, table, words, written

#: A hash has three digits of 12 bits; a histogram has one bar for each source and digit.
DIGIT_BITS, DIGITS = 12, 3


def sizes(docs: DataFrame) -> DataFrame:
    """docs with size (words of the whole text) and _hash, the first 36 bits of md5(doc_id): 0 to 2^36 - 1."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.withColumns({"size": F.size(words(F.col("text"))).cast("long"), "_hash": F.conv(F.substring(F.md5(key), 1, 9), 16, 10).cast("long")})


def _key() -> Column:
    """The source as a key without null."""
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))


def targets(by_source: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """One row a source (source, source_size) with target: its weight's share of all sizes, never over
    `most` times its size, the excess shared anew by weight among the others until none is above.

    That fixed point is one level per unit of weight: sources in order of most * size / weight are capped
    as long as the level of those that remain lies above them. One row a source, so one small window.
    """
    by_rank = W.orderBy(F.col("source").asc_nulls_last())
    order = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_rank) - 1, F.lit(len(weights))) + 1)
    out = by_source.withColumn("_w", weight).withColumn("_cap", (F.lit(most) * F.col("source_size")).cast("long"))
    out = out.withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
    total = F.sum("source_size").over(W.partitionBy())
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / F.sum("_w").over(after).cast("double")
    out = out.withColumn("_level", level)
    final = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(W.partitionBy())["_level"]
    shared = F.col("_w").cast("double") * final
    return out.withColumn("target", F.when(shared < F.col("_cap"), shared).otherwise(F.col("_cap").cast("double"))).drop("_w", "_cap", "_ratio", "_level")


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """goals (one row a source, with _key and _rest, the words to take beyond whole repeats) with _below:
    documents whose hash is under it fill the rest.

    Level by level a histogram of words by source and hash digit is summed, its running total passes
    _rest in one bar, and only that bar's documents are counted by the next digit. At the last level the
    boundary group goes in if the total then lies nearer to the goal. Thresholds grow with the budget, so
    the documents of a smaller budget are among those of a larger one.
    """
    state = goals.select("_key", "_rest").withColumns({"_prefix": F.lit(0).cast("long"), "_taken": F.lit(0).cast("long")})
    for level in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - level)
        rows = sized
        if level:
            rows = sized.join(state.select("_key", "_prefix"), "_key").where(F.shiftright("_hash", shift + DIGIT_BITS) == F.col("_prefix"))
        bars = rows.groupBy("_key", F.shiftright("_hash", shift).alias("_bar")).agg(F.sum("size").alias("_sum"))
        run = F.sum("_sum").over(W.partitionBy("_key").orderBy("_bar"))
        marks = bars.withColumn("_run", run).join(state, "_key").withColumn("_upto", F.col("_taken") + F.col("_run"))
        # the first bar by which the goal is passed; where the rest is 0 nothing is to be taken
        found = marks.where(F.col("_upto") > F.col("_rest")).groupBy("_key").agg(F.min(F.struct("_bar", "_sum", "_upto")).alias("_m"))
        nearer = (F.col("_upto") - F.col("_rest")) < (F.col("_rest") - (F.col("_upto") - F.col("_m._sum"))) if level == DIGITS - 1 else F.lit(False)
        state = (
            state.select("_key", "_rest").join(found, "_key").withColumn("_upto", F.col("_m._upto"))
            .withColumn("_take", nearer)
            .select(
                "_key", "_rest",
                (F.col("_m._bar") + F.col("_take").cast("long")).alias("_prefix"),
                (F.col("_upto") - F.when(F.col("_take"), F.lit(0).cast("long")).otherwise(F.col("_m._sum"))).alias("_taken"),
            )
        )
        state = written(state, f"mix-level{level}")
    return state.select("_key", F.col("_prefix").alias("_below"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs (doc_id, text, source, others) with size, source_size, target and copies: how often each goes in.

    copies is the target's whole multiple of the source's size, and one more for the documents whose hash
    lies under the source's threshold; so it is at most `most`. It depends on doc_id and the sizes alone:
    a rerun gives the same mix. Null source is a source of its own, last; null text has size 0; rows that
    share a doc_id in a source are taken together. An empty table gives no rows; a very long text is counted where
    it is and weighs its words; columns named size, source_size, target or copies are replaced.
    """
    rows = sizes(docs).withColumn("_key", _key())
    narrow = written(rows.select("_key", "source", "size", "_hash"), "mix-sizes")
    totals = narrow.groupBy("_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    goals = targets(totals, weights, most)
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("_whole", F.least(whole, F.lit(most).cast("long"))).withColumn("_rest", F.when(F.col("_whole") < most, target - F.col("_whole") * size).otherwise(F.lit(0.0)))
    goals = written(goals, "mix-goals")
    below = thresholds(narrow, goals.where(F.col("_rest") > 0))
    plan = written(goals.join(below, "_key", "left").select("_key", "source_size", "target", "_whole", F.coalesce("_below", F.lit(0)).alias("_below")), "mix-plan")
    discard(narrow)
    out = rows.drop("source_size", "target", "copies").join(plan, "_key", "left")
    copies = F.col("_whole") + (F.col("_hash") < F.col("_below")).cast("long")
    return out.withColumn("copies", copies).drop("_key", "_hash", "_whole", "_below")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as the mix takes it."""
    taken = mixed.where(F.col("copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken").cast(T.LongType()))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM r
), g AS (
  SELECT *, CASE WHEN w::DOUBLE * lv < cap THEN w::DOUBLE * lv ELSE cap::DOUBLE END AS target
  FROM l, (SELECT arg_min(level, ratio) AS lv FROM l WHERE level <= ratio)
), k AS (
  SELECT *, least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT, 3) AS whole FROM g
), q AS (
  SELECT *, CASE WHEN whole < 3 THEN target - whole * source_size ELSE 0 END AS rest FROM k
), c AS (
  SELECT source, h, sum(size) AS g, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h
), e AS (
  SELECT c.source, c.h FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
  WHERE q.rest > 0 AND (c.upto <= q.rest OR (c.upto - c.g <= q.rest AND c.upto - q.rest < q.rest - (c.upto - c.g)))
)
SELECT d.doc_id, d.size, q.source_size, q.target, (d.size * (q.whole + CASE WHEN e.h IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
