"""Confusion matrices, ROC curves, figures of merit, thresholds, hardest errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from larkspan.functions.scalars import fpr_tpr_limits


def confusion(pairs: DataFrame) -> DataFrame:
    """pred, truth, n."""
    return pairs.groupBy("pred", "truth").agg(F.count("*").alias("n"))


def confusion_rollup(pairs: DataFrame) -> DataFrame:
    """Counts by pair, by each side and in all, in one pass."""
    return pairs.cube("pred", "truth").agg(F.count("*").alias("n"))


def error_rate(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("pred") != F.col("truth")).cast("double")).alias("error"))


#: A range of values is parted at this many quantiles, and between two of them into as many bars of equal width.
PARTS = 64


def running(rows: DataFrame, by: str, *sums: str) -> DataFrame:
    """rows with, for each of sums, <name>_run: its total over the rows at or above this one by `by`, whose
    values are distinct, null below all; and <name>_all: its total over all rows.

    No window runs over all rows in one task: they are dealt by value into bars, and the totals of the bars
    (some PARTS squared, whatever the input) are added to running totals within each. Bars follow the values'
    quantiles, so that a value far off, or infinite, leaves the others as they are."""
    cuts = rows.agg(F.percentile_approx(F.col(by).cast("double"), [k / PARTS for k in range(PARTS + 1)])).first()[0]
    v, bounds = F.col(by).cast("double"), F.array(*[F.lit(x) for x in dict.fromkeys(cuts or [0.0])])
    part = F.size(F.filter(bounds, lambda x: v >= x))  # 0 below all of them
    low, high = F.get(bounds, part - 1), F.get(bounds, part)
    inside = F.try_divide(v - low, high - low) * PARTS  # null at the ends and not a number beyond what is finite, which keeps the order
    inside = F.when(F.isnan(inside), 0.0).otherwise(F.coalesce(F.least(inside, F.lit(PARTS - 1.0)), F.lit(0.0)))
    bar = F.when(F.col(by).isNull(), F.lit(-1).cast("long")).otherwise(part.cast("long") * PARTS + F.floor(F.greatest(inside, F.lit(0.0))))
    rows = rows.withColumn("_bar", bar)
    bars = rows.groupBy("_bar").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    above, whole = W.orderBy(F.col("_bar").desc()).rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    bars = bars.select("_bar", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}") for c in sums], *[F.sum(f"_{c}").over(whole).alias(f"{c}_all") for c in sums])
    inside = W.partitionBy("_bar").orderBy(F.col(by).desc()).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(F.broadcast(bars), "_bar")
    return out.select(*[c for c in rows.columns if c != "_bar"], *[(F.col(f"_{c}") + F.sum(c).over(inside)).alias(f"{c}_run") for c in sums], *[f"{c}_all" for c in sums])


def roc(scores: DataFrame) -> DataFrame:
    """score, fpr, tpr for each positive's score as a threshold: negatives and positives at or above it, by
    their totals. Rows (score, positive).

    Equal scores are one row before anything is sorted, so running totals are over distinct scores."""
    by = scores.groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("q"))
    return running(by, "score", "p", "q").where("p > 0").select("score", (F.col("q_run") / F.col("q_all")).alias("fpr"), (F.col("p_run") / F.col("p_all")).alias("tpr"))


def fom(curve: DataFrame) -> DataFrame:
    """Mean tpr over the points whose fpr lies in the figure of merit's range; null without any."""
    low, high = fpr_tpr_limits()
    return curve.agg(F.avg(F.when(F.col("fpr").between(low, high), F.col("tpr"))).alias("fom"))


def mean_tpr_by_minute(curve: DataFrame) -> DataFrame:
    """Average over k = 1 .. 10 of the tpr at the last point with fpr of at least k / 60."""
    ks = curve.sparkSession.range(1, 11).withColumnRenamed("id", "k")  # ten rows
    at = curve.join(F.broadcast(ks), F.col("fpr") >= F.col("k") / 60).groupBy("k").agg(F.min_by("tpr", F.struct("fpr", "tpr")).alias("tpr"))
    return at.agg(F.avg("tpr").alias("mean_tpr"))


def detection_roc(peaks: DataFrame, truths: DataFrame, thresholds: DataFrame, gap: int) -> DataFrame:
    """threshold, clusters, hits, found: for each threshold the clusters of the peaks at or above it, those
    that overlap a truth, and the truths they find. Peaks don't depend on the threshold and are made once."""
    rows = peaks.join(F.broadcast(thresholds), F.col("value") >= F.col("threshold"))  # as many thresholds as the curve has points
    w = W.partitionBy("threshold", "utt").orderBy("frame")
    new = F.coalesce((F.col("frame") - F.lag("frame").over(w) >= gap).cast("int"), F.lit(0))
    rows = rows.withColumn("_new", new).withColumn("cid", F.sum("_new").over(w))
    cl = rows.groupBy("threshold", "utt", "cid").agg(F.min("frame").alias("c_start"), (F.max("frame") + 1).alias("c_end"))
    pairs = cl.alias("d").join(truths.alias("t"), F.expr("t.utt = d.utt AND t.t_end > d.c_start AND t.t_start < d.c_end"))
    hits = pairs.select("threshold", "d.utt", "cid").distinct().groupBy("threshold").agg(F.count("*").alias("hits"))
    found = pairs.select("threshold", "t.utt", "t_start").distinct().groupBy("threshold").agg(F.count("*").alias("found"))
    out = thresholds.join(cl.groupBy("threshold").agg(F.count("*").alias("clusters")), "threshold", "left").join(hits, "threshold", "left").join(found, "threshold", "left")
    return out.na.fill(0, ["clusters", "hits", "found"])


def threshold_at(values: DataFrame, percent: float) -> DataFrame:
    """The value of 0-based rank max(int((n - 1) percent / 100), first that isn't null) in ascending order; no
    row where all are null."""
    by = values.groupBy("best").agg(F.count("*").alias("n"), F.count_if(F.col("best").isNull()).alias("z"))
    rank = F.greatest(F.floor((F.col("n_all") - 1) * percent / 100), F.col("z_all"))
    below = F.col("n_all") - F.col("n_run")  # smaller values, and nulls
    rows = running(by, "best", "n", "z").where(F.col("best").isNotNull())
    return rows.where((below <= rank) & (rank < below + F.col("n"))).select(F.col("best").alias("threshold"))


def ordered_rank(rows: DataFrame, by: str) -> DataFrame:
    """rows, whose values of `by` are distinct, with rank: from 0 for the smallest to 1 for the largest."""
    counted = running(rows.withColumn("_one", F.lit(1).cast("long")), by, "_one")
    below = F.col("_one_all") - F.col("_one_run")
    return counted.withColumn("rank", F.when(F.col("_one_all") == 1, 0.0).otherwise(F.try_divide(below, F.col("_one_all") - 1))).select(*rows.columns, "rank")


def score_cutoffs(rows: DataFrame, by: str, n: int) -> DataFrame:
    """by, cutoff: for each group the lowest score that at most n rows reach; no row where none does."""
    h = rows.groupBy(by, "score").agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(W.partitionBy(by).orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0))
    return h.withColumn("_run", run).where(F.col("_run") <= n).groupBy(by).agg(F.min("score").alias("cutoff"))


def second_stage_roc(rows: DataFrame, by: str, missed: DataFrame, seconds: float) -> DataFrame:
    """by, score, fps, tpr from survivors of a first stage (by, score, positive) and missed (by, missed): at
    each positive's score the false positives a second and the found share of all truths, first-stage
    misses among them."""
    h = rows.groupBy(by, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    down = W.partitionBy(by).orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = h.select(by, "score", "p", F.sum("q").over(down).alias("_q"), F.sum("p").over(down).alias("_p"), F.sum("p").over(W.partitionBy(by)).alias("_all"))
    out = out.where("p > 0").join(missed.select(by, "missed"), by, "left")
    return out.select(by, "score", (F.col("_q") / F.lit(seconds)).alias("fps"), (F.col("_p") / (F.col("_all") + F.coalesce("missed", F.lit(0)))).alias("tpr"))


def response_density(rows: DataFrame, by: str, grid: DataFrame, width: float) -> DataFrame:
    """by, at, density: a normal kernel's density of value at each point of grid (at), which the caller keeps
    small. Equal values are counted before they meet the grid."""
    h = rows.groupBy(by, "value").agg(F.count("*").alias("n"))
    z = (F.col("at") - F.col("value")) / F.lit(width)
    mass = F.sum(F.col("n") * F.exp(-0.5 * z * z)) / F.sum("n")
    return h.join(F.broadcast(grid), F.lit(True), "inner").groupBy(by, "at").agg((mass / F.lit(width) / F.sqrt(F.lit(2.0) * F.pi())).alias("density"))


def hardest(rows: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The n highest-scoring rows of each group."""
    w = W.partitionBy(by).orderBy(F.col("score").desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cascade_roc(rows: DataFrame, coarse: Sequence[float], fine: Sequence[float], seconds: float, missed: int = 0) -> DataFrame:
    """coarse, threshold, tpr, fps: for each pair of thresholds the share of positives, `missed` further ones among
    them, that pass both, and the negatives that do, a second. Rows (coarse, score, positive).

    Rows are counted by how many thresholds of each kind they reach, so what moves is at most one row a cell and
    task, and sums from above along both sides give all pairs: scores never meet thresholds."""
    reached = lambda c, bars: F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(bars)]), lambda b: F.col(c) >= b))
    cells = rows.groupBy(reached("coarse", coarse).alias("_i"), reached("score", fine).alias("_j")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    grid = rows.sparkSession.range((len(coarse) + 1) * (len(fine) + 1)).select((F.col("id") % (len(coarse) + 1)).cast("int").alias("_i"), F.floor(F.col("id") / (len(coarse) + 1)).cast("int").alias("_j"))
    cells = grid.join(cells, ["_i", "_j"], "left").na.fill(0, ["p", "q"])  # a row a pair of thresholds from here on
    for one, other in (("_i", "_j"), ("_j", "_i")):
        above = W.partitionBy(one).orderBy(F.col(other).desc()).rowsBetween(W.unboundedPreceding, 0)
        cells = cells.withColumns({c: F.sum(c).over(above) for c in ("p", "q")})
    total = F.max("p").over(W.partitionBy()) + F.lit(missed)
    cells = cells.withColumn("_all", total).where("_i > 0 AND _j > 0")
    bar = lambda at, bars: F.element_at(F.array(*[F.lit(float(b)) for b in sorted(bars)]), F.col(at))
    return cells.select(bar("_i", coarse).alias("coarse"), bar("_j", fine).alias("threshold"), F.try_divide(F.col("p"), F.col("_all")).alias("tpr"), (F.col("q") / F.lit(float(seconds))).alias("fps"))


def component_confusion(scores: DataFrame, truths: DataFrame, key: str) -> DataFrame:
    """pred, pred_comp, truth, truth_comp, n from scores (key, label, comp, score) and truths (key, truth): the best
    component of all, and the best of the true class, the lowest on ties. A key whose class has no score is left out."""
    rank = F.struct("score", -F.col("label"), -F.col("comp"))
    rows = scores.join(truths.select(key, "truth"), key)
    own = F.when(F.col("label") == F.col("truth"), rank)
    best = rows.groupBy(key, "truth").agg(F.max(rank).alias("a"), F.max(own).alias("b")).where("b IS NOT NULL")
    names = lambda s, name: [(-F.col(f"{s}.col2")).alias(name), (-F.col(f"{s}.col3")).alias(f"{name}_comp")]
    pairs = best.select(*names("a", "pred"), "truth", (-F.col("b.col3")).alias("truth_comp"))
    return pairs.groupBy("pred", "pred_comp", "truth", "truth_comp").agg(F.count("*").alias("n"))


def component_errors(confusion_: DataFrame) -> DataFrame:
    """side, label, comp, n: how many mistakes each component makes as the predicted one, and loses as the true one."""
    wrong = confusion_.where("pred <> truth")
    made = wrong.select(F.lit("made").alias("side"), F.col("pred").alias("label"), F.col("pred_comp").alias("comp"), "n")
    lost = wrong.select(F.lit("lost").alias("side"), F.col("truth").alias("label"), F.col("truth_comp").alias("comp"), "n")
    return made.unionByName(lost).groupBy("side", "label", "comp").agg(F.sum("n").alias("n"))


def windows_of(lengths: DataFrame, by: str) -> DataFrame:
    """by, w0, w1, c0, c1 from templates (by, len): a third of the longest to either side as the window of a hit, its
    length as the gap that parts clusters, and one and a half times it as the most they span."""
    longest = F.max("len")
    return lengths.groupBy(by).agg((-F.ceil(longest / 3)).alias("w0"), F.ceil(longest / 3).alias("w1"), longest.cast("long").alias("c0"), F.ceil(longest * 1.5).alias("c1"))
