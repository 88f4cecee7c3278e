"""Templates, log-likelihood-ratio filters, sparse detection, part coding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from larkspan.functions.scalars import clip


def mean_background(bits: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """feat, p: mean of x by feature, clipped."""
    return bits.groupBy("feat").agg(F.avg("x").alias("p")).withColumn("p", clip(F.col("p"), low, high))


def class_templates(bits: DataFrame, p: float = 0.01) -> DataFrame:
    """label, feat, p, n: a class's mean over its examples, clipped to [p, 1 - p]."""
    return bits.groupBy("label", "feat").agg(F.avg("x").alias("p"), F.count("*").alias("n")).withColumn("p", clip(F.col("p"), p, 1 - p))


def weighted_templates(bits: DataFrame, affinities: DataFrame, p: float = 0.01) -> DataFrame:
    """comp, feat, p from bits (ex, feat, x) and affinities (ex, comp, a)."""
    out = bits.join(affinities, "ex").groupBy("comp", "feat").agg((F.sum(F.col("a") * F.col("x")) / F.sum("a")).alias("p"))
    return out.withColumn("p", clip(F.col("p"), p, 1 - p))


def llr_filter(templates: DataFrame, background: DataFrame) -> DataFrame:
    """templates with w, the log odds of the template over the background, and c0, the feature's part of the
    constant: a score is sum(c0) plus the sum of w over the features that are set."""
    b = background.select("feat", F.col("p").alias("b"))
    t, g = F.col("p"), F.col("b")
    return templates.join(F.broadcast(b), "feat").withColumns({"w": F.ln((t / g) / ((1 - t) / (1 - g))), "c0": F.ln((1 - t) / (1 - g))}).drop("b")  # one row a feature of the model


def likelihood_filter(templates: DataFrame) -> DataFrame:
    return templates.withColumns({"w": F.ln(F.col("p") / (1 - F.col("p"))), "c0": F.ln(1 - F.col("p"))})


def cumulative_bias(filters: DataFrame, key: str = "label", order: str = "feat") -> DataFrame:
    """c: the constants of all lengths at once, as running sums."""
    return filters.withColumn("c", F.sum("c0").over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def alternative_filter(one: DataFrame, two: DataFrame) -> DataFrame:
    """feat, w, c0 of template one against two; where one of them lacks a feature it counts as .5."""
    a, b = F.coalesce(F.col("a.p"), F.lit(0.5)), F.coalesce(F.col("b.p"), F.lit(0.5))
    both = one.alias("a").join(two.alias("b"), F.expr("a.feat = b.feat"), "full")
    return both.select(F.coalesce("a.feat", "b.feat").alias("feat"), F.ln((a / b) / ((1 - a) / (1 - b))).alias("w"), F.ln((1 - a) / (1 - b)).alias("c0"))


def gaussian_filter(stats: DataFrame, background: DataFrame) -> DataFrame:
    """label, feat, q, l, c: the log ratio of two normal densities as q x^2 + l x + c, from (mu, var)."""
    b = background.select("feat", F.col("mu").alias("bm"), F.col("var").alias("bv"))
    m, v, bm, bv = F.col("mu"), F.col("var"), F.col("bm"), F.col("bv")
    return stats.join(F.broadcast(b), "feat").select(  # one row a feature of the model
        "label", "feat", (0.5 / bv - 0.5 / v).alias("q"), (m / v - bm / bv).alias("l"), (0.5 * bm * bm / bv - 0.5 * m * m / v + 0.5 * F.ln(bv / v)).alias("c")
    )


def detect(bits: DataFrame, filters: DataFrame, spine: DataFrame, bias: DataFrame) -> DataFrame:
    """utt, frame, comp, score: every filter slid over sparse bits (utt, frame, f).

    Bits meet filter cells (comp, dt, f, w) on the feature and vote for the start frame - dt; starts where
    the filter runs past the end n of the utterance fall away, and a start without any bit scores the
    bias (comp, len, c) alone, since starts come from the spine (utt, frame, n). Bits with a column x are
    real-valued features: they vote x w."""
    weight = F.col("w") * F.col("x") if "x" in bits.columns else F.col("w")
    votes = bits.join(filters, "f").select("utt", "comp", (F.col("frame") - F.col("dt")).alias("frame"), weight.alias("w"))
    sums = votes.groupBy("utt", "frame", "comp").agg(F.sum("w").alias("s"))
    starts = spine.join(bias, F.col("frame") <= F.col("n") - F.col("len"))
    return starts.join(sums, ["utt", "frame", "comp"], "left").select("utt", "frame", "comp", (F.col("c") + F.coalesce("s", F.lit(0.0))).alias("score"))


def best_filter(scores: DataFrame) -> DataFrame:
    """utt, frame, score, comp: the best filter at each frame, the lowest number on ties."""
    best = F.max_by("comp", F.struct("score", -F.col("comp")))
    return scores.groupBy("utt", "frame").agg(F.max("score").alias("score"), best.alias("comp"))


def linear_scores(bits: DataFrame, filters: DataFrame, key: str, comp: str = "label") -> DataFrame:
    """key, comp, score: sum over features of c0 + w x."""
    joined = bits.drop(comp).join(filters.select(comp, "feat", "w", "c0"), "feat")
    return joined.groupBy(key, comp).agg(F.sum(F.col("c0") + F.col("w") * F.col("x")).alias("score"))


def best_class(scores: DataFrame, key: str, comp: str = "label") -> DataFrame:
    """The best class of each key, the lowest on ties."""
    w = W.partitionBy(key).orderBy(F.col("score").desc(), comp)
    return scores.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def code_parts(bits: DataFrame, cells: DataFrame, parts: DataFrame, least: int, reach: int) -> DataFrame:
    """key, cell, part: the part with the largest log likelihood of the patch at each cell, the lowest
    number on ties; 0, the background, where the patch has under `least` bits.

    bits (key, pos) are the set positions, a patch at cell covers pos = cell .. cell + reach - 1, parts
    (part, off, w, c0) hold log odds and constants."""
    at = bits.select("key", F.col("pos"), F.explode(F.sequence(F.lit(0), F.lit(reach - 1))).alias("off")).select("key", (F.col("pos") - F.col("off")).alias("cell"), "off")
    edges = at.groupBy("key", "cell").agg(F.count("*").alias("n"))
    const = parts.groupBy("part").agg(F.sum("c0").alias("c"))
    sums = at.join(parts, "off").groupBy("key", "cell", "part").agg(F.sum("w").alias("s")).join(const, "part")
    best = sums.groupBy("key", "cell").agg(F.max_by("part", F.struct(F.round(F.col("s") + F.col("c"), 9), -F.col("part"))).alias("part"))
    out = cells.join(edges, ["key", "cell"], "left").join(best, ["key", "cell"], "left")
    return out.select("key", "cell", F.when(F.coalesce("n", F.lit(0)) >= least, F.col("part")).otherwise(0).alias("part"))


def spread_parts(parts: DataFrame, dx: int, dy: int) -> DataFrame:
    """Distinct (utt, frame, freq, part) with each part spread over a box."""
    near = parts.withColumn("_x", F.explode(F.sequence(F.lit(-dx), F.lit(dx)))).withColumn("_y", F.explode(F.sequence(F.lit(-dy), F.lit(dy))))
    return near.select("utt", (F.col("frame") + F.col("_x")).alias("frame"), (F.col("freq") + F.col("_y")).alias("freq"), "part").distinct()


def neighbour_parts(parts: DataFrame, graph: DataFrame) -> DataFrame:
    """Adds each part's neighbours in a graph (part, neighbour)."""
    return parts.unionByName(parts.join(graph, "part").drop("part").withColumnRenamed("neighbour", "part")).distinct()


def two_part_templates(template: DataFrame, background: DataFrame, length: int, part: int) -> DataFrame:
    """comp, dt, feat, p: all deformations of a template (dt, feat, p) of `length` frames by its first and last
    `part` frames. In deformation comp the back begins at frame comp of 2 part frames, comp < part; where
    both lie the mean counts, where neither does the background (feat, p)."""
    front = template.where(F.col("dt") < part).select(F.explode(F.sequence(F.lit(0), F.lit(part - 1))).alias("comp"), F.col("dt").cast("int").alias("dt"), "feat", "p")
    back = template.where(F.col("dt") >= length - part).select(F.explode(F.sequence(F.lit(0), F.lit(part - 1))).alias("comp"), (F.col("dt") - (length - part)).cast("int").alias("dt"), "feat", "p")
    laid = front.unionByName(back.withColumn("dt", F.col("dt") + F.col("comp"))).groupBy("comp", "dt", "feat").agg(F.avg("p").alias("p"))
    grid = background.select("feat", F.col("p").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(part - 1))).alias("comp")).withColumn("dt", F.explode(F.sequence(F.lit(0), F.lit(2 * part - 1))))
    return grid.join(laid, ["comp", "dt", "feat"], "left").select("comp", "dt", "feat", F.coalesce("p", "b").alias("p"))


def three_part_templates(template: DataFrame, background: DataFrame, length: int, front: int, middle: int, back: int) -> DataFrame:
    """f, b, dt, feat, p: all deformations of a template (dt, feat, p) of `length` frames by its first `front`,
    central `middle` and last `back` frames. The middle moves f frames towards the front, and the back b frames
    away from the middle, as far as neighbouring parts still touch in the template's own overlap. The mean counts
    where parts overlap, the background (feat, p) where none lies. Rows depend on the model alone."""
    at_middle, at_back = length // 2 - middle // 2, length - back
    reach_f, reach_b = front - at_middle, at_middle + middle - at_back
    moves = [F.explode(F.sequence(F.lit(-r), F.lit(r))).alias(n) for n, r in (("f", reach_f), ("b", reach_b))]
    forms = template.sparkSession.range(1).select(moves[0]).select("f", moves[1])
    starts = ((0, front, F.lit(0)), (at_middle, middle, -F.col("f")), (at_back, back, F.col("b") - F.col("f")))
    parts = F.array_compact(F.array(*[F.when(F.col("dt").between(s, s + n - 1), F.col("dt").cast("int") + shift) for s, n, shift in starts]))
    laid = template.select("dt", "feat", "p").join(F.broadcast(forms), F.lit(True), "inner")  # the fixed number of deformations
    laid = laid.select("f", "b", "feat", "p", F.explode(parts).alias("dt")).groupBy("f", "b", "dt", "feat").agg(F.avg("p").alias("p"))
    grid = background.select("feat", F.col("p").alias("_g")).join(F.broadcast(forms), F.lit(True), "inner")
    grid = grid.withColumn("dt", F.explode(F.sequence(F.lit(0), F.lit(length + reach_f + reach_b - 1))))
    return grid.join(laid, ["f", "b", "dt", "feat"], "left").select("f", "b", "dt", "feat", F.coalesce("p", "_g").alias("p"))


def retrained(bits: DataFrame, pairs: DataFrame, key: str, p: float = 0.01) -> DataFrame:
    """label, feat, w, c0: each class's mean over its own examples against the mean over those wrongly given to
    it. bits (key, feat, x), pairs (key, pred, truth); .5 stands in for a mean that has no example."""
    own = pairs.select(key, F.col("truth").alias("label"), F.lit(1).alias("side"))
    wrong = pairs.where("pred <> truth").select(key, F.col("pred").alias("label"), F.lit(0).alias("side"))
    x = lambda side: clip(F.avg(F.when(F.col("side") == side, F.col("x"))), p, 1 - p)
    means = bits.select(key, "feat", "x").join(own.unionByName(wrong), key).groupBy("label", "feat")
    both = means.agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 0).alias("n0"), x(1).alias("m1"), x(0).alias("m0"))
    a, b = (F.when(F.col(n) > 0, F.col(m)).otherwise(0.5) for n, m in (("n1", "m1"), ("n0", "m0")))
    return both.select("label", "feat", F.ln((a / b) / ((1 - a) / (1 - b))).alias("w"), F.ln((1 - a) / (1 - b)).alias("c0"))


def negative_from_positive(p: Column, w: Column) -> Column:
    """Probabilities of the negative template that a linear filter w and the positive p imply."""
    return 1 / (1 + (1 / p - 1) * F.exp(w))


def best_per_example(scores: DataFrame) -> DataFrame:
    """utt, comp, score, frame: each filter's best score in an utterance and the first frame that has it."""
    return scores.groupBy("utt", "comp").agg(F.max("score").alias("score"), F.max_by("frame", F.struct("score", -F.col("frame"))).alias("frame"))


def over_threshold(detections: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Detections (comp, score, others) that reach their own component's threshold (comp, threshold)."""
    return detections.join(thresholds, "comp").where(F.col("score") >= F.col("threshold")).drop("threshold")


def salient_counts(bits: DataFrame, templates: DataFrame, key: str, least: float) -> DataFrame:
    """key, label, n: how many of a template's salient features (p over least) are set."""
    mask = templates.where(F.col("p") > least).select("label", "feat")
    return bits.drop("label").join(mask, "feat").groupBy(key, "label").agg(F.sum("x").cast("long").alias("n"))


def hard_assignments(scores: DataFrame, key: str, share: float) -> DataFrame:
    """key, label, a: the classes whose part of an example's likelihood is over share."""
    w = W.partitionBy(key)
    out = scores.withColumn("_e", F.exp(F.col("score") - F.max("score").over(w)))
    return out.withColumn("a", F.col("_e") / F.sum("_e").over(w)).where(F.col("a") > share).select(key, "label", "a")


def direct_scores(bits: DataFrame, templates: DataFrame, background: DataFrame, key: str, log: Callable[[Column], Column] = F.ln) -> DataFrame:
    """key, label, score: an example's log-likelihood under the template less that under the background, by
    any logarithm, the table of hundredths for one."""
    b = background.select("feat", F.col("p").alias("b"))
    cells = templates.select("label", "feat", "p").join(F.broadcast(b), "feat")  # one row a feature of the model
    p, g, x = F.col("p"), F.col("b"), F.col("x")
    rows = bits.drop("label").join(cells, "feat")
    return rows.groupBy(key, "label").agg(F.sum(x * (log(p) - log(g)) + (1 - x) * (log(1 - p) - log(1 - g))).alias("score"))


def background_spread(values: DataFrame) -> DataFrame:
    """feat, spread: mean square distance from the feature's mean, times n / (n + 1)."""
    return values.groupBy("feat").agg((F.var_pop("x") * F.count("x") / (F.count("x") + 1.0)).alias("spread"))


def patches(bits: DataFrame, width: int, least: int, below: int) -> DataFrame:
    """utt, start, n, cells: the bits (utt, frame, f, n: the utterance's frames) of every patch of `width`
    frames that holds at least `least` and fewer than `below`; cells is `dt:f,...` in order, without null f, which count. A bit goes to
    width patches, and a patch gathers no more than its cells."""
    spread = bits.withColumn("dt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))).withColumn("start", F.col("frame") - F.col("dt"))
    spread = spread.where((F.col("start") >= 0) & (F.col("start") + width <= F.col("n")))
    counted = spread.groupBy("utt", "start").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("dt", "f"))).alias("_c"))
    kept = counted.where((F.col("n") >= least) & (F.col("n") < below))
    cells = F.array_join(F.transform("_c", lambda c: F.concat(c["dt"].cast("string"), F.lit(":"), c["f"].cast("string"))), ",")
    return kept.select("utt", "start", "n", F.nullif(cells, F.lit("")).alias("cells"))


def coarse_to_fine(bits: DataFrame, filters: DataFrame, key: str, factor: int, least: float) -> DataFrame:
    """key, label, coarse, score: filters of mean weights over pooled features (the largest of each factor)
    score every example, and only pairs that reach least are scored in full."""
    pooled = bits.groupBy(key, F.floor(F.col("feat") / factor).alias("feat")).agg(F.max("x").alias("x"))
    rough = filters.groupBy("label", F.floor(F.col("feat") / factor).alias("feat")).agg(F.avg("w").alias("w"), F.avg("c0").alias("c0"))
    first = linear_scores(pooled, rough, key).withColumn("coarse", F.round("score", 6)).where(F.col("coarse") >= least).select(key, "label", "coarse")
    rows = bits.drop("label").join(first, key).join(filters.select("label", "feat", "w", "c0"), ["label", "feat"])
    return rows.groupBy(key, "label", "coarse").agg(F.sum(F.col("c0") + F.col("w") * F.col("x")).alias("score"))


def array_scores(examples: DataFrame, templates: np.ndarray, background: np.ndarray, by_table: bool = False) -> DataFrame:
    """ex, scores: the log ratio of each template (a row of probabilities) to the background for examples (ex, x array
    of 0/1), one score a template; by_table takes logarithms from a table of hundredths. A matrix product a batch."""

    def log(p: np.ndarray) -> np.ndarray:
        at = np.floor(100 * p + 0.5)
        return np.where(at <= 0, -13.8155, np.log(np.maximum(at, 1) / 100)) if by_table else np.log(p)

    on, off = log(templates) - log(background), log(1 - templates) - log(1 - background)
    shared = examples.sparkSession.sparkContext.broadcast(((on - off).T, off.sum(axis=1)))  # a model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, constant = shared.value
        for b in batches:
            if len(b):
                yield pd.DataFrame({"ex": b["ex"], "scores": list(np.stack(b["x"].to_numpy()) @ weights + constant)})

    return examples.select("ex", "x").mapInPandas(run, "ex long, scores array<double>")
