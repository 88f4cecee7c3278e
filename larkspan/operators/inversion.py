"""Linear classifiers as pairs of templates, families of them, and second stages against false positives."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Probabilities of inverted templates stay this far from 0 and 1.
CLIP = 1e-4
#: Scales are looked for between these powers of two, and then halved this often.
POWERS, HALVINGS = range(-8, 9), 50


def svm_family(rows: DataFrame, cs: Sequence[float], rounds: int = 30) -> DataFrame:
    """c, feat, w, b of a linear SVM for each c over rows (x array, y 0 or 1), fitted side by side as jobs of one
    session. Spark's regularisation is 1 / c / 100."""
    data = rows.select(array_to_vector("x").alias("f"), F.col("y").cast("double").alias("y")).persist()
    try:
        base = LinearSVC(featuresCol="f", labelCol="y", maxIter=rounds)
        maps = [{base.regParam: 1 / c / 100} for c in cs]
        fits = base.fitMultiple(data, maps)  # gives (number, model), and may be asked by many threads
        with ThreadPool(min(4, len(maps))) as pool:
            models = dict(pool.map(lambda _: next(fits), maps))
    finally:
        data.unpersist()
    out = [(float(c), i, float(w), float(models[k].intercept)) for k, c in enumerate(cs) for i, w in enumerate(models[k].coefficients)]  # a row a feature of each model
    return rows.sparkSession.createDataFrame(out, "c double, feat int, w double, b double")


def _negative(p: Column, w: Column, scale: Column) -> Column:
    q = 1 / (1 + (1 / p - 1) * F.exp(F.least(scale * w, F.lit(700.0))))
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), q))


def inverted(weights: DataFrame, by: str) -> DataFrame:
    """by, feat, p, q, w, scale, c: for each model of weights (by, feat, p, w, b), a positive template p and an SVM's
    weights w and constant b, the negative template q whose log ratio with p is the weights times a scale.

    At the scale the ratio's constant, the sum of ln((1 - p) / (1 - q)), is the scale times b; the trivial scale 0
    aside. It is looked for upwards over powers of two for a change of sign and then halved in, all within one
    expression over a model's arrays; a model without a change of sign has no row."""
    held = F.array_sort(F.collect_list(F.struct("feat", "p", "w")))  # one model's features
    models = weights.groupBy(by).agg(held.alias("m"), F.max("b").alias("b"))

    def off(s: Column) -> Column:
        """The constant at scale s less s b."""
        ln = lambda x: F.ln((1 - x["p"]) / (1 - _negative(x["p"], x["w"], s)))
        return F.aggregate("m", F.lit(0.0), lambda a, x: a + ln(x)) - s * F.col("b")

    tried = F.transform(F.array(*[F.lit(2.0**k) for k in POWERS]), lambda s: F.struct(s.alias("s"), off(s).alias("g")))
    models = models.withColumn("_t", tried)
    change = F.filter(F.sequence(F.lit(1), F.lit(len(POWERS) - 1)), lambda i: F.signum(F.get("_t", i)["g"]) != F.signum(F.get("_t", i - 1)["g"]))
    models = models.withColumn("_i", F.get(change, F.lit(0))).where(F.col("_i").isNotNull())
    low, high = F.get("_t", F.col("_i") - 1), F.get("_t", F.col("_i"))
    begin = F.struct(low["s"].alias("lo"), high["s"].alias("hi"), F.signum(low["g"]).alias("side"))

    def halve(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        left = F.signum(off(mid)) == a["side"]
        return F.struct(F.when(left, mid).otherwise(a["lo"]).alias("lo"), F.when(left, a["hi"]).otherwise(mid).alias("hi"), a["side"].alias("side"))

    models = models.withColumn("scale", F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), begin, halve, lambda a: (a["lo"] + a["hi"]) / 2))
    out = models.select(by, "scale", "b", F.explode("m").alias("x")).select(by, "scale", "b", "x.feat", "x.p", _negative(F.col("x.p"), F.col("x.w"), F.col("scale")).alias("q"))
    w = F.ln(F.col("p") / (1 - F.col("p")) * (1 - F.col("q")) / F.col("q"))
    return out.select(by, "feat", "p", "q", w.alias("w"), "scale", (F.col("scale") * F.col("b")).alias("c"))


def uniform_negative(weights: DataFrame, by: str, axis: str, clip: float = CLIP) -> DataFrame:
    """by, axis, q: the mean over time of the negative template that p and w imply at scale 1, one value a feature
    of `axis` for all frames, within clip of 0 and 1. Weights (by, axis, p, w)."""
    q = F.avg(1 / (1 + (1 / F.col("p") - 1) * F.exp("w")))
    return weights.groupBy(by, axis).agg(F.greatest(F.lit(clip), F.least(F.lit(1 - clip), q)).alias("q"))


def against_false_positives(bits: DataFrame, judged: DataFrame, key: str, clip: float = 0.01) -> DataFrame:
    """pred, feat, w, c0, n_pos, n_neg: for each predicted class the log ratio of the mean of its true positives to the
    mean of its false ones, from bits (key, feat, x) and judged (key, pred, positive). A class without either has no row."""
    held = lambda c: F.greatest(F.lit(clip), F.least(F.lit(1 - clip), c))
    by = bits.join(judged, key).groupBy("pred", "feat").agg(held(F.avg(F.when(F.col("positive"), F.col("x")))).alias("p"), held(F.avg(F.when(~F.col("positive"), F.col("x")))).alias("q"), F.count_if("positive").alias("n_pos"), F.count_if(~F.col("positive")).alias("n_neg"))
    p, q = F.col("p"), F.col("q")
    return by.where("n_pos > 0 AND n_neg > 0").select("pred", "feat", F.ln(p / q * (1 - q) / (1 - p)).alias("w"), F.ln((1 - p) / (1 - q)).alias("c0"), "n_pos", "n_neg")
