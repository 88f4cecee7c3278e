"""Joins of intervals: overlaps, tolerances, as-of lookups.

All carry the utterance as an equality key, and a span of time besides: intervals are dealt to the spans of
SPAN frames that they touch, so what lies far apart in a long utterance never meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Frames of a span of time.
SPAN = 1024


def _dealt(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """rows once for each span that frames first to last touch."""
    low = F.floor(first / SPAN)
    return rows.withColumn("_span", F.explode(F.sequence(low, F.greatest(low, F.floor(last / SPAN)))))


def met(clusters: DataFrame, truths: DataFrame, w0: Column, w1: Column, closed: bool = False) -> DataFrame:
    """Pairs of clusters d.* and truths t.* of an utterance, where the truth's window [w0, w1) of its columns overlaps
    the cluster [c_start, c_end), each pair once. closed: both are closed at both ends."""
    d = _dealt(clusters, F.col("c_start"), F.col("c_end")).alias("d")
    window = truths.withColumns({"_w0": w0, "_w1": w1})
    t = _dealt(window, F.col("_w0"), F.col("_w1")).alias("t")
    near = F.expr("t._w1 >= d.c_start AND t._w0 <= d.c_end" if closed else "t._w1 > d.c_start AND t._w0 < d.c_end")
    once = F.col("d._span") == F.greatest(F.floor(F.col("d.c_start") / SPAN), F.floor(F.col("t._w0") / SPAN))  # the first that both touch
    return d.join(t, (F.col("d.utt") == F.col("t.utt")) & (F.col("d._span") == F.col("t._span")) & near & once)


def _overlaps(clusters: DataFrame, truths: DataFrame) -> DataFrame:
    return met(clusters, truths, F.col("t_start"), F.col("t_end"))


def truth_hits(clusters: DataFrame, truths: DataFrame) -> DataFrame:
    """clusters with hits: how many truths overlap each; 0 makes it a false alarm."""
    pairs = _overlaps(clusters, truths).groupBy("d.utt", "d.cid").agg(F.count("*").alias("hits"))
    return clusters.join(pairs, ["utt", "cid"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def false_alarms(clusters: DataFrame, truths: DataFrame) -> DataFrame:
    return clusters.join(_overlaps(clusters, truths).select("d.utt", "d.cid").distinct(), ["utt", "cid"], "left_anti")


def missed(clusters: DataFrame, truths: DataFrame) -> DataFrame:
    found = _overlaps(clusters, truths).select("t.utt", "t.t_start", "t.t_end").distinct()
    return truths.join(found, ["utt", "t_start", "t_end"], "left_anti")


def rates(clusters: DataFrame, truths: DataFrame, frames: int, frame_s: float = 0.005) -> DataFrame:
    """One row: fpr, false positives a second, and tpr, the share of truths found, null without any; by one aggregate
    over clusters and truths marked by what they met."""
    pairs = _overlaps(clusters, truths)
    hit = clusters.join(pairs.select("d.utt", "d.cid").distinct().withColumn("_hit", F.lit(1)), ["utt", "cid"], "left")
    found = truths.join(pairs.select("t.utt", "t.t_start", "t.t_end").distinct().withColumn("_hit", F.lit(1)), ["utt", "t_start", "t_end"], "left")
    both = hit.select(F.lit("d").alias("kind"), "_hit").unionByName(found.select(F.lit("t").alias("kind"), "_hit"))
    wrong = F.count_if((F.col("kind") == "d") & F.col("_hit").isNull())
    right = F.try_divide(F.count_if((F.col("kind") == "t") & F.col("_hit").isNotNull()), F.count_if(F.col("kind") == "t"))
    return both.agg((wrong / F.lit(float(frames)) / F.lit(float(frame_s))).alias("fpr"), right.alias("tpr"))


def rates_by_utterance(clusters: DataFrame, truths: DataFrame) -> DataFrame:
    """utt, clusters, false, truths, found of each utterance that has either."""
    pairs = _overlaps(clusters, truths)
    hit = clusters.join(pairs.select("d.utt", "d.cid").distinct().withColumn("_hit", F.lit(1)), ["utt", "cid"], "left")
    found = truths.join(pairs.select("t.utt", "t.t_start", "t.t_end").distinct().withColumn("_hit", F.lit(1)), ["utt", "t_start", "t_end"], "left")
    both = hit.select("utt", F.lit("d").alias("kind"), "_hit").unionByName(found.select("utt", F.lit("t").alias("kind"), "_hit"))
    d, t, on = F.col("kind") == "d", F.col("kind") == "t", F.col("_hit").isNotNull()
    return both.groupBy("utt").agg(F.count_if(d).alias("clusters"), F.count_if(d & ~on).alias("false"), F.count_if(t).alias("truths"), F.count_if(t & on).alias("found"))


def neighbourhoods(clusters: DataFrame, truths: DataFrame, scores: DataFrame, w0: int, w1: int, length: int) -> DataFrame:
    """utt, cid, truth, dt, value: the `length` scores around the middle of each cluster, zero beyond the utterance,
    for each truth whose t_start + w0 to t_start + w1 touches the cluster, ends included, and once with a null
    truth for clusters that none does."""
    pairs = met(clusters, truths, F.col("t_start") + w0, F.col("t_start") + w1, closed=True).select("d.utt", "d.cid", F.col("t.t_start").alias("truth"))
    rows = clusters.join(pairs, ["utt", "cid"], "left")
    start = F.floor((F.col("c_start") + F.col("c_end")) / 2 - F.lit(length / 2) + 0.5)
    cells = rows.select("utt", "cid", "truth", F.posexplode(F.sequence(start, start + (length - 1))).alias("dt", "frame"))
    return cells.join(scores.select("utt", "frame", "value"), ["utt", "frame"], "left").select("utt", "cid", "truth", F.col("dt").cast("long").alias("dt"), F.coalesce("value", F.lit(0.0)).alias("value"))


def detection_records(clusters: DataFrame, truths: DataFrame, w0: int, w1: int) -> DataFrame:
    """kind (tp, fp, fn), utt, start, end: a truth at t_start meets a cluster where t_start + w0 < c_end and
    t_start + w1 >= c_start."""
    pairs = met(clusters, truths, F.col("t_start") + w0, F.col("t_start") + (w1 + 1))  # whole frames: >= is > one less
    hit = clusters.join(pairs.select("d.utt", "d.cid").distinct().withColumn("_hit", F.lit(True)), ["utt", "cid"], "left")
    found = pairs.select("t.utt", "t.t_start", "t.t_end").distinct()
    kind = F.when(F.col("_hit"), "tp").otherwise("fp")
    lost = truths.join(found, ["utt", "t_start", "t_end"], "left_anti")
    return hit.select(kind.alias("kind"), "utt", F.col("c_start").alias("start"), F.col("c_end").alias("end")).unionByName(lost.select(F.lit("fn").alias("kind"), "utt", F.col("t_start").alias("start"), F.col("t_end").alias("end")))


def label_context(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points (utt, frame) with phn, the label whose segment began last at or before the frame, and next_phn.

    An as-of lookup without a range join: points and segment starts are sorted together by utterance."""
    w = W.partitionBy("utt").orderBy("start_frame")
    segs = segments.select("utt", F.col("start_frame").alias("frame"), F.lit(0).alias("_k"), "phn", F.lead("phn").over(w).alias("next_phn"))
    both = points.select("utt", "frame", F.lit(1).alias("_k")).unionByName(segs, allowMissingColumns=True)
    upto = W.partitionBy("utt").orderBy("frame", "_k").rowsBetween(W.unboundedPreceding, 0)
    last = F.max_by(F.struct("phn", "next_phn"), F.when(F.col("_k") == 0, F.col("frame"))).over(upto)
    return both.withColumn("_l", last).where("_k = 1").select("utt", "frame", F.col("_l.phn").alias("phn"), F.col("_l.next_phn").alias("next_phn"))


def max_peak_per_truth(peaks: DataFrame, truths: DataFrame, w0: int, w1: int) -> DataFrame:
    """truths with best: the largest peak in [t_start + w0, t_start + w1), null without one."""
    points = peaks.select("utt", F.col("frame").alias("c_start"), (F.col("frame") + 1).alias("c_end"), "value")
    best = met(points, truths, F.col("t_start") + w0, F.col("t_start") + w1).groupBy("t.utt", "t.t_start").agg(F.max("d.value").alias("best"))
    return truths.select("utt", "t_start").distinct().join(best, ["utt", "t_start"], "left")


def away_from(windows: DataFrame, truths: DataFrame, tolerance: int) -> DataFrame:
    """Windows (utt, start, end) that no truth comes within tolerance frames of."""
    spans = windows.withColumnsRenamed({"start": "c_start", "end": "c_end"})
    near = met(spans, truths, F.col("t_start") - tolerance, F.col("t_end") + tolerance).select("d.utt", F.col("d.c_start").alias("start"), F.col("d.c_end").alias("end")).distinct()
    return windows.join(near, ["utt", "start", "end"], "left_anti")
