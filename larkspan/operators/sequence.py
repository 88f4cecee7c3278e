"""Window and sequence operators over frames (utt, frame, ...): one partition an utterance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec


def by_frame() -> WindowSpec:
    return W.partitionBy("utt").orderBy("frame")


def whole() -> WindowSpec:
    return W.partitionBy("utt")


def preemphasis(frames: DataFrame, a: float = 0.97) -> DataFrame:
    before = F.lag("value").over(by_frame())
    return frames.withColumn("y", F.when(before.isNull(), F.col("value")).otherwise(F.col("value") - a * before))


def delta_slope(frames: DataFrame, half: int = 4) -> DataFrame:
    """Regression slope of value over frame in a window of 2 half + 1 frames, shorter at the ends."""
    return frames.withColumn("slope", F.regr_slope("value", F.col("frame").cast("double")).over(by_frame().rowsBetween(-half, half)))


def adaptive_background(frames: DataFrame, length: int, low: float, high: float, default: float) -> DataFrame:
    """Mean of the previous `length` frames within [low, high]; the first length + 1 frames get the default."""
    mean = F.avg("value").over(by_frame().rowsBetween(-length, -1))
    return frames.withColumn("background", F.when(F.col("frame") <= length, F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), mean))))


def centered_max(frames: DataFrame, radius: int) -> DataFrame:
    """Frames whose value is the largest within radius frames, the ends excluded."""
    most, n = F.max("value").over(by_frame().rowsBetween(-radius, radius)), F.count("*").over(whole())
    out = frames.withColumn("_m", most).withColumn("_n", n)
    return out.where((F.col("value") == F.col("_m")) & (F.col("frame") >= radius) & (F.col("frame") < F.col("_n") - radius)).drop("_m", "_n")


def peaks(scores: DataFrame, threshold: float | Column, last: Column | None = None) -> DataFrame:
    """Local peaks of value at least threshold: not below either neighbour, so a plateau gives each of its
    frames; ends excluded. last: frames from there on are no starts of a detection."""
    out = scores.withColumn("_a", F.lag("value").over(by_frame())).withColumn("_b", F.lead("value").over(by_frame()))
    threshold = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    out = out.where((F.col("value") >= F.col("_a")) & (F.col("value") >= F.col("_b")) & (F.col("value") >= threshold))
    return (out.where(F.col("frame") <= last) if last is not None else out).drop("_a", "_b")


def strict_peaks(scores: DataFrame, threshold: float) -> DataFrame:
    """As peaks(), but above at least one neighbour: flat plateaus fall away."""
    out = scores.withColumn("_a", F.lag("value").over(by_frame())).withColumn("_b", F.lead("value").over(by_frame()))
    v = F.col("value")
    return out.where((v >= F.col("_a")) & (v >= F.col("_b")) & ((v > F.col("_a")) | (v > F.col("_b"))) & (v >= threshold)).drop("_a", "_b")


def block_threshold(frames: DataFrame, block: int, q: float, floor: float = 0.0) -> DataFrame:
    """threshold and bit per frame: in each block of `block` frames the positive value of 0-based rank
    int(q n), at least floor. A partial last block takes the last `block` frames for its estimate.
    Without a positive value the threshold is null and the bit 0."""
    n = F.count("*").over(whole())
    rows = frames.withColumn("_n", n).withColumn("_full", F.floor(F.col("_n") / block))
    own = F.when(F.floor(F.col("frame") / block) < F.col("_full"), F.floor(F.col("frame") / block)).otherwise(F.lit(-1))
    tail = (F.col("frame") >= F.col("_n") - block) & (F.col("_n") % block != 0)
    groups = F.array_compact(F.array(F.when(own >= 0, own), F.when(tail, F.lit(-1).cast("long"))))
    est = rows.where("value > 0").select("utt", "value", F.explode(groups).alias("_g"))
    w = W.partitionBy("utt", "_g")
    est = est.withColumn("_r", F.row_number().over(w.orderBy("value")) - 1).withColumn("_c", F.count("*").over(w))
    est = est.where(F.col("_r") == F.floor(F.lit(float(q)) * F.col("_c"))).select("utt", "_g", F.greatest("value", F.lit(float(floor))).alias("threshold"))
    out = rows.withColumn("_g", own).join(est, ["utt", "_g"], "left")
    return out.withColumn("bit", F.when(F.col("value") >= F.col("threshold"), 1).otherwise(0)).drop("_g", "_n", "_full")


def streaming_quantile(frames: DataFrame, length: int, q: float) -> DataFrame:
    return frames.withColumn("quantile", F.percentile("value", F.lit(q)).over(by_frame().rowsBetween(-(length - 1), 0)))


def dilate(bits: DataFrame, reach: int) -> DataFrame:
    """Distinct (utt, frame, ...) with each bit spread reach frames both ways, within its utterance's length n."""
    out = bits.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("frame", F.col("frame") + F.col("_d"))
    return out.where((F.col("frame") >= 0) & (F.col("frame") < F.col("n"))).drop("_d").distinct()


def max_pool(frames: DataFrame, factor: int) -> DataFrame:
    """Largest value of each factor frames; a remainder at the end is dropped."""
    out = frames.groupBy("utt", F.floor(F.col("frame") / factor).alias("cell")).agg(F.max("value").alias("value"), F.count("*").alias("_n"))
    return out.where(F.col("_n") == factor).drop("_n")


def windows(frames: DataFrame, width: int, hop: int) -> DataFrame:
    """Each frame in every window it belongs to: window k holds frames k hop to k hop + width - 1, whole windows only."""
    k = F.floor(F.col("frame") / hop)
    out = frames.withColumn("_n", F.count("*").over(whole()))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("frame") - (width - 1)) / hop))
    out = out.withColumn("window", F.explode(F.when(first <= k, F.sequence(first, k)).otherwise(F.array().cast("array<long>"))))
    return out.where(F.col("window") * hop + width <= F.col("_n")).drop("_n")


def same_sign_rate(frames: DataFrame, width: int, hop: int) -> DataFrame:
    """For each window the pairs of neighbours with equal sign, by the window's width."""
    s = windows(frames, width, hop)
    w = W.partitionBy("utt", "window").orderBy("frame")
    same = (F.col("value") * F.lag("value").over(w) > 0).cast("int")
    return s.withColumn("_s", same).groupBy("utt", "window").agg((F.sum("_s") / width).alias("rate"))


def edge_differences(cells: DataFrame) -> DataFrame:
    """(utt, frame, freq, orient, d) from (utt, frame, freq, x): differences in four directions, kept where
    they are non-maximum-suppressed: at least as large as the neighbours' along their direction and
    positive. orient 0-3 are rises in time, frequency and the two diagonals, 4-7 the falls."""
    out = None
    for o, (line, along) in enumerate(((["freq"], "frame"), (["frame"], "freq"), (["_down"], "frame"), (["_up"], "frame"))):
        w = W.partitionBy("utt", *line).orderBy(along)
        rows = cells.withColumn("_down", F.col("frame") - F.col("freq")).withColumn("_up", F.col("frame") + F.col("freq"))
        rows = rows.withColumn("d", F.lead("x").over(w) - F.col("x")).where("d IS NOT NULL")
        rows = rows.withColumn("_a", F.lag("d").over(w)).withColumn("_b", F.lead("d").over(w))
        for sign, k in ((1, o), (-1, o + 4)):
            d, a, b = sign * F.col("d"), sign * F.col("_a"), sign * F.col("_b")
            kept = rows.where((d > 0) & (a.isNull() | (d > a)) & (b.isNull() | (d >= b))).select("utt", "frame", "freq", F.lit(k).alias("orient"), d.alias("d"))
            out = kept if out is None else out.unionByName(kept)
    return out


def label_runs(frames: DataFrame) -> DataFrame:
    """utt, seg_idx, phn, start_frame, end_frame: runs of equal labels, half-open."""
    new = (~F.col("phn").eqNullSafe(F.lag("phn").over(by_frame())) | F.lag("frame").over(by_frame()).isNull()).cast("int")
    runs = frames.withColumn("_new", new).withColumn("seg_idx", F.sum("_new").over(by_frame()) - 1)
    return runs.groupBy("utt", "seg_idx", "phn").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"))


def pattern_match(segments: DataFrame, pattern: Sequence[str]) -> DataFrame:
    """utt, start_frame, end_frame where consecutive labels equal the pattern; a match may end on the last."""
    w = W.partitionBy("utt").orderBy("start_frame")
    hit = F.col("phn") == pattern[0]
    for k, label in enumerate(pattern[1:], 1):
        hit = hit & (F.lead("phn", k).over(w) == label)
    out = segments.withColumn("_hit", hit).withColumn("_end", F.lead("end_frame", len(pattern) - 1).over(w) if len(pattern) > 1 else F.col("end_frame"))
    return out.where("_hit").select("utt", "start_frame", F.col("_end").alias("end_frame"))


def kgrams(labels: DataFrame, k: int, order: str = "frame") -> DataFrame:
    """gram, n: label k-grams and their counts."""
    w = W.partitionBy("utt").orderBy(order)
    parts = [F.col("phn"), *[F.lead("phn", i).over(w) for i in range(1, k)]]
    out = labels.select(F.array(*parts).alias("_g"))
    return out.where(~F.exists("_g", lambda x: x.isNull())).groupBy(F.array_join("_g", " ").alias("gram")).agg(F.count("*").alias("n"))


def diphones(labels: DataFrame) -> DataFrame:
    """a, b, n for every ordered pair of labels, 0 where the pair never occurs."""
    w = W.partitionBy("utt").orderBy("frame")
    pairs = labels.select(F.col("phn").alias("a"), F.lead("phn").over(w).alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    kinds = labels.select("phn").distinct()  # the label set
    grid = kinds.select(F.col("phn").alias("a")).join(kinds.select(F.col("phn").alias("b")), F.lit(True), "inner")
    return grid.join(pairs, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def cluster_c0(detections: DataFrame, gap: int) -> DataFrame:
    """utt, cid, c_start, c_end, n: detections whose frames follow within less than gap, as [first, last + 1)."""
    new = F.coalesce((F.col("frame") - F.lag("frame").over(by_frame()) >= gap).cast("int"), F.lit(0))
    out = detections.withColumn("_new", new).withColumn("cid", F.sum("_new").over(by_frame()))
    return out.groupBy("utt", "cid").agg(F.min("frame").alias("c_start"), (F.max("frame") + 1).alias("c_end"), F.count("*").alias("n"))


def cluster_own_length(detections: DataFrame) -> DataFrame:
    """As cluster_c0() over detections (utt, frame, len), the gap being the length of the detection before."""
    gap = F.col("frame") - F.lag("frame").over(by_frame()) >= F.lag("len").over(by_frame())
    out = detections.withColumn("_new", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("cid", F.sum("_new").over(by_frame()))
    return out.groupBy("utt", "cid").agg(F.min("frame").alias("c_start"), (F.max("frame") + 1).alias("c_end"), F.count("*").alias("n"))


def slices(intervals: DataFrame, frames: DataFrame, pad: float) -> DataFrame:
    """utt, start, dt, value: the frames of each interval [start, end), with pad where the utterance has none."""
    cells = intervals.where("end > start").select("utt", "start", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("frame"))
    out = cells.join(frames.select("utt", "frame", "value"), ["utt", "frame"], "left")
    return out.select("utt", "start", (F.col("frame") - F.col("start")).alias("dt"), F.coalesce("value", F.lit(pad)).alias("value"))


def classify_windows(segments: DataFrame) -> DataFrame:
    """w_start, w_end: a third of the segment's length to either side of its start, cut at the utterance's ends."""
    third = F.floor((F.col("end_frame") - F.col("start_frame")) / 3)
    end = F.max("end_frame").over(whole())
    return segments.withColumns({"w_start": F.greatest(F.lit(0).cast("long"), F.col("start_frame") - third), "w_end": F.least(end, F.col("start_frame") + F.greatest(third, F.lit(1)))})


def smooth(frames: DataFrame, weights: Sequence[float]) -> DataFrame:
    """smoothed: the weighted sum of a frame and its neighbours; nothing beyond the ends counts."""
    half, total = len(weights) // 2, F.lit(0.0)
    for k, weight in enumerate(weights):
        near = F.lead("value", k - half).over(by_frame()) if k >= half else F.lag("value", half - k).over(by_frame())
        total = total + F.lit(float(weight)) * F.coalesce(near, F.lit(0.0))
    return frames.withColumn("smoothed", total)


def overlap_threshold(frames: DataFrame, block: int, q: float) -> DataFrame:
    """threshold and bit per frame: block k's frames are held against the value of 0-based rank int(q n) in a
    window twice as long, half a block to either side. A frame is in two windows at most, so rows double."""
    half, own = block // 2, F.floor(F.col("frame") / block)
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("frame") - block - half) / block) + 1)
    seen = frames.select("utt", "value", F.explode(F.sequence(first, F.floor((F.col("frame") + half) / block))).alias("_k"))
    w = W.partitionBy("utt", "_k")
    seen = seen.withColumn("_r", F.row_number().over(w.orderBy("value")) - 1).withColumn("_c", F.count("*").over(w))
    chosen = seen.where(F.col("_r") == F.floor(F.lit(float(q)) * F.col("_c"))).select("utt", "_k", F.col("value").alias("threshold"))
    out = frames.withColumn("_k", own).join(chosen, ["utt", "_k"])
    return out.withColumn("bit", (F.col("value") >= F.col("threshold")).cast("int")).drop("_k")


#: (frames, channels) of a step along each of the four directions of an edge.
DIRECTIONS = ((1, 0), (0, 1), (1, 1), (1, -1))


def dilate_directed(edges: DataFrame, reach: int, channels: int) -> DataFrame:
    """Distinct (utt, frame, freq, orient): each edge (.., n) spread reach steps both ways along its own
    direction, orient modulo 4, within the n frames of its utterance and the channels."""
    step = lambda part: F.element_at(F.array(*[F.lit(d[part]) for d in DIRECTIONS]), (F.col("orient") % 4 + 1).cast("int"))
    out = edges.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    out = out.withColumns({"frame": F.col("frame") + F.col("_d") * step(0), "freq": F.col("freq") + F.col("_d") * step(1)})
    inside = F.col("frame").between(0, F.col("n") - 1) & F.col("freq").between(0, channels - 1)
    return out.where(inside).select("utt", "frame", "freq", "orient").distinct()


def pyramid(cells: DataFrame, key: str, levels: int, factor: int) -> DataFrame:
    """key, level, band, x: sums of factor^level neighbouring channels, for each level from 0."""
    sized = cells.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(factor**i).alias("width")) for i in range(levels)])))
    return sized.groupBy(key, F.col("_s.level").alias("level"), F.floor(F.col("feat") / F.col("_s.width")).alias("band")).agg(F.sum("x").alias("x"))


def registered(intervals: DataFrame, frames: DataFrame, length: int) -> DataFrame:
    """utt, start, dt, value: each interval [start, end) brought to `length` frames by its nearest frames."""
    n = F.col("end") - F.col("start")
    cells = intervals.where("end > start").withColumn("dt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    at = F.least(n - 1, F.floor(F.col("dt") / float(length) * n + 0.5))
    return cells.withColumn("frame", F.col("start") + at).join(frames.select("utt", "frame", "value"), ["utt", "frame"]).select("utt", "start", "dt", "value")


def pattern_parts(segments: DataFrame, pattern: Sequence[str]) -> DataFrame:
    """utt, start_frame, part, p_start, p_end: each label's own interval within a match of the pattern."""
    w = W.partitionBy("utt").orderBy("start_frame")
    hit = F.col("phn") == pattern[0]
    for k, label in enumerate(pattern[1:], 1):
        hit = hit & (F.lead("phn", k).over(w) == label)
    own = [F.struct(F.lead("start_frame", k).over(w).alias("s"), F.lead("end_frame", k).over(w).alias("e")) for k in range(len(pattern))]
    out = segments.withColumn("_hit", hit).withColumn("_parts", F.array(*own)).where("_hit")
    out = out.select("utt", "start_frame", F.posexplode("_parts").alias("part", "_p"))
    return out.select("utt", "start_frame", "part", F.col("_p.s").alias("p_start"), F.col("_p.e").alias("p_end"))


def has_pattern(segments: DataFrame, pattern: Sequence[str]) -> DataFrame:
    """utt, has: whether an utterance has the pattern anywhere."""
    w = W.partitionBy("utt").orderBy("start_frame")
    hit = F.col("phn") == pattern[0]
    for k, label in enumerate(pattern[1:], 1):
        hit = hit & F.coalesce(F.lead("phn", k).over(w) == label, F.lit(False))
    return segments.withColumn("_hit", hit).groupBy("utt").agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("has"))


def largest_peak(frames: DataFrame) -> DataFrame:
    """utt, frame, value of the largest local peak, the first on ties; frame -1 and no value if there is none."""
    v, a, b = F.col("value"), F.lag("value").over(by_frame()), F.lead("value").over(by_frame())
    key = F.when(F.col("_p"), F.struct("value", -F.col("frame")))
    out = frames.withColumn("_p", (v >= a) & (v >= b)).groupBy("utt").agg(F.max_by("frame", key).alias("frame"), F.max(F.when(F.col("_p"), v)).alias("value"))
    return out.withColumn("frame", F.coalesce("frame", F.lit(-1).cast("long")))


def seeded_sample(keys: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n keys that come first in an order fixed by the seed: the same ones on every run and cluster."""
    return keys.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
