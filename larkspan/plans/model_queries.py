"""Queries of clusters by recursion, cascades, starts, table functions, padding, inverted classifiers and the cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import tables as tf
from larkspan.operators import evaluate as ev
from larkspan.operators import features as ft
from larkspan.operators import intervals as iv
from larkspan.operators import inversion as inv
from larkspan.operators import models as md
from larkspan.operators import padding as pad
from larkspan.operators import sequence as sq
from larkspan.operators import splitting as sp
from larkspan.operators import starts
from larkspan.operators import templates as tp
from larkspan.plans.feature_queries import cells, spectrogram_frames
from larkspan.plans.queries import GAP, PEAK, bits, clusters, event_bits, examples, filters, frames, pairs, r6, truths
from larkspan.sources.tables import table

COARSE, FINE = (-6.0, -3.0, 0.0, 3.0, 6.0), (-20.0, -10.0, -5.0, 0.0, 5.0, 10.0, 20.0)
SEED, LONGEST = 11, 8
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def clusters_split(s, d):
    """clusters_c1 by the recursive query."""
    near = sq.peaks(frames(s, d), PEAK).select("utt", "frame", F.lit(GAP).alias("gap"), F.lit(5.0).alias("most"))
    return sp.split_clusters(near)


@query
def clusters_template_lengths(s, d):
    """Clusters of peaks by their components' template lengths, three to six frames, and one and a half times these."""
    lengths = s.range(4).select(F.col("id").alias("comp"), (F.col("id") + 3).cast("int").alias("len"))
    near = sq.peaks(frames(s, d), PEAK).select("utt", "frame", (F.floor(F.col("value")) % 4).alias("comp"))
    return sp.split_by_length(near, lengths)


@query
def cascade_roc(s, d):
    """Vectors by the coarse and the full scores of all classes, for pairs of thresholds."""
    scored = tp.coarse_to_fine(bits(s, d), filters(s, d), "vec_id", 4, -1e9)
    rows = scored.withColumn("score", r6("score")).join(table(s, d, "embeddings").select("vec_id", F.col("label").alias("truth")), "vec_id")
    rows = rows.select("coarse", "score", (F.col("label") == F.col("truth")).alias("positive"))
    return ev.cascade_roc(rows, COARSE, FINE, 100.0, 7).select("coarse", "threshold", r6("tpr").alias("tpr"), r6("fps").alias("fps"))


@query
def spread_starts(s, d):
    """Four starting centres by sampling of squared distances."""
    found = starts.centres(examples(s, d, False), 4, SEED)
    return s.createDataFrame([(i, c.round(6).tolist()) for i, c in enumerate(found)], "comp int, centre array<double>")


@query
def gmm_spread(s, d):
    """The mixture of gmm_diag from such centres."""
    rows = examples(s, d, False)
    w, m, v = md.gaussian_mixture(rows, 3, start=(starts.centres(rows, 3, SEED), starts.spread_of(rows)[1] ** 2))
    return s.createDataFrame([(i, round(float(w[i]), 6), m[i].round(6).tolist(), v[i].round(6).tolist()) for i in range(len(w))], "comp int, weight double, mean array<double>, var array<double>")


@query
def window_energy(s, d):
    """Windows of 12 values in steps of 5 by a table function over each utterance in order."""
    tf.register(s)
    rows = s.sql("SELECT * FROM windows_of(TABLE(SELECT utt, frame, value FROM {f}) PARTITION BY (utt) ORDER BY (frame), 12, 5)", f=frames(s, d).select("utt", "frame", "value"))
    return rows.select("utt", "win", r6(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)).alias("energy"))


@query
def vector_patches(s, d):
    """Patches of 16 components in steps of 12 by a lateral join with a table function."""
    tf.register(s)
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    rows = s.sql("SELECT e.vec_id, p.start, p.s FROM {e} e, LATERAL patches_of(e.x, 16, 12) p", e=e)
    return rows.select("vec_id", "start", r6(F.array_max("s")).alias("largest"), r6(F.aggregate("s", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query
def padded_examples(s, d):
    """Runs of labels as examples of event bits, padded to eight frames with background noise."""
    runs = sq.label_runs(frames(s, d)).select((F.col("utt") * 1000 + F.col("seg_idx")).alias("ex"), "utt", "start_frame", "end_frame")
    b, _ = event_bits(s, d)
    own = b.join(runs, (b.utt == runs.utt) & b.frame.between(F.col("start_frame"), F.col("end_frame") - 1))
    own = own.select("ex", (F.col("frame") - F.col("start_frame")).alias("dt"), F.col("f").alias("feat"))
    sizes = runs.select("ex", (F.col("end_frame") - F.col("start_frame")).alias("len"))
    return pad.pad_bits(own, sizes, [(k + 1) / 16 for k in range(6)], LONGEST, SEED)


@query
def false_positive_filters(s, d):
    """Second-stage filters: means of true against false positives of each predicted class, from even vectors."""
    judged = pairs(s, d).where("vec_id % 2 = 0").select("vec_id", "pred", (F.col("pred") == F.col("truth")).alias("positive"))
    out = inv.against_false_positives(bits(s, d).drop("label"), judged, "vec_id")
    return out.select("pred", "feat", r6("w").alias("w"), r6("c0").alias("c0"), "n_pos", "n_neg")


@query
def false_positive_scores(s, d):
    """The odd vectors of these classes by the second-stage filters."""
    both = pairs(s, d)
    judged = both.where("vec_id % 2 = 0").select("vec_id", "pred", (F.col("pred") == F.col("truth")).alias("positive"))
    b = bits(s, d).drop("label")
    f = inv.against_false_positives(b, judged, "vec_id").select("pred", "feat", "w", "c0")
    rows = b.join(both.where("vec_id % 2 = 1"), "vec_id").join(f, ["pred", "feat"])
    return rows.groupBy("vec_id", "pred", "truth").agg(r6(F.sum(F.col("c0") + F.col("w") * F.col("x"))).alias("score"))


@query
def uniform_negatives(s, d):
    """Each class's log-ratio weights as 8 frames of 8 features, and the one negative vector that they imply."""
    cells = filters(s, d).select("label", (F.col("feat") % 8).alias("freq"), "p", "w")
    return inv.uniform_negative(cells, "label", "freq").select("label", "freq", r6("q").alias("q"))


@query
def svm_templates(s, d):
    """A family of SVMs, class 0 against class 1, as pairs of templates."""
    rows = examples(s, d, True).where("label < 2")
    mean = bits(s, d).where("label = 0").groupBy("feat").agg(F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.avg("x"))).alias("p"))
    family = inv.svm_family(rows.select("x", (F.col("label") == 0).cast("int").alias("y")), (0.1, 1.0, 10.0))
    out = inv.inverted(family.withColumnRenamed("c", "cost").join(mean, "feat"), "cost")
    return out.select("cost", "feat", r6("q").alias("q"), r6("w").alias("w"), r6("scale").alias("scale"))


@query
def detection_rates(s, d):
    """False alarms a second and the share of truths found, a thousand frames of 5 ms."""
    return iv.rates(clusters(s, d), truths(s, d), 1000).select(r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query
def utterance_rates(s, d):
    return iv.rates_by_utterance(clusters(s, d), truths(s, d))


@query
def cluster_neighbourhoods(s, d):
    """Seven values around each cluster, for each purchase from two frames before to one after it; truth -1 is none."""
    starts_ = truths(s, d).withColumn("t_start", F.col("t_start") + 1)
    return iv.neighbourhoods(clusters(s, d), starts_, frames(s, d), -2, 1, 7).na.fill(-1, ["truth"])


def component_pairs(s, d):
    """confusion of classes with two components each, from even and odd vectors."""
    halves = bits(s, d).withColumn("label", F.col("label") * 2 + F.col("vec_id") % 2)
    f = tp.llr_filter(tp.class_templates(halves), tp.mean_background(halves))
    both = tp.linear_scores(halves, f, "vec_id").select("vec_id", F.floor(F.col("label") / 2).alias("label"), (F.col("label") % 2).alias("comp"), r6("score").alias("score"))
    return ev.component_confusion(both, table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("truth")), "vec_id")


@query
def component_confusion(s, d):
    return component_pairs(s, d)


@query
def component_errors(s, d):
    return ev.component_errors(component_pairs(s, d))


@query
def template_windows(s, d):
    """Windows of a hit, and the limits of clusters, from the longest run of each label."""
    runs = sq.label_runs(frames(s, d)).select("phn", (F.col("end_frame") - F.col("start_frame")).alias("len"))
    return ev.windows_of(runs, "phn")


@query
def frame_deltas(s, d):
    """Slopes of the channels over nine frames, the ends repeated."""
    return cells(ft.deltas(spectrogram_frames(s, d)))


@query
def mfcc_deltas(s, d):
    """Five liftered cepstra of eight mel bands with the energy in the first one's place, their slopes, and those of these."""
    power = ft.spectra(ft.preemphasized(frames(s, d).select("utt", "frame", "value")), 16, 4, 32, multitaper=False)
    base = ft.cepstra(ft.mel(power, 32.0, 8), 8, 5).select("utt", "frame", "S")
    first = ft.deltas(base, 5)
    out = None
    for kind, rows in enumerate((base, first, ft.deltas(first, 5))):
        one = cells(rows).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out
