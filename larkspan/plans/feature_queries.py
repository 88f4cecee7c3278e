"""Queries of the steps from samples to part features: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import features as ft
from larkspan.operators import pipeline as pl
from larkspan.plans.queries import frames, r6
from larkspan.sources.tables import table

#: Vectors of an utterance, when embeddings stand for a spectrogram's frames.
LENGTH = 50
BLOCK, Q, SPREAD, MAG_BLOCK, MAG_Q = 20, 0.6, 1, 16, 0.7
PARTS, SHAPE, LEAST, REACH, GRID = 4, (3, 4), 6, (1, 2), (3, 4)
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def spectrogram_frames(s: SparkSession, d: str) -> DataFrame:
    """Embeddings as frames of 64 channels, LENGTH of them an utterance."""
    at = F.col("vec_id")
    return table(s, d, "embeddings").select(F.floor(at / LENGTH).alias("utt"), (at % LENGTH).alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("S"))


def cells(rows: DataFrame) -> DataFrame:
    return rows.select("utt", "frame", F.posexplode("S").alias("channel", "x")).withColumn("x", r6("x") + 0.0)  # no zero below zero


def probability(part, dt, df, orient):
    return ((part * 7 + dt * 5 + df * 3 + orient * 11) % 13 + 1) / 16.0


def bank(s: SparkSession) -> DataFrame:
    """PARTS parts of SHAPE frames and channels and eight orientations, with fixed probabilities."""
    i = F.col("id")
    size = SHAPE[0] * SHAPE[1] * 8
    out = s.range(PARTS * size).select((F.floor(i / size) + 1).cast("int").alias("part"), (F.floor(i / (SHAPE[1] * 8)) % SHAPE[0]).cast("int").alias("dt"), (F.floor(i / 8) % SHAPE[1]).cast("int").alias("df"), (i % 8).cast("int").alias("orient"))
    return out.withColumn("p", probability(F.col("part"), F.col("dt"), F.col("df"), F.col("orient")))


@query
def smoothed_channels(s, d):
    """A normal kernel of seven taps inside the channels, and along time; every second channel."""
    g = ft.gaussian(7)
    return cells(ft.smoothed(spectrogram_frames(s, d), g, g, "valid", 2))


@query
def kernel_smooth(s, d):
    """The square kernel of five by five with a full width of three at half maximum."""
    g = ft.gaussian_by_width(5)
    return cells(ft.smoothed(spectrogram_frames(s, d), g, g, "same"))


@query
def edge_map(s, d):
    """The sum and number of each orientation's kept steps in each frame."""
    e = ft.edge_map(spectrogram_frames(s, d)).select("utt", "frame", F.posexplode("E").alias("orient", "x"))
    return e.select("utt", "frame", "orient", r6(F.aggregate("x", F.lit(0.0), lambda a, b: a + b)).alias("total"), F.size(F.filter("x", lambda v: v > 0)).alias("n"))


def bits(s: SparkSession, d: str, mode: str) -> DataFrame:
    return ft.edge_features(spectrogram_frames(s, d), mode, BLOCK, Q, SPREAD, mag_block=MAG_BLOCK, mag_q=MAG_Q)


@query
def edge_features_edges(s, d):
    return bits(s, d, "edges")


@query
def edge_features_magnitude(s, d):
    return bits(s, d, "magnitude")


@query
def edge_features_both(s, d):
    return bits(s, d, "both")


@query
def edge_features_gated(s, d):
    return bits(s, d, "gated")


def sizes(s: SparkSession, d: str) -> DataFrame:
    return spectrogram_frames(s, d).groupBy("utt").agg(F.count("*").alias("frames"), F.max(F.size("S")).alias("channels"))


@query
def part_features(s, d):
    graph = s.range(1, PARTS).select(F.col("id").cast("int").alias("part"), (F.col("id") + 1).cast("int").alias("neighbour"))
    return ft.part_features(bits(s, d, "edges"), sizes(s, d), bank(s), PARTS, SHAPE, LEAST, REACH, graph, GRID)


@query
def masked_part_code(s, d):
    """Parts of patches that hold enough bits where magnitudes are large too."""
    large = bits(s, d, "magnitude").select("utt", "frame", "freq", F.lit(True).alias("masked"))
    flagged = bits(s, d, "edges").join(large, ["utt", "frame", "freq"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
    return ft.code_patches(flagged, bank(s), PARTS, LEAST, masked_least=3, sizes=sizes(s, d))


@query
def log_spectra(s, d):
    """Log power of Hamming windows of 16 events after pre-emphasis, the lowest six channels."""
    samples = frames(s, d).select("utt", "frame", "value")
    return cells(ft.logged(ft.spectra(ft.preemphasized(samples), 16, 4, 32, multitaper=False), 6))


@query
def log_spectra_tapered(s, d):
    """As log_spectra, with the mean over five tapers."""
    samples = frames(s, d).select("utt", "frame", "value")
    return cells(ft.logged(ft.spectra(ft.preemphasized(samples), 16, 4, 32), 6))


def signal_pipeline() -> Pipeline:
    """Samples to part features, with a bank of two parts of two by three."""
    odds = [probability(k + 1, i, j, o) for k in range(2) for i in range(2) for j in range(3) for o in range(8)]
    return Pipeline(
        stages=[
            pl.Preemphasis(),
            pl.Spectra(width=16, hop=2, length=64, rate=64.0, cutoff=24.0),
            pl.Smoothing(size=5),
            pl.EdgeFeatures(block=10, quantile=0.4, least=[0.0] * 8),
            pl.PartFeatures(shape=[2, 2, 3, 8], probabilities=odds, least=3, reach=[1, 1], grid=[2, 1]),
        ]
    )


@query
def signal_features(s, d):
    """The whole way from the events' values to part features, as one Pipeline."""
    samples = frames(s, d).select("utt", "frame", "value")
    return signal_pipeline().fit(samples).transform(samples)
