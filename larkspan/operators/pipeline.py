"""Steps from samples to part features as pyspark.ml Transformers with Params: they compose into a Pipeline, are
saved and loaded with it, and plan as one job."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from larkspan.operators import features as ft


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _Step(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A Transformer whose Params are given by name and may be set when it is made."""

    DEFAULTS: dict = {}

    def __init__(self, **given) -> None:
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self._set(**given)

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))


class Preemphasis(_Step):
    """(utt, frame, value): each value less `weight` times the one before."""

    weight = _param("weight", "share of the sample before", TypeConverters.toFloat)
    DEFAULTS = {"weight": 0.95}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return ft.preemphasized(dataset, self.value("weight"))


class Spectra(_Step):
    """(utt, frame, S): log power of windows of samples (utt, frame, value), up to a frequency."""

    width = _param("width", "samples of a window", TypeConverters.toInt)
    hop = _param("hop", "samples from window to window", TypeConverters.toInt)
    length = _param("length", "values of the transform", TypeConverters.toInt)
    rate = _param("rate", "samples a second", TypeConverters.toFloat)
    cutoff = _param("cutoff", "frequency from which channels are left out", TypeConverters.toFloat)
    multitaper = _param("multitaper", "mean of five tapers, or a Hamming window", TypeConverters.toBoolean)
    DEFAULTS = {"width": 320, "hop": 80, "length": 512, "rate": 16000.0, "cutoff": 3000.0, "multitaper": True}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        channels = int(self.value("cutoff") / (self.value("rate") / self.value("length")))
        power = ft.spectra(dataset, self.value("width"), self.value("hop"), self.value("length"), self.value("multitaper"))
        return ft.logged(power, channels)


class Smoothing(_Step):
    """(utt, frame, S) convolved with a normal kernel along channels and time, every second channel kept."""

    size = _param("size", "taps of the kernel", TypeConverters.toInt)
    mode = _param("mode", "valid or same, along channels", TypeConverters.toString)
    every = _param("every", "channels from one kept to the next", TypeConverters.toInt)
    DEFAULTS = {"size": 7, "mode": "valid", "every": 2}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        g = ft.gaussian(self.value("size"))
        return ft.smoothed(dataset, g, g, self.value("mode"), self.value("every"))


class EdgeFeatures(_Step):
    """(utt, frame, freq, orient, frames, channels): bits of (utt, frame, S), and the size of their utterance."""

    mode = _param("mode", "edges, magnitude, both or gated", TypeConverters.toString)
    block = _param("block", "frames of a block of edges", TypeConverters.toInt)
    quantile = _param("quantile", "share of a block's positive values below its bar", TypeConverters.toFloat)
    spread = _param("spread", "steps that an edge spreads along its orientation", TypeConverters.toInt)
    least = _param("least", "lowest bar of each orientation", TypeConverters.toListFloat)
    magnitudeBlock = _param("magnitudeBlock", "frames of a window of magnitudes", TypeConverters.toInt)
    magnitudeQuantile = _param("magnitudeQuantile", "share of a window's values below its bar", TypeConverters.toFloat)
    magnitudeSpread = _param("magnitudeSpread", "reach of magnitude bits", TypeConverters.toInt)
    DEFAULTS = {"mode": "edges", "block": 40, "quantile": 0.7, "spread": 1, "least": [0.025, 0.025, 0.015, 0.015, 0.02, 0.02, 0.02, 0.02], "magnitudeBlock": 32, "magnitudeQuantile": 0.7, "magnitudeSpread": 1}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.value
        utt = W.partitionBy("utt")
        dataset = dataset.withColumns({"frames": F.count("*").over(utt), "channels": F.max(F.size("S")).over(utt).cast("long")})
        bits = ft.edge_features(dataset, get("mode"), get("block"), get("quantile"), get("spread"), get("least"), get("magnitudeBlock"), get("magnitudeQuantile"), get("magnitudeSpread"))
        if "frames" in bits.columns:
            return bits
        sizes = dataset.groupBy("utt").agg(F.count("*").alias("frames"), F.max(F.size("S")).cast("long").alias("channels"))
        return bits.join(sizes, "utt")


class PartFeatures(_Step):
    """(utt, frame, freq, part) of bits with frames and channels, as EdgeFeatures gives them."""

    shape = _param("shape", "parts, frames and channels of a part, orientations", TypeConverters.toListInt)
    probabilities = _param("probabilities", "of each place of each part, row by row", TypeConverters.toListFloat)
    least = _param("least", "bits of a patch that isn't background", TypeConverters.toInt)
    reach = _param("reach", "frames and channels that a part spreads", TypeConverters.toListInt)
    grid = _param("grid", "frames and channels from one kept cell to the next", TypeConverters.toListInt)
    DEFAULTS = {"least": 10, "reach": [2, 2], "grid": [1, 1]}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        count, dt, df, orients = self.value("shape")
        spark = dataset.sparkSession
        places = [(k + 1, i, j, o) for k in range(count) for i in range(dt) for j in range(df) for o in range(orients)]
        parts = spark.createDataFrame([(*at, p) for at, p in zip(places, self.value("probabilities"), strict=True)], "part int, dt int, df int, orient int, p double")
        return ft.part_features(dataset, None, parts, count, (dt, df), self.value("least"), tuple(self.value("reach")), None, tuple(self.value("grid")))
