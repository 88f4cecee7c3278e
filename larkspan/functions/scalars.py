"""Column functions: clipping, quantising, frequency scales, frame arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def quantize(p: Column, bins: int) -> Column:
    """The midpoint of p's bin among equal bins of [0, 1); 1 stays as it is."""
    return F.when(p < 1, (F.floor(p * bins) + 0.5) / bins).otherwise(p)


def log_quantized(x: Column) -> Column:
    """Natural logarithm by a table of hundredths: index int(100 x + .5), entry 0 standing for -13.8155."""
    index = F.floor(F.lit(100.0) * x + 0.5)
    return F.when(index <= 0, F.lit(-13.8155)).otherwise(F.ln(index / 100))


def coarse(x: Column, factor: int) -> Column:
    return F.floor((x + factor / 2) / factor)


def hz_to_mel(f: Column) -> Column:
    """HTK's scale: 2595 log10(1 + f / 700)."""
    return 2595 * F.log10(1 + f / 700)


def mel_to_hz(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)


def hz_to_mel_linear(f: Column) -> Column:
    """The scale that is linear (200/3 Hz a step) below 1000 Hz and logarithmic (27 steps to 6400 Hz) above."""
    return F.when(f < 1000, f / F.lit(200 / 3)).otherwise(15 + F.ln(f / 1000) * F.lit(27) / F.ln(F.lit(6.4)))


def mel_linear_to_hz(z: Column) -> Column:
    return F.when(z < 15, z * F.lit(200 / 3)).otherwise(1000 * F.exp((z - 15) * F.ln(F.lit(6.4)) / 27))


def hz_to_bark(f: Column) -> Column:
    return 6 * F.asinh(f / 600)


def fpr_tpr_limits() -> tuple[float, float]:
    """The range of false positive rates over which the figure of merit averages."""
    return 1 / 360, 10 / 360
