"""From samples to part features: spectra by frame as array columns, smoothing, edges, magnitudes, parts.

Frames are rows (utt, frame, S) with one array of channels each; frames of an utterance count from 0 without
gaps. Bits are sparse rows (utt, frame, freq, orient). Where a frame needs its neighbours, utterances are
dealt in chunks of frames with as much overlap as is needed, so a task never holds a whole utterance. What a
step needs of a whole utterance (its frames, its least power) is a window's aggregate, which spills; so each step reads the one before once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from larkspan.operators.models import tapers

#: Frames of a chunk, without its overlap.
CHUNK = 4096
#: Frames of a chunk whose patches are coded together, and cells of the chunks that one task codes.
PATCH_CHUNK, PATCH_CELLS = 256, 1 << 18
#: Windows of a batch of spectra, and cells that a task's arrays hold at once.
SPECTRA, CELLS = 1 << 14, 1 << 20
#: (frames, channels) of a step along the eight orientations: rises and falls in time, frequency and both diagonals.
ORIENTATIONS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))
#: The orientation number of magnitude bits, beside the edges'.
MAGNITUDE = 8


def chunked(frames: DataFrame, before: int, after: int, size: int = CHUNK) -> DataFrame:
    """frames with _chunk and _own: each frame in its own chunk, and in a neighbouring one where that needs
    `before` frames ahead of its first or `after` frames behind its last."""
    first, last = F.floor((F.col("frame") - after) / size), F.floor((F.col("frame") + before) / size)
    out = frames.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))
    return out.withColumn("_own", F.floor(F.col("frame") / size) == F.col("_chunk"))


def _in_chunk() -> W:
    return W.partitionBy("utt", "_chunk").orderBy("frame")


def gaussian(size: int, scale: float = 1.0) -> list[float]:
    """exp(-scale (x - size // 2)^2 / 2) for x below size, with sum one."""
    g = [math.exp(-scale * (x - size // 2) ** 2 / 2) for x in range(size)]
    return [x / sum(g) for x in g]


def gaussian_by_width(size: int, fwhm: float = 3.0) -> list[float]:
    """One side of the square kernel with this full width at half maximum, the outer product of two of them."""
    return gaussian(size, 8 * math.log(2) / fwhm**2)


def preemphasized(samples: DataFrame, a: float = 0.95, size: int = CHUNK) -> DataFrame:
    """samples (utt, frame, value) with each value less a times the one before; the first stays."""
    rows = chunked(samples, 1, 0, size)
    before = F.lag("value").over(_in_chunk())
    rows = rows.withColumn("value", F.col("value") - F.lit(a) * F.coalesce(before, F.lit(0.0)))
    return rows.where("_own").drop("_chunk", "_own")


def spectra(samples: DataFrame, width: int, hop: int, length: int, multitaper: bool = True, size: int = CHUNK) -> DataFrame:
    """(utt, frame, S): the power of each window of samples (utt, frame, value) in the lower half of a transform
    of `length` values: mean over five tapers, or a Hamming window. There are int(.5 + (n - width) / hop)
    windows, the last of which may lack samples; these are zero.

    A chunk has `size` windows; its samples, and those that its last windows share with the next, are one array."""
    tap = tapers(width, 3.0, 5) if multitaper else np.hamming(width)[None]
    step = size * hop  # samples from chunk to chunk; with the step after them they tell how many windows a chunk has
    last = F.floor(F.col("frame") / step)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("frame") - step - width + 1) / step))
    rows = samples.where("utt IS NOT NULL").withColumn("_chunk", F.explode(F.sequence(first, last)))
    held = rows.groupBy("utt", "_chunk").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("held"))
    held = held.select("utt", F.col("_chunk").alias("chunk"), F.transform("held", lambda x: x["value"]).alias("held"))

    def batch(utt: list, frame: list, power: list) -> pa.RecordBatch:
        S = np.concatenate(power)
        S = pa.ListArray.from_arrays(np.arange(len(S) + 1, dtype=np.int32) * S.shape[1], pa.array(S.ravel(), from_pandas=True))  # not-a-number is null
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (utt, frame)] + [S], ["utt", "frame", "S"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.list_value_length(b["held"]).to_numpy())
            values = b["held"].flatten().to_numpy(zero_copy_only=False)
            out, ready = ([], [], []), 0
            for utt, chunk, s in zip(b["utt"].to_pylist(), b["chunk"].to_pylist(), np.split(values, ends[:-1]), strict=True):
                count = min(size, math.floor((len(s) - width) / hop + 0.5))
                if count <= 0:
                    continue
                s = np.pad(s, (0, max(0, (count - 1) * hop + width - len(s))))
                win = np.lib.stride_tricks.sliding_window_view(s, width)[::hop][:count]
                power = (np.abs(np.fft.rfft(win[:, None, :] * tap, length, axis=2)[:, :, : length // 2]) ** 2).mean(axis=1)
                for x, y in zip(out, (np.full(count, utt), chunk * size + np.arange(count), power), strict=True):
                    x.append(y)
                ready += count
                if ready >= SPECTRA:
                    yield batch(*out)
                    out, ready = ([], [], []), 0
            if ready:
                yield batch(*out)

    return held.mapInArrow(run, "utt long, frame long, S array<double>")


def logged(frames: DataFrame, channels: int) -> DataFrame:
    """The logarithms of the first channels of S; zeros take the utterance's smallest positive value. An utterance
    without any has zeros' logarithm as null."""
    cut = frames.where("utt IS NOT NULL").withColumn("S", F.slice("S", 1, channels))
    cut = cut.withColumn("_least", F.array_min(F.filter("S", lambda x: x > 0)))
    out = cut.withColumn("_least", F.min("_least").over(W.partitionBy("utt")))
    return out.withColumn("S", F.transform("S", lambda x: F.ln(F.when(x > 0, x).otherwise(F.col("_least"))))).drop("_least")


def _at(values: Column, i: Column) -> Column:
    return F.get(values, i.cast("int"))


def smoothed(frames: DataFrame, along_freq: Sequence[float], along_time: Sequence[float], mode: str = "valid", every: int = 1, size: int = CHUNK) -> DataFrame:
    """frames with S convolved by a separable kernel: along channels ('valid': only where the kernel lies inside;
    'same': as many as before, zeros outside), along time ('same'), then every `every`th channel."""
    k, m = len(along_freq), len(along_time)
    lead = 0 if mode == "valid" else k // 2  # of channels that the kernel reaches beyond the lower end
    count = F.size("S") - (k - 1 if mode == "valid" else 0)
    taps = list(enumerate(reversed([float(g) for g in along_freq])))

    def channel(i: Column) -> Column:
        total = F.lit(0.0)
        for j, g in taps:
            x = i * every + j - lead
            inside = _at(F.col("S"), x) if mode == "valid" else F.when((x >= 0) & (x < F.size("S")), _at(F.col("S"), x)).otherwise(0.0)
            total = total + F.lit(g) * inside
        return total

    kept = F.ceil(count / every).cast("int")
    rows = frames.withColumn("S", F.when(count > 0, F.transform(F.sequence(F.lit(0), kept - 1), channel)).otherwise(F.array().cast("array<double>")))
    if m == 1:
        return rows.withColumn("S", F.transform("S", lambda x: x * F.lit(float(along_time[0]))))
    ahead, behind = (m - 1) // 2, m - 1 - (m - 1) // 2  # out[t] = sum of g[k] S[t + (m - 1) // 2 - k]
    rows = chunked(rows, behind, ahead, size)
    near = []
    for j, g in enumerate(along_time):
        step = (m - 1) // 2 - j
        near.append((float(g), F.lead("S", step).over(_in_chunk()) if step >= 0 else F.lag("S", -step).over(_in_chunk())))
    rows = rows.select("*", *[c.alias(f"_s{i}") for i, (_, c) in enumerate(near)]).where("_own")

    def over_time(x: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for j, (g, _) in enumerate(near):
            total = total + F.lit(g) * F.coalesce(_at(F.col(f"_s{j}"), i), F.lit(0.0))
        return total

    out = rows.withColumn("_out", F.transform("S", over_time))
    return out.drop("S", "_chunk", "_own", *[f"_s{i}" for i in range(m)]).withColumnRenamed("_out", "S")


def _arrays() -> tuple[Callable, ...]:
    """The array work of edges and bits, as functions that travel to workers with the closures that call them."""

    def dense(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists as rows of the longest one's length: their values, which of them there are, and their lengths (no list: -1)."""
        n = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        slot = np.arange(max(n.max(initial=0), 0)) < n[:, None]
        values, there = np.full(slot.shape, np.nan), np.zeros(slot.shape, bool)
        values[slot] = flat.to_numpy(zero_copy_only=False)
        there[slot] = flat.is_valid().to_numpy(zero_copy_only=False)
        return values, there, n

    def steps(near: Sequence[tuple[np.ndarray, np.ndarray]], height: np.ndarray) -> np.ndarray:
        """edge_map's E (rows, 8, channels) of rows of channels, given as (values, which of them there are) for the frame
        before, the frame itself, and two behind. Values that aren't there have no steps; not-a-number is the largest, as in Spark."""
        p, a, b, c = near
        width = a[0].shape[-1]
        inner = (np.arange(width) >= 1) & (np.arange(width) <= height[..., None] - 3)

        def at(x, k):
            values, there = np.full_like(x[0], np.nan), np.zeros_like(x[1])
            to, of = (slice(0, max(width - k, 0)), slice(k, None)) if k >= 0 else (slice(-k, None), slice(0, max(width + k, 0)))
            values[..., to], there[..., to] = x[0][..., of], x[1][..., of]
            return values, there

        minus = lambda x, y: (x[0] - y[0], x[1] & y[1])
        least = lambda x, y: x[1] & y[1] & ((x[0] >= y[0]) | np.isnan(x[0]))
        zero = (np.zeros(1), np.ones(1, bool))
        lines = [
            (minus(b, a), minus(a, p), minus(c, b), True),
            (minus(at(a, 1), a), minus(a, at(a, -1)), minus(at(a, 2), at(a, 1)), inner),
            (minus(at(b, 1), a), minus(a, at(p, -1)), minus(at(c, 2), at(b, 1)), inner),
            (minus(b, at(a, 1)), minus(at(a, 1), at(p, 2)), minus(at(c, -1), b), inner),
        ]
        sides = []
        for step, before, behind, ok in lines:
            sides.append(np.where(least(step, before) & least(step, behind) & least(step, zero) & ok, step[0], 0.0))
            sides.append(np.where(least(before, step) & least(behind, step) & least(zero, step) & ok, -step[0], 0.0))
        return np.stack(sides, axis=-2)

    def lit(E: np.ndarray, height: np.ndarray, first: np.ndarray, last: np.ndarray, q: float, spread: int, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """edge_bits of blocks' E (blocks, frames, 8, channels): block, frame in it from first to before last, orientation, channel."""
        blocks, frames, _, width = E.shape
        positive = (E > 0) | np.isnan(E)
        ranked = np.sort(np.where(positive, E, np.nan).transpose(0, 2, 1, 3).reshape(blocks, 8, -1), axis=2)
        n = positive.sum(axis=(1, 3))
        at = np.floor(q * n).astype(int)
        bar = np.take_along_axis(ranked, np.clip(at, 0, frames * width - 1)[..., None], axis=2)[..., 0]
        bar = np.where((at >= 0) & (at < n), np.maximum(bar, least), least)
        on = positive & ((E >= bar[:, None, :, None]) | np.isnan(E))
        out = np.zeros_like(on)
        f = np.arange(width)
        shift = lambda k, size: (slice(max(k, 0), max(size + min(k, 0), 0)), slice(max(-k, 0), max(size - max(k, 0), 0)))
        for o, (dt, df) in enumerate(ORIENTATIONS):
            for k in range(-spread, spread + 1):
                inside = (f + k * df >= 0) & (f + k * df < height[..., None])
                (to, of), (up, low) = shift(k * dt, frames), shift(k * df, width)
                out[:, to, o, up] |= (on[:, :, o] & inside)[:, of, low]
        t = np.arange(frames)
        out &= ((t >= first[:, None]) & (t < last[:, None]))[:, :, None, None]
        return np.nonzero(out)

    return dense, steps, lit


def edge_map(frames: DataFrame, size: int = CHUNK) -> DataFrame:
    """frames (utt, frame, S) with E, eight arrays of channels: for each of ORIENTATIONS the step of S along it,
    where it is at least as large as the steps before and behind on the same line and not negative; zero
    elsewhere, and at the ends where one of these steps doesn't exist."""
    rows = chunked(frames, 1, 2, size)
    w = _in_chunk()
    rows = rows.select("*", F.lag("S").over(w).alias("_p"), F.lead("S").over(w).alias("_b"), F.lead("S", 2).over(w).alias("_c")).where("_own")
    dense, steps, _ = _arrays()

    @F.arrow_udf("array<array<double>>")
    def run(p: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        given = [dense(x) for x in (p, a, b, c)]
        height = given[1][2]
        width = max(x[0].shape[1] for x in given)
        wide = [[np.pad(y, ((0, 0), (0, width - y.shape[1]))) for y in x[:2]] for x in given]
        with np.errstate(invalid="ignore"):
            E = steps(wide, height)
        n = np.repeat(np.maximum(height, 0), 8)
        inner = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), E.reshape(-1, width)[np.arange(width) < n[:, None]], mask=pa.array(np.repeat(height < 0, 8)))
        return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * 8, inner)

    return rows.withColumn("E", run("_p", "S", "_b", "_c")).drop("_p", "_b", "_c", "_chunk", "_own")


def edge_steps(frames: DataFrame, size: int = CHUNK) -> DataFrame:
    """frames (utt, frame, S) with E, eight arrays of channels: rises in time, frequency and the two diagonals, then the
    falls, zero where a step isn't larger than the one before it on its line, or is smaller than the one behind; a
    step that has no neighbour on a side needn't be."""
    rows = chunked(frames, 1, 2, size)
    w = _in_chunk()
    rows = rows.select("*", F.lag("S").over(w).alias("_p"), F.lead("S").over(w).alias("_b"), F.lead("S", 2).over(w).alias("_c")).where("_own")
    p, a, b, c = (F.col(x) for x in ("_p", "S", "_b", "_c"))

    def kept(i: Column, line: int) -> Column:
        at = {0: ((p, 0), (a, 0), (b, 0), (c, 0)), 1: ((a, -1), (a, 0), (a, 1), (a, 2)), 2: ((p, -1), (a, 0), (b, 1), (c, 2)), 3: ((p, 1), (a, 0), (b, -1), (c, -2))}[line]
        v = [_at(x, i + k) for x, k in at]
        return F.struct((v[2] - v[1]).alias("d"), (v[1] - v[0]).alias("a"), (v[3] - v[2]).alias("b"))

    def side(steps: Column, sign: int) -> Column:
        def one(x: Column) -> Column:
            d, before, behind = sign * x["d"], sign * x["a"], sign * x["b"]
            return F.when((d > 0) & (before.isNull() | (d > before)) & (behind.isNull() | (d >= behind)), d).otherwise(0.0)

        return F.transform(steps, one)

    steps = lambda line: F.transform(F.sequence(F.lit(0), F.size("S") - 1), lambda i: kept(i, line))
    rows = rows.withColumns({f"_l{k}": steps(k) for k in range(4)})
    out = F.array(*[side(F.col(f"_l{k}"), sign) for sign in (1, -1) for k in range(4)])
    return rows.withColumn("E", out).drop("_p", "_b", "_c", "_chunk", "_own", *[f"_l{k}" for k in range(4)])


def gated(edges: DataFrame, bits: DataFrame) -> DataFrame:
    """edges (utt, frame, E) with zeros wherever bits (utt, frame, freq) has no row."""
    on = bits.groupBy("utt", "frame").agg(F.collect_set("freq").alias("_on"))
    rows = edges.join(on, ["utt", "frame"], "left")
    keep = lambda row: F.transform(row, lambda x, i: F.when(F.array_contains(F.coalesce(F.col("_on"), F.array().cast("array<long>")), i.cast("long")), x).otherwise(0.0))
    return rows.withColumn("E", F.transform("E", keep)).drop("_on")


def edge_bits(edges: DataFrame, block: int, q: float, spread: int = 0, least: Sequence[float] = (0.0,) * 8) -> DataFrame:
    """Distinct (utt, frame, freq, orient) of edges (utt, frame, E), or of frames (utt, frame, S), whose edge_map is made by the way.

    In each block of frames and each orientation the positive values are ranked; the bits are those at or above
    the one of 0-based rank int(q n), and at or above `least`. They spread along their orientation both ways within
    the block. A partial last block takes the utterance's last `block` frames for its ranks and its spreading.

    A block is one row for the arrays' work, so the input is read once. If there are columns frames and channels, the
    utterance's size, bits have them too."""
    made = "E" in edges.columns
    ahead, behind = (0, 0) if made else (1, 2)  # frames beside a block that its steps need
    sized = [x for x in ("frames", "channels") if x in edges.columns]
    rows = edges.where("utt IS NOT NULL")
    n = F.col("frames") if "frames" in sized else F.count("*").over(W.partitionBy("utt"))
    rows = rows.select("utt", "frame", F.col("E" if made else "S").alias("x"), *sized, n.alias("_n"))
    whole = F.floor(F.col("_n") / block)
    low = F.greatest(F.floor((F.col("frame") - behind) / block), F.lit(0).cast("long"))
    high = F.least(F.floor((F.col("frame") + ahead) / block), whole - 1)
    tail = (F.col("_n") % block != 0) & (F.col("frame") >= F.col("_n") - block - ahead)
    groups = F.concat(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")), F.when(tail, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    held = rows.withColumn("_g", F.explode(groups)).groupBy("utt", "_g", "_n", *sized).agg(F.collect_list(F.struct("frame", "x")).alias("held"))
    start = F.when(F.col("_g") >= 0, F.col("_g") * block).otherwise(F.greatest(F.col("_n") - block, F.lit(0).cast("long")))
    first = F.when(F.col("_g") >= 0, start).otherwise(whole * block)
    last = F.when(F.col("_g") >= 0, start + block).otherwise(F.col("_n"))
    bars = np.array([float(x) for x in least])
    dense, steps, lit = _arrays()

    def some(held: pa.Array, start: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        of = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
        frame, x = (held.flatten().field(k) for k in (0, 1))
        at = (of, frame.to_numpy() - start[of] + ahead)
        if made:
            values, there, height = dense(x.flatten())  # eight a frame, or none
            full = x.is_valid().to_numpy(zero_copy_only=False)
            at, height = tuple(a[full] for a in at), height[::8]
            values = np.where(there, values, 0.0).reshape(-1, 8, values.shape[1])
            E = np.zeros((len(held), block, *values.shape[1:]))
            E[at] = values
        else:
            values, there, height = dense(x)
            S, seen = np.full((len(held), block + ahead + behind, values.shape[1]), np.nan), np.zeros((len(held), block + ahead + behind, values.shape[1]), bool)
            S[at], seen[at] = values, there
        heights = np.zeros((len(held), block + ahead + behind), int)
        heights[at] = height
        heights = heights[:, ahead : ahead + block]
        if not made:
            E = steps([(S[:, k : k + block], seen[:, k : k + block]) for k in range(4)], heights)
        if not E.shape[-1]:
            return [np.zeros(0, int)] * 4
        g, t, o, f = lit(E, heights, first - start, last - start, q, spread, bars)
        return [g, start[g] + t, f, o]

    @F.arrow_udf("array<struct<frame: bigint, freq: bigint, orient: int>>")
    def run(held: pa.Array, start: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        begin = [x.to_numpy() for x in (start, first, last)]
        longest = pc.max(pc.list_value_length(held.flatten().field(1).flatten() if made else held.flatten().field(1))).as_py() or 1
        step = max(1, CELLS // (8 * block * longest))
        found = []
        for i in range(0, len(held), step):
            with np.errstate(invalid="ignore"):
                g, *cells = some(held[i : i + step], *[x[i : i + step] for x in begin])
            found.append([g + i, *cells])
        g, frame, freq, orient = (np.concatenate(x) for x in zip(*found, strict=True))
        cells = pa.StructArray.from_arrays([pa.array(frame.astype(np.int64)), pa.array(freq.astype(np.int64)), pa.array(orient.astype(np.int32))], ["frame", "freq", "orient"])
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(g, minlength=len(held)))).astype(np.int32), cells)

    bits = held.withColumn("_bit", F.explode(run("held", start, first, last)))
    return bits.select("utt", *[F.col(f"_bit.{x}").alias(x) for x in ("frame", "freq", "orient")], *sized)


def magnitude_bits(frames: DataFrame, block: int, q: float, by_channel: bool = True, spread: int = 1, smooth: int = 0, every: int = 1) -> DataFrame:
    """Distinct (utt, frame, freq) where S is large for its surroundings.

    S may be replaced by the largest of `smooth` (odd) channels around each, and cut to every `every`th channel.
    Spans of half a block are held against the value of 0-based rank int(q n) in a window of up to a block that
    begins a quarter before them: of each channel, which then spreads along time, or of all together, where a bit
    then lights a cell if it has `spread` bits around it in the box of that radius, or its own. The first window
    has three quarters of a block, and there int(q n + .5) of a whole window's n."""
    quarter = block // 4
    half = F.lit(2 * quarter)
    rows = frames.select("utt", "frame", "S")
    if smooth > 1:
        r = smooth // 2
        near = lambda x, i: F.array_max(F.slice(F.col("S"), F.greatest(i - r, F.lit(0)) + 1, F.least(i + r, F.size("S") - 1) - F.greatest(i - r, F.lit(0)) + 1))
        rows = rows.withColumn("S", F.transform("S", near))
    if every > 1:
        rows = rows.withColumn("S", F.filter("S", lambda x, i: i % every == 0))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("frame") - 3 * quarter + 1) / half))
    last = F.floor((F.col("frame") + quarter) / half)
    seen = rows.withColumn("_k", F.explode(F.sequence(first, last)))
    height = F.size(F.get("v", F.lit(0)))
    windows = seen.groupBy("utt", "_k").agg(F.collect_list("S").alias("v"))  # a block of frames at most
    n = F.size("v") * (F.lit(1) if by_channel else height)
    whole = F.lit(3 * quarter) * (F.lit(1) if by_channel else height)
    rank = F.least(n - 1, F.when(F.col("_k") == 0, F.floor(F.lit(float(q)) * whole + 0.5)).otherwise(F.floor(F.lit(float(q)) * n)).cast("int")).cast("int")
    bar = lambda values: F.get(F.array_sort(values), rank)
    channels = F.sequence(F.lit(0), height - 1)
    if by_channel:
        bars = F.transform(channels, lambda f: bar(F.transform("v", lambda s: F.get(s, f))))
    else:
        windows = windows.withColumn("_bar", bar(F.flatten("v")))
        bars = F.transform(channels, lambda f: F.col("_bar"))
    windows = windows.select("utt", "_k", bars.alias("_bars"))
    cells = rows.withColumn("_k", F.floor(F.col("frame") / half)).join(windows, ["utt", "_k"])
    bits = cells.select("utt", "frame", F.size("S").alias("_h"), F.posexplode(F.zip_with("S", "_bars", lambda x, y: x >= y)).alias("freq", "_on")).where("_on").drop("_on")
    if not spread:
        return bits.select("utt", "frame", F.col("freq").cast("long").alias("freq"))
    n = frames.groupBy("utt").agg(F.count("*").alias("_n"))
    near = F.sequence(F.lit(-spread), F.lit(spread))
    bits = bits.withColumn("_x", F.explode(near))
    if by_channel:
        out = bits.withColumn("frame", F.col("frame") + F.col("_x")).join(n, "utt").where("frame >= 0 AND frame < _n")
        return out.select("utt", "frame", F.col("freq").cast("long").alias("freq")).distinct()
    bits = bits.withColumn("_y", F.explode(near))
    weight = F.when((F.col("_x") == 0) & (F.col("_y") == 0), spread).otherwise(1)
    bits = bits.select("utt", "_h", (F.col("frame") + F.col("_x")).alias("frame"), (F.col("freq") + F.col("_y")).alias("freq"), weight.alias("_w"))
    bits = bits.join(n, "utt").where("frame >= 0 AND frame < _n AND freq >= 0 AND freq < _h")
    out = bits.groupBy("utt", "frame", "freq").agg(F.sum("_w").alias("_w")).where(F.col("_w") >= spread)
    return out.select("utt", "frame", F.col("freq").cast("long").alias("freq"))


def edge_features(frames: DataFrame, mode: str, block: int, q: float, spread: int, least: Sequence[float] = (0.0,) * 8, mag_block: int = 32, mag_q: float = 0.7, mag_spread: int = 1, mag_smooth: int = 0, mag_every: int = 1) -> DataFrame:
    """(utt, frame, freq, orient) by one of four modes: 'edges'; 'magnitude', where all bits have the orientation
    MAGNITUDE; 'both'; and 'gated', where edges count only where the magnitude of all channels together is large.
    Bits of edges alone have the columns frames and channels, the size of the utterance, if frames have."""
    mags = lambda by_channel: magnitude_bits(frames, mag_block, mag_q, by_channel, mag_spread, mag_smooth, mag_every)
    if mode == "magnitude":
        return mags(True).withColumn("orient", F.lit(MAGNITUDE))
    if mode not in ("edges", "both", "gated"):
        raise ValueError(f"no such mode: {mode}")
    edges = gated(edge_map(frames), mags(False)) if mode == "gated" else frames
    bits = edge_bits(edges, block, q, spread, least)
    return bits.select("utt", "frame", "freq", "orient").unionByName(mags(False).withColumn("orient", F.lit(MAGNITUDE))) if mode == "both" else bits


def code_patches(bits: DataFrame, parts: DataFrame, count: int, least: int, masked_least: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(utt, frame, freq, part) for cells whose patch of shape (frames, channels) from them on holds `least` bits:
    the part, from 1 to count, with the largest log likelihood, the lowest number on ties; other cells have
    no row. With masked_least, over so many bits must also lie where the column `masked` is true.

    parts (part, dt, df, orient, p) are a bank of `count` parts with a p for each place, small by its nature. Bits are dealt by
    chunks of frames, into as many tasks as sizes (utt, frames, channels), if given, call for, with what the next chunk shares, so
    all bits of a patch are in one row for the arrays' work, however long the table. Without sizes, bits may have the columns frames and
    channels, which their cells then have too."""
    odds = F.ln(F.col("p") / (1 - F.col("p")))
    bank = parts.select("part", "dt", "df", "orient", odds.alias("w"), F.sum(F.ln(1 - F.col("p"))).over(W.partitionBy("part")).alias("c")).toPandas()
    reach, freqs, orients = (int(bank[x].max() or 0) + 1 if len(bank) else 1 for x in ("dt", "df", "orient"))
    weights, known, base = np.zeros((reach, freqs, orients, count)), np.zeros((reach, freqs, orients), bool), np.full(count, -np.inf)
    at = tuple(bank[x].to_numpy(int) for x in ("dt", "df", "orient"))
    weights[(*at, bank["part"].to_numpy(int) - 1)], known[at] = bank["w"].fillna(0.0), True
    base[bank["part"].to_numpy(int) - 1] = bank["c"]
    size, reach = PATCH_CHUNK, reach - 1
    sized = [x for x in ("frames", "channels") if x in bits.columns] if sizes is None else []
    chunks = F.sequence(F.greatest(F.floor((F.col("frame") - reach) / size), F.lit(0).cast("long")), F.floor(F.col("frame") / size))
    dealt = bits.withColumn("_chunk", F.explode(chunks))
    if sizes is not None:
        cells = sizes.agg(F.sum(F.col("frames") * F.col("channels"))).first()[0] or 0
        dealt = dealt.repartition(max(int(bits.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(cells / PATCH_CELLS)), "utt", "_chunk")
    masked = F.col("masked").cast("long") if masked_least is not None else F.lit(0).cast("long")
    code = (F.col("frame") - F.col("_chunk") * size) * F.lit(1 << 40) + F.col("freq") * F.lit(1 << 8) + F.col("orient") * F.lit(2) + masked  # one number a bit
    held = dealt.groupBy("utt", "_chunk", *sized).agg(F.collect_list(code).alias("held"))

    def some(of: np.ndarray, code: np.ndarray, groups: int) -> list[np.ndarray]:
        order = np.lexsort((code, of))
        of, code = of[order], code[order]
        t, f, o, over = code >> 40, (code >> 8) & ((1 << 32) - 1), (code >> 1) & 127, code & 1
        last = (min(int(t.max(initial=0)) + 1, size), int(f.max(initial=0)) + 1)
        n, mask, like = np.zeros(groups * last[0] * last[1]), np.zeros(groups * last[0] * last[1]), np.zeros((count, groups * last[0] * last[1]))
        for dt, df in np.ndindex(reach + 1, freqs):
            ok = (o < orients) & (t >= dt) & (t - dt < size) & (f >= df)
            ok[ok] = known[dt, df, o[ok]]
            cell = (of[ok] * last[0] + t[ok] - dt) * last[1] + f[ok] - df
            n += np.bincount(cell, minlength=len(n))
            if masked_least is not None:
                mask += np.bincount(cell, over[ok], minlength=len(n))
            for k in range(count):
                like[k] += np.bincount(cell, weights[dt, df, o[ok], k], minlength=len(n))
        cell = np.flatnonzero((n >= max(least, 1)) & (mask > masked_least if masked_least is not None else True))
        part = np.argmax(np.round(like[:, cell] + base[:, None], 9), axis=0) + 1
        return [cell // (last[0] * last[1]), cell // last[1] % last[0], cell % last[1], part]

    @F.arrow_udf("array<struct<frame: bigint, freq: bigint, part: int>>")
    def run(held: pa.Array, chunk: pa.Array) -> pa.Array:
        code = held.flatten().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False)))
        width = int(((code >> 8) & ((1 << 32) - 1)).max(initial=0)) + 1
        step = max(1, CELLS // (min(int((code >> 40).max(initial=0)) + 1, size) * width))
        found = []
        for i in range(0, len(held), step):
            j = min(i + step, len(held))
            g, *cells = some(np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])), code[ends[i] : ends[j]], j - i)
            found.append([g + i, *cells])
        g, t, f, part = (np.concatenate(x) for x in zip(*found, strict=True))
        cells = pa.StructArray.from_arrays([pa.array((t + chunk.to_numpy()[g] * size).astype(np.int64)), pa.array(f.astype(np.int64)), pa.array(part.astype(np.int32))], ["frame", "freq", "part"])
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(g, minlength=len(held)))).astype(np.int32), cells)

    out = held.withColumn("_cell", F.explode(run("held", "_chunk")))
    return out.select("utt", *[F.col(f"_cell.{x}").alias(x) for x in ("frame", "freq", "part")], *sized)


def part_features(bits: DataFrame, sizes: DataFrame | None, parts: DataFrame, count: int, shape: tuple[int, int], least: int, reach: tuple[int, int], graph: DataFrame | None = None, grid: tuple[int, int] = (1, 1)) -> DataFrame:
    """Distinct (utt, frame, freq, part): parts coded, spread over a box, joined by their neighbours in a graph (part,
    neighbour), and kept at every grid-th frame and channel, which are numbered anew.

    sizes (utt, frames, channels) tell how far patches and spreading may go; without them, bits have their columns frames and channels."""
    dt, df = shape
    coded = code_patches(bits, parts, count, least, sizes=sizes)
    coded = coded.join(sizes, "utt") if sizes is not None else coded.where("utt IS NOT NULL")
    rows, cols = F.col("frames") - (dt - 1), F.col("channels") - (df - 1)
    coded = coded.where((F.col("frame") < rows) & (F.col("freq") < cols))
    near = coded.withColumn("_x", F.explode(F.sequence(F.lit(-reach[0]), F.lit(reach[0])))).withColumn("_y", F.explode(F.sequence(F.lit(-reach[1]), F.lit(reach[1]))))
    near = near.withColumns({"frame": F.col("frame") + F.col("_x"), "freq": F.col("freq") + F.col("_y")})
    near = near.where((F.col("frame") >= 0) & (F.col("frame") < rows) & (F.col("freq") >= 0) & (F.col("freq") < cols))
    near = near.where((F.col("frame") % grid[0] == 0) & (F.col("freq") % grid[1] == 0))
    out = near.select("utt", F.floor(F.col("frame") / grid[0]).alias("frame"), F.floor(F.col("freq") / grid[1]).alias("freq"), "part")
    if graph is not None:
        own = graph.sparkSession.range(1, count + 1).select(F.col("id").cast("int").alias("part"), F.col("id").cast("int").alias("neighbour"))
        out = out.join(graph.select("part", "neighbour").unionByName(own), "part").select("utt", "frame", "freq", F.col("neighbour").alias("part"))
    return out.distinct()


def mel(frames: DataFrame, rate: float, bands: int) -> DataFrame:
    """The logarithm of power S on mel bands, and energy, the sum of S. Bins are those of a transform twice as long."""
    from larkspan.operators.models import mel_matrix

    @F.pandas_udf("array<double>")
    def run(power: pd.Series) -> pd.Series:
        if not len(power):
            return power
        p = np.stack(power.to_numpy())
        weights = mel_matrix(bands, p.shape[1] + 1, rate)[:, :-1]  # the highest bin isn't in S
        on = p @ weights.T
        return pd.Series(list(np.log(np.where(on > 0, on, 1e-300))))

    return frames.withColumn("energy", F.aggregate("S", F.lit(0.0), lambda a, x: a + x)).withColumn("S", run("S"))


def cepstra(frames: DataFrame, bands: int, count: int, lift: float = 0.6) -> DataFrame:
    """The first `count` coefficients of the orthonormal cosine transform of S, which has `bands` values, the kth above
    the first times k to the power of lift; with a column energy that takes the first one's place."""
    rows = []
    for k in range(count):
        scale = math.sqrt((1 if k == 0 else 2) / bands) * (1.0 if k == 0 else float(k) ** lift)
        rows.append(F.array(*[F.lit(scale * math.cos(math.pi * k * (2 * j + 1) / (2 * bands))) for j in range(bands)]))
    out = [F.aggregate(F.zip_with("S", r, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) for r in rows]
    if "energy" in frames.columns:
        out[0] = F.col("energy")
    return frames.withColumn("S", F.array(*out))


def deltas(frames: DataFrame, window: int = 9, size: int = CHUNK) -> DataFrame:
    """The slope of each of S's values over a window of frames around, the first and last frame standing in beyond
    the ends."""
    half = window // 2
    rows = chunked(frames, half, half, size)
    w, whole = _in_chunk(), _in_chunk().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    denominator = float(sum(k * k for k in range(-half, half + 1)))
    near = {k: F.coalesce(F.lead("S", k).over(w), F.last("S").over(whole)) if k > 0 else F.coalesce(F.lag("S", -k).over(w), F.first("S").over(whole)) for k in range(-half, half + 1) if k}
    rows = rows.select("*", *[c.alias(f"_s{k + half}") for k, c in near.items()]).where("_own")

    def slope(x: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k in near:
            total = total + F.lit(k / denominator) * _at(F.col(f"_s{k + half}"), i)
        return total

    return rows.withColumn("_out", F.transform("S", slope)).drop("S", "_chunk", "_own", *[f"_s{k + half}" for k in near]).withColumnRenamed("_out", "S")
