"""Iterative models and sequential operators: Arrow-batched workers and small collected parameters."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_clusters(detections: DataFrame, gap: int, most: int) -> DataFrame:
    """utt, cid, c_start, c_end: detections part where the next is gap or more away, then clusters that span
    more than most part at their largest gap, the first on ties, until none does."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(pdf["frame"].to_numpy())
        todo, out = [c for c in np.split(times, np.flatnonzero(np.diff(times) >= gap) + 1)][::-1], []
        while todo:
            c = todo.pop()
            if c[-1] + 1 - c[0] > most and len(c) > 1:
                k = int(np.argmax(np.diff(c))) + 1
                todo += [c[k:], c[:k]]
            else:
                out.append((key[0], len(out), int(c[0]), int(c[-1]) + 1))
        return pd.DataFrame(out, columns=["utt", "cid", "c_start", "c_end"])

    return detections.select("utt", "frame").groupBy("utt").applyInPandas(run, "utt long, cid long, c_start long, c_end long")


def suppress(detections: DataFrame, reach: int) -> DataFrame:
    """utt, frame, value: best first, each keeping others less than reach frames away from being taken;
    the earlier of equal values first."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "frame"], ascending=[False, True])
        taken: list[int] = []  # in order, so that only the nearest on either side count
        keep = []
        for f in pdf["frame"].tolist():
            at = bisect(taken, f)
            ok = (at == 0 or f - taken[at - 1] >= reach) and (at == len(taken) or taken[at] - f >= reach)
            keep.append(ok)
            if ok:
                taken.insert(at, f)
        return pdf[np.array(keep, bool)]

    return detections.select("utt", "frame", "value").groupBy("utt").applyInPandas(run, "utt long, frame long, value double")


def bernoulli_mixture(examples: DataFrame, k: int, rounds: int = 20, tol: float = 1e-4, clip: float = 0.01, hard: bool = False) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(weights, templates, log likelihoods) of a Bernoulli mixture over examples (ex, x array of 0/1).

    Starts from ex mod k. hard: each example belongs to its best component alone, the first on ties, and its
    likelihood is that component's. A component that nothing belongs to keeps a weight of nearly 0. Each round is one job: workers add up the statistics of their rows under the
    present parameters, and k rows a partition come back."""
    dims = len(examples.select("x").head()[0])
    seen: list[float] = []
    weights, templates = None, None
    for _ in range(rounds):
        state = examples.sparkSession.sparkContext.broadcast((weights, templates))

        def stats(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            weights, templates = state.value
            total, sums, ll = np.zeros(k), np.zeros((k, dims)), 0.0
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["x"].to_numpy()).astype(float)
                if templates is None:
                    a = np.eye(k)[b["ex"].to_numpy() % k]
                else:
                    z = x @ np.log(templates / (1 - templates)).T + np.log(1 - templates).sum(axis=1) + np.log(weights)
                    top = z.max(axis=1, keepdims=True)
                    a = np.eye(k)[z.argmax(axis=1)] if hard else np.exp(z - top)
                    norm = a.sum(axis=1, keepdims=True)
                    a /= norm
                    ll += float((top + np.log(norm)).sum())
                total += a.sum(axis=0)
                sums += a.T @ x
            yield pd.DataFrame({"comp": range(k), "n": total, "s": list(sums), "ll": [ll, *[0.0] * (k - 1)]})

        got = examples.select("ex", "x").mapInPandas(stats, "comp int, n double, s array<double>, ll double").toPandas()
        n = got.groupby("comp")["n"].sum().to_numpy()
        s = np.stack([np.sum(np.stack(g.to_numpy()), axis=0) for _, g in got.groupby("comp")["s"]])
        if templates is not None:
            seen.append(float(got["ll"].sum()))
            if len(seen) > 1 and abs(seen[-1] - seen[-2]) <= tol * abs(seen[-2]):
                break
        weights, templates = np.maximum(n / n.sum(), 1e-12), np.clip(s / np.maximum(n, 1e-12)[:, None], clip, 1 - clip)
        state.unpersist()
    return weights, templates, seen


def gaussian_mixture(examples: DataFrame, k: int, rounds: int = 20, least: float = 1e-4, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, variances) of a mixture of diagonal normals over examples (ex, x), as above, or from
    start, (k centres, a variance for each feature), with equal weights."""
    dims = len(examples.select("x").head()[0])
    params = None if start is None else (np.full(k, 1 / k), start[0], np.tile(np.maximum(start[1], least), (k, 1)))
    for _ in range(rounds):
        state = examples.sparkSession.sparkContext.broadcast(params)

        def stats(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            total, one, two = np.zeros(k), np.zeros((k, dims)), np.zeros((k, dims))
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["x"].to_numpy()).astype(float)
                if state.value is None:
                    a = np.eye(k)[b["ex"].to_numpy() % k]
                else:
                    w, m, v = state.value
                    z = np.log(w) - 0.5 * (np.log(v).sum(axis=1) + (x**2) @ (1 / v).T - 2 * x @ (m / v).T + (m**2 / v).sum(axis=1))
                    a = np.exp(z - z.max(axis=1, keepdims=True))
                    a /= a.sum(axis=1, keepdims=True)
                total += a.sum(axis=0)
                one += a.T @ x
                two += a.T @ x**2
            yield pd.DataFrame({"comp": range(k), "n": total, "a": list(one), "b": list(two)})

        got = examples.select("ex", "x").mapInPandas(stats, "comp int, n double, a array<double>, b array<double>").toPandas()
        n = np.maximum(got.groupby("comp")["n"].sum().to_numpy(), 1e-12)
        one, two = (np.stack([np.sum(np.stack(g.to_numpy()), axis=0) for _, g in got.groupby("comp")[c]]) for c in "ab")
        mean = one / n[:, None]
        params = n / n.sum(), mean, np.maximum(two / n[:, None] - mean**2, least)
        state.unpersist()
    return params


def shift_mixture(examples: DataFrame, k: int, width: int, rounds: int = 15, least: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """(weights, means, variances, log likelihoods) of k diagonal normals over `width` values that lie at an
    unknown shift in each example (ex, x): component and shift are hidden, shifts are equally likely.

    Starts from component ex mod k at shift 0. A round is one job that brings back k rows a partition."""
    params, seen = None, []
    for _ in range(rounds):
        state = examples.sparkSession.sparkContext.broadcast(params)

        def stats(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            total, one, two, ll = np.zeros(k), np.zeros((k, width)), np.zeros((k, width)), 0.0
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["x"].to_numpy()).astype(float)
                win = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)  # example, shift, place
                if state.value is None:
                    a = np.zeros((*win.shape[:2], k))
                    a[np.arange(len(x)), 0, b["ex"].to_numpy() % k] = 1
                else:
                    w, m, v = state.value
                    square = win**2 @ (1 / v).T - 2 * win @ (m / v).T + (m**2 / v).sum(axis=1)
                    z = np.log(w / win.shape[1]) - 0.5 * (np.log(2 * np.pi * v).sum(axis=1) + square)
                    top = z.max(axis=(1, 2), keepdims=True)
                    a = np.exp(z - top)
                    norm = a.sum(axis=(1, 2), keepdims=True)
                    a /= norm
                    ll += float((top + np.log(norm)).sum())
                total += a.sum(axis=(0, 1))
                one += np.tensordot(a, win, axes=((0, 1), (0, 1)))
                two += np.tensordot(a, win**2, axes=((0, 1), (0, 1)))
            yield pd.DataFrame({"comp": range(k), "n": total, "a": list(one), "b": list(two), "ll": [ll, *[0.0] * (k - 1)]})

        got = examples.select("ex", "x").mapInPandas(stats, "comp int, n double, a array<double>, b array<double>, ll double").toPandas()
        n = np.maximum(got.groupby("comp")["n"].sum().to_numpy(), 1e-12)
        one, two = (np.stack([np.sum(np.stack(g.to_numpy()), axis=0) for _, g in got.groupby("comp")[c]]) for c in "ab")
        if params is not None:
            seen.append(float(got["ll"].sum()))
        mean = one / n[:, None]
        params = n / n.sum(), mean, np.maximum(two / n[:, None] - mean**2, least)
        state.unpersist()
    return *params, seen


def placed_mixture(examples: DataFrame, k: int, starts: int, shortest: int, lengths: int, background: np.ndarray, rounds: int = 10, clip: float = 0.01) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(weights by model and length, templates by model, frame and feature, log likelihoods) of Bernoulli
    templates that begin at one of `starts` frames and last shortest to shortest + lengths - 1 frames.

    Examples (ex, x) hold frames times features 0/1 values, row by row. Frames outside the object follow the
    background, so a placement is weighed by its frames' log ratios, running sums of which give all lengths
    at once. Model, start and length are hidden, starts equally likely. Begins with model ex mod k at the
    middle start, longest; a round is one job that brings back k rows a partition."""
    dims, longest = len(background), shortest + lengths - 1
    odds, none = np.log(background / (1 - background)), np.log(1 - background).sum()
    weights, templates, seen = None, None, []
    for _ in range(rounds):
        state = examples.sparkSession.sparkContext.broadcast((weights, templates))

        def stats(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            weights, templates = state.value
            used, sums, seen_at, ll = np.zeros((k, lengths)), np.zeros((k, longest, dims)), np.zeros((k, longest)), 0.0
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["x"].to_numpy()).astype(float).reshape(len(b), -1, dims)
                a = np.zeros((len(x), k, starts, lengths))
                if templates is None:
                    a[np.arange(len(x)), b["ex"].to_numpy() % k, starts // 2, -1] = 1
                else:
                    back = x @ odds + none
                    w, c = np.log(templates / (1 - templates)), np.log(1 - templates).sum(axis=2)
                    for s in range(starts):
                        ratio = np.einsum("nlf,klf->nkl", x[:, s : s + longest], w) + c - back[:, None, s : s + longest]
                        a[:, :, s] = np.cumsum(ratio, axis=2)[:, :, shortest - 1 :] + np.log(weights / starts)
                    top = a.max(axis=(1, 2, 3), keepdims=True)
                    a = np.exp(a - top)
                    norm = a.sum(axis=(1, 2, 3), keepdims=True)
                    a /= norm
                    ll += float((top + np.log(norm)).sum() + back.sum())
                used += a.sum(axis=(0, 2))
                for s in range(starts):
                    mass = np.repeat(a[:, :, s].sum(axis=2, keepdims=True), longest, axis=2)  # of placements that hold a frame
                    mass[:, :, shortest:] = np.cumsum(a[:, :, s, ::-1], axis=2)[:, :, ::-1][:, :, 1:]
                    sums += np.einsum("nkl,nlf->klf", mass, x[:, s : s + longest])
                    seen_at += mass.sum(axis=0)
            yield pd.DataFrame({"comp": range(k), "n": list(used), "s": list(sums.reshape(k, -1)), "m": list(seen_at), "ll": [ll, *[0.0] * (k - 1)]})

        got = examples.select("ex", "x").mapInPandas(stats, "comp int, n array<double>, s array<double>, m array<double>, ll double").toPandas()
        n, s, m = (np.stack([np.sum(np.stack(g.to_numpy()), axis=0) for _, g in got.groupby("comp")[c]]) for c in "nsm")
        if templates is not None:
            seen.append(float(got["ll"].sum()))
        weights = np.full((k, lengths), 1 / (k * lengths)) if templates is None else np.maximum(n / n.sum(), 1e-12)
        templates = np.clip(s.reshape(k, longest, dims) / np.maximum(m, 1e-12)[:, :, None], clip, 1 - clip)
        state.unpersist()
    return weights, templates, seen


def length_clusters(lengths: DataFrame, k: int, rounds: int = 20) -> list[float]:
    """Centres of 1-D k-means over a histogram of lengths (len, n), from quantiles, equal centres merged.
    The histogram is one row a distinct length and is what comes to the driver."""
    h = lengths.groupBy("len").agg(F.count("*").alias("n")).orderBy("len").toPandas()
    x, n = h["len"].to_numpy(float), h["n"].to_numpy(float)
    centres = np.unique(np.interp((np.arange(k) + 0.5) / k, np.cumsum(n) / n.sum(), x))
    for _ in range(rounds):
        near = np.abs(x[:, None] - centres[None]).argmin(axis=1)
        new = np.unique([np.average(x[near == j], weights=n[near == j]) for j in range(len(centres)) if (near == j).any()])
        if len(new) == len(centres) and np.allclose(new, centres):
            break
        centres = new
    return centres.tolist()


def linear_svm(rows: DataFrame, c: float = 1.0) -> DataFrame:
    """rows (x array, y 0 or 1, others) with margin, from a linear SVM with hinge loss."""
    data = rows.withColumn("_f", array_to_vector("x")).withColumn("_y", F.col("y").cast("double"))
    model = LinearSVC(featuresCol="_f", labelCol="_y", regParam=1 / c / 100, maxIter=30, predictionCol="_p", rawPredictionCol="_r").fit(data)
    from pyspark.ml.functions import vector_to_array

    return model.transform(data).withColumn("margin", vector_to_array("_r")[1]).drop("_f", "_y", "_p", "_r")


def tapers(n: int, nw: float, k: int) -> np.ndarray:
    """The first k discrete prolate spheroidal sequences of length n, by the tridiagonal matrix they belong to."""
    t = np.arange(n)
    m = np.diag(((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * nw / n))
    off = t[1:] * (n - t[1:]) / 2
    return np.linalg.eigh(m + np.diag(off, 1) + np.diag(off, -1))[1][:, ::-1][:, :k].T


def mel_matrix(bands: int, bins: int, rate: float) -> np.ndarray:
    """Triangles of equal width on the HTK mel scale, bands by bins of a real transform."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, bins)
    up, down = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def spectrogram(signals: DataFrame, width: int, hop: int, multitaper: bool = True, bands: int = 0, cepstra: int = 0, rate: float = 16000.0) -> DataFrame:
    """utt, frame, S: log power of each window of signals (utt, s array): mean over five tapers, or a Hamming
    window; on `bands` mel bands if given, and the first `cepstra` coefficients of their cosine transform.
    Zeros take the smallest positive power of the utterance; utterances shorter than a window have no row."""
    tap = tapers(width, 3.0, 5) if multitaper else np.hamming(width)[None]
    mel = mel_matrix(bands, width // 2 + 1, rate).T if bands else None
    i = np.arange(bands or width // 2 + 1)
    cosines = (np.cos(np.pi * np.arange(cepstra)[:, None] * (i + 0.5) / len(i)) * np.sqrt(2 / len(i))).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for utt, s in zip(b["utt"], b["s"], strict=True):
                s = np.asarray(s, float)
                if len(s) < width:
                    continue
                win = np.lib.stride_tricks.sliding_window_view(s, width)[::hop]
                p = (np.abs(np.fft.rfft(win[:, None, :] * tap, axis=2)) ** 2).mean(axis=1)
                if bands:
                    p = p @ mel
                p = np.log(np.where(p > 0, p, p[p > 0].min() if (p > 0).any() else 1.0))
                if cepstra:
                    p = p @ cosines
                out.append(pd.DataFrame({"utt": utt, "frame": np.arange(len(p)), "S": list(p)}))
            if out:
                yield pd.concat(out)

    return signals.select("utt", "s").mapInPandas(run, "utt long, frame long, S array<double>")
