"""Features against plain loops over whole arrays; utterances are dealt in chunks much shorter than they are."""

import numpy as np
import pytest

from larkspan.operators import features as ft


def spectrogram(seed, n, height, ties=False):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 5, (n, height)).astype(float) if ties else rng.normal(size=(n, height))


def frame_rows(spark, arrays):
    return spark.createDataFrame([(u, t, [float(x) for x in row]) for u, s in arrays.items() for t, row in enumerate(s)], "utt long, frame long, S array<double>")


def arrays_of(frame, column="S"):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.utt, r.frame)):
        out.setdefault(r.utt, []).append(r[column])
    return {u: np.array(rows) for u, rows in out.items()}


def cells_of(frame, *more):
    rows = [(r.utt, r.frame, r.freq, *(r[m] for m in more)) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def plain_edges(s):
    """(frames, 8, channels): each step, held against the steps before and behind on its line."""
    n, h = s.shape
    out = np.zeros((n, 8, h))
    for o, (dt, df) in enumerate(((1, 0), (0, 1), (1, 1), (1, -1))):
        for t in range(n):
            for f in range(h):
                # the anti-diagonal's step is kept at the lower of its two channels
                base = (t, f + 1) if (dt, df) == (1, -1) else (t, f)
                line = [(base[0] + k * dt, base[1] + k * df) for k in (-1, 0, 1, 2)]
                if not all(0 <= x < n and 0 <= y < h for x, y in line):
                    continue
                if df and not 1 <= f <= h - 3:
                    continue
                a, b, c = np.diff([s[x, y] for x, y in line])
                out[t, 2 * o, f] = b if b >= a and b >= c and b >= 0 else 0
                out[t, 2 * o + 1, f] = -b if b <= a and b <= c and b <= 0 else 0
    return out


def plain_bits(e, block, q, spread, least):
    n, _, h = e.shape
    out = set()
    spans = [(b, b + block, b, b + block) for b in range(0, n - n % block, block)]
    if n % block:
        spans.append((max(0, n - block), n, n - n % block, n))
    for lo, hi, first, last in spans:
        for o in range(8):
            positive = np.sort(e[lo:hi, o][e[lo:hi, o] > 0])
            if not len(positive):
                continue
            bar = max(positive[int(q * len(positive))], least[o])
            dt, df = ft.ORIENTATIONS[o]
            for t in range(lo, hi):
                for f in range(h):
                    if e[t, o, f] > 0 and e[t, o, f] >= bar:
                        for k in range(-spread, spread + 1):
                            x, y = t + k * dt, f + k * df
                            if lo <= x < hi and first <= x < last and 0 <= y < h:
                                out.add((x, y, o))
    return out


def plain_magnitudes(s, block, q, by_channel, spread, smooth, every):
    n, h = s.shape
    if smooth > 1:
        s = np.array([[row[max(0, f - smooth // 2) : f + smooth // 2 + 1].max() for f in range(h)] for row in s])
    s = s[:, :: max(1, every)]
    h, quarter = s.shape[1], block // 4
    on = np.zeros(s.shape, int)
    for k, first in enumerate(range(0, n, 2 * quarter)):
        lo, hi = max(0, first - quarter), min(n, first + 3 * quarter)
        for f in range(h):
            values = np.sort(s[lo:hi, f] if by_channel else s[lo:hi].ravel())
            whole = 3 * quarter * (1 if by_channel else h)
            rank = int(q * whole + 0.5) if k == 0 else int(q * len(values))
            bar = values[min(rank, len(values) - 1)]
            on[first : first + 2 * quarter, f] = s[first : first + 2 * quarter, f] >= bar
    if not spread:
        return {(t, f) for t, f in zip(*np.nonzero(on), strict=True)}
    out = set()
    for t in range(n):
        for f in range(h):
            if by_channel:
                hit = on[max(0, t - spread) : t + spread + 1, f].any()
            else:
                hit = on[t, f] or on[max(0, t - spread) : t + spread + 1, max(0, f - spread) : f + spread + 1].sum() >= spread
            if hit:
                out.add((t, f))
    return out


ARRAYS = {1: (17, False), 2: (23, True), 3: (8, True), 4: (3, False), 5: (1, False)}


@pytest.fixture(scope="module")
def arrays():
    return {u: spectrogram(u, n, 7, ties) for u, (n, ties) in ARRAYS.items()}


@pytest.mark.parametrize(("mode", "k", "m", "every"), [("valid", 3, 5, 2), ("same", 5, 1, 1), ("same", 4, 4, 3), ("valid", 7, 7, 1)])
def test_smoothing(spark, arrays, mode, k, m, every):
    g, h = np.arange(1, k + 1) / 10, np.arange(2, m + 2) / 7
    got = arrays_of(ft.smoothed(frame_rows(spark, arrays), list(g), list(h), mode, every, size=4))
    for u, s in arrays.items():
        by_freq = np.array([np.convolve(row, g, "full") for row in s])
        by_freq = by_freq[:, k - 1 : s.shape[1]] if mode == "valid" else by_freq[:, (k - 1) // 2 : (k - 1) // 2 + s.shape[1]]
        full = np.array([np.convolve(col, h, "full")[(m - 1) // 2 : (m - 1) // 2 + len(s)] for col in by_freq.T]).T
        np.testing.assert_allclose(got[u], full[:, ::every])


def test_kernels():
    assert abs(sum(ft.gaussian(7)) - 1) < 1e-12 and ft.gaussian(7)[3] == max(ft.gaussian(7))
    square = np.outer(ft.gaussian_by_width(5), ft.gaussian_by_width(5))
    x = np.arange(5)
    want = np.exp(-4 * np.log(2) * ((x[:, None] - 2) ** 2 + (x[None] - 2) ** 2) / 9)
    np.testing.assert_allclose(square, want / want.sum())


def test_edge_map(spark, arrays):
    got = arrays_of(ft.edge_map(frame_rows(spark, arrays), size=4), "E")
    for u, s in arrays.items():
        np.testing.assert_allclose(got[u], plain_edges(s), err_msg=str(u))


@pytest.mark.parametrize(("block", "q", "spread", "least"), [(5, 0.7, 2, 0.0), (10, 0.3, 0, 1.5), (40, 0.5, 3, 0.0)])
def test_edge_bits(spark, arrays, block, q, spread, least):
    edges = ft.edge_map(frame_rows(spark, arrays))
    got = cells_of(ft.edge_bits(edges, block, q, spread, (least,) * 8), "orient")
    assert got == {(u, *c) for u, s in arrays.items() for c in plain_bits(plain_edges(s), block, q, spread, (least,) * 8)}


@pytest.mark.parametrize(("by_channel", "spread", "smooth", "every"), [(True, 1, 0, 1), (True, 0, 3, 2), (False, 1, 0, 1), (False, 2, 3, 1), (False, 0, 0, 2)])
def test_magnitudes(spark, arrays, by_channel, spread, smooth, every):
    got = cells_of(ft.magnitude_bits(frame_rows(spark, arrays), 8, 0.6, by_channel, spread, smooth, every))
    assert got == {(u, *c) for u, s in arrays.items() for c in plain_magnitudes(s, 8, 0.6, by_channel, spread, smooth, every)}


@pytest.mark.parametrize("mode", ["edges", "magnitude", "both", "gated"])
def test_four_modes(spark, arrays, mode):
    got = cells_of(ft.edge_features(frame_rows(spark, arrays), mode, 10, 0.4, 1, mag_block=8, mag_q=0.5), "orient")
    want = set()
    for u, s in arrays.items():
        e = plain_edges(s)
        if mode == "magnitude":
            want |= {(u, *c, 8) for c in plain_magnitudes(s, 8, 0.5, True, 1, 0, 1)}
            continue
        on = plain_magnitudes(s, 8, 0.5, False, 1, 0, 1)
        if mode == "gated":
            keep = np.zeros(s.shape)
            for c in on:
                keep[c] = 1
            e = e * keep[:, None, :]
        want |= {(u, *c) for c in plain_bits(e, 10, 0.4, 1, (0,) * 8)}
        if mode == "both":
            want |= {(u, *c, 8) for c in on}
    assert got == want


def bank(count, dt, df, seed=9):
    return np.random.default_rng(seed).uniform(0.05, 0.95, (count, dt, df, 8))


def test_part_features(spark, arrays):
    p, least, reach, grid = bank(3, 2, 3), 4, (1, 1), (2, 3)
    graph = {1: 2}
    parts = spark.createDataFrame([(k + 1, i, j, o, float(p[k, i, j, o])) for k in range(3) for i in range(2) for j in range(3) for o in range(8)], "part int, dt int, df int, orient int, p double")
    bits = ft.edge_bits(ft.edge_map(frame_rows(spark, arrays)), 10, 0.3, 1)
    sizes = spark.createDataFrame([(u, *s.shape) for u, s in arrays.items()], "utt long, frames long, channels long")
    links = spark.createDataFrame([(a, b) for a, b in graph.items()], "part int, neighbour int")
    got = cells_of(ft.part_features(bits, sizes, parts, 3, (2, 3), least, reach, links, grid), "part")
    want, masked = set(), set()
    for u, s in arrays.items():
        n, h = s.shape
        x = np.zeros((n, h, 8))
        for t, f, o in plain_bits(plain_edges(s), 10, 0.3, 1, (0,) * 8):
            x[t, f, o] = 1
        coded = np.zeros((max(0, n - 1), max(0, h - 2)), int)
        for t in range(coded.shape[0]):
            for f in range(coded.shape[1]):
                patch = x[t : t + 2, f : f + 3]
                if patch.sum() >= least:
                    like = [np.where(patch, np.log(p[k]), np.log(1 - p[k])).sum().round(9) for k in range(3)]
                    coded[t, f] = int(np.argmax(like)) + 1
                    if patch[:, :, :4].sum() > 3:
                        masked.add((u, t, f, coded[t, f]))
        for t in range(0, coded.shape[0], grid[0]):
            for f in range(0, coded.shape[1], grid[1]):
                found = set(coded[max(0, t - 1) : t + 2, max(0, f - 1) : f + 2].ravel().tolist()) - {0}
                want |= {(u, t // grid[0], f // grid[1], k) for k in found | {graph[k] for k in found if k in graph}}
    assert got == want and want
    flagged = bits.withColumn("masked", bits.orient < 4)
    got = {c for c in cells_of(ft.code_patches(flagged, parts, 3, least, masked_least=3), "part") if c[1] < ARRAYS[c[0]][0] - 1 and c[2] < 5}
    assert got == masked and masked


@pytest.mark.parametrize("multitaper", [True, False])
def test_spectra(spark, multitaper):
    rng = np.random.default_rng(4)
    signals = {1: rng.normal(size=500), 2: rng.normal(size=32), 3: rng.normal(size=36), 4: rng.normal(size=20), 5: np.zeros(64)}
    rows = spark.createDataFrame([(u, t, float(x)) for u, s in signals.items() for t, x in enumerate(s)], "utt long, frame long, value double")
    tap = ft.tapers(32, 3.0, 5) if multitaper else np.hamming(32)[None]
    got = arrays_of(ft.spectra(ft.preemphasized(rows, 0.95, size=50), 32, 8, 64, multitaper, size=7))
    logs = arrays_of(ft.logged(ft.spectra(rows, 32, 8, 64, multitaper, size=7), 20))
    for u, s in signals.items():
        windows = max(0, int(0.5 + (len(s) - 32) / 8))
        assert (u in got) == (windows > 0)
        for pre, found in ((True, got), (False, logs)):
            v = np.append(np.append(s[:1], s[1:] - 0.95 * s[:-1]) if pre else s, np.zeros(32))
            want = [np.mean([np.abs(np.fft.fft(t * v[w * 8 : w * 8 + 32], 64)[:32]) ** 2 for t in tap], axis=0) for w in range(windows)]
            if pre and windows:
                np.testing.assert_allclose(found[u], want, rtol=1e-6, atol=1e-9)
            elif windows and u != 5:
                np.testing.assert_allclose(found[u], np.log(np.array(want)[:, :20]), rtol=1e-6, atol=1e-6)


def test_pipeline_is_saved_and_loaded(spark, tmp_path):
    """A loaded Pipeline gives the same rows, by one plan that scans the samples and broadcasts the parts only."""
    from pyspark.ml import Pipeline

    from larkspan.plans import feature_queries as fq

    signals = {1: 120, 2: 60, 3: 10}
    rng = np.random.default_rng(7)
    samples = spark.createDataFrame([(u, t, float(x)) for u, n in signals.items() for t, x in enumerate(rng.normal(size=n))], "utt long, frame long, value double")
    made = fq.signal_pipeline()
    made.write().overwrite().save(str(tmp_path / "p"))
    again = Pipeline.load(str(tmp_path / "p"))
    assert [type(x) for x in again.getStages()] == [type(x) for x in made.getStages()]
    got = cells_of(again.fit(samples).transform(samples), "part")
    assert got == cells_of(made.fit(samples).transform(samples), "part") and {u for u, *_ in got} <= {1, 2}

    # the whole way by loops
    want = set()
    p = np.array(made.getStages()[-1].value("probabilities")).reshape(2, 2, 3, 8)
    rng, tap = np.random.default_rng(7), ft.tapers(16, 3.0, 5)
    for u, n in signals.items():
        v = rng.normal(size=n)
        v = np.append(np.append(v[:1], v[1:] - 0.95 * v[:-1]), np.zeros(16))
        windows = int(0.5 + (n - 16) / 2)
        if windows <= 0:
            continue
        s = np.log([np.mean([np.abs(np.fft.fft(t * v[w * 2 : w * 2 + 16], 64)[:24]) ** 2 for t in tap], axis=0) for w in range(windows)])
        g = np.array(ft.gaussian(5))
        s = np.array([np.convolve(row, g, "valid") for row in s])
        s = np.array([np.convolve(col, g, "full")[2 : 2 + len(s)] for col in s.T]).T[:, ::2]
        x = np.zeros((*s.shape, 8))
        for t, f, o in plain_bits(plain_edges(s), 10, 0.4, 1, (0,) * 8):
            x[t, f, o] = 1
        coded = np.zeros((s.shape[0] - 1, s.shape[1] - 2), int)
        for t in range(coded.shape[0]):
            for f in range(coded.shape[1]):
                patch = x[t : t + 2, f : f + 3]
                if patch.sum() >= 3:
                    coded[t, f] = 1 + int(np.argmax([np.where(patch, np.log(q), np.log(1 - q)).sum().round(9) for q in p]))
        for t in range(0, coded.shape[0], 2):
            for f in range(coded.shape[1]):
                want |= {(u, t // 2, f, k) for k in set(coded[max(0, t - 1) : t + 2, max(0, f - 1) : f + 2].ravel().tolist()) - {0}}
    assert got == want and want


def test_patches_are_coded_in_as_many_tasks_as_their_cells_call_for(spark, monkeypatch):
    """Chunks of 8 frames whose patches reach into the next one: the same rows, in tasks of few cells."""
    rows = [(u, t, f, (t * 5 + f * 3 + u) % 8) for u in range(3) for t in range(40) for f in range(6) if (t * 7 + f * 11 + u) % 3]
    bits = spark.createDataFrame(rows, "utt long, frame long, freq long, orient int")
    bank = [(k, i, j, o, ((k * 7 + i * 5 + j * 3 + o * 11) % 13 + 1) / 16) for k in (1, 2) for i in range(3) for j in range(2) for o in range(8)]
    parts = spark.createDataFrame(bank, "part int, dt int, df int, orient int, p double")
    sizes = spark.createDataFrame([(u, 40, 6) for u in range(3)], "utt long, frames long, channels int")
    want = sorted(map(tuple, ft.code_patches(bits, parts, 2, 2).collect()))
    monkeypatch.setattr(ft, "PATCH_CHUNK", 8)
    monkeypatch.setattr(ft, "PATCH_CELLS", 40)
    out = ft.code_patches(bits, parts, 2, 2, sizes=sizes)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 300
    assert out.rdd.getNumPartitions() == 18


def test_signal_features_reads_its_samples_once(spark, tmp_path):
    """Each step reads the one before once, so samples are scanned once; before, steps that needed an utterance's size read everything again."""
    from larkspan.plans import feature_queries as fq

    rng = np.random.default_rng(11)
    rows = [(u, t, float(x)) for u, n in {1: 90, 2: 40}.items() for t, x in enumerate(rng.normal(size=n))]
    spark.createDataFrame(rows, "utt long, frame long, value double").write.parquet(str(tmp_path / "s"))
    samples = spark.read.parquet(str(tmp_path / "s"))
    out = fq.signal_pipeline().fit(samples).transform(samples)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {u for u, *_ in cells_of(out, "part")} == {1, 2}


def test_spectra_of_missing_samples_are_null(spark):
    """Windows with a null sample, over several chunks: null power, which takes the least power in logged."""
    rows = [(1, t, None if t == 30 else float(t * t % 7 + 1)) for t in range(90)]
    power = arrays_of(ft.spectra(spark.createDataFrame(rows, "utt long, frame long, value double"), 16, 4, 32, size=5))[1]
    assert [w for w, s in enumerate(power.tolist()) if None in s or np.isnan(np.array(s, float)).any()] == [w for w in range(18) if w * 4 <= 30 < w * 4 + 16]
