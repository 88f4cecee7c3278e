import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspan.functions import scalars as fn
from larkspan.operators import evaluate, intervals, models, sequence, templates
from larkspan.streaming import running


def frames(spark, values, utt=1, phn="a"):
    return spark.createDataFrame([(utt, i, phn, float(v)) for i, v in enumerate(values)], "utt long, frame long, phn string, value double")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_peaks_keep_plateaus_and_skip_ends(spark):
    f = frames(spark, [9, 1, 5, 5, 1, 2, 9])
    assert got(sequence.peaks(f, 2.0), "frame") == [(2,), (3,)]
    assert got(sequence.strict_peaks(frames(spark, [0, 5, 5, 5, 0]), 2.0), "frame") == [(1,), (3,)]
    assert got(sequence.peaks(frames(spark, [7]), 0.0), "frame") == []


def test_gap_of_exactly_c0_breaks_and_span_of_exactly_c1_stays(spark):
    d = spark.createDataFrame([(1, x, 1.0) for x in (0, 3, 7, 9, 12)], "utt long, frame long, value double")
    assert got(sequence.cluster_c0(d, 4), "c_start", "c_end") == [(0, 4), (7, 13)]
    assert got(models.split_clusters(d, 4, 6), "c_start", "c_end") == [(0, 4), (7, 13)]
    assert got(models.split_clusters(d, 4, 5), "c_start", "c_end") == [(0, 4), (7, 10), (12, 13)]


def test_touching_intervals_do_not_overlap(spark):
    c = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 8, 20)], "utt long, cid long, c_start long, c_end long")
    t = spark.createDataFrame([(1, 5, 8), (1, 9, 10), (1, 12, 13)], "utt long, t_start long, t_end long")
    assert got(intervals.truth_hits(c, t), "cid", "hits") == [(0, 0), (1, 2)]
    assert got(intervals.missed(c, t), "t_start") == [(5,)]
    assert got(intervals.false_alarms(c, t), "cid") == [(0,)]


def test_pattern_may_end_on_the_last_label(spark):
    seg = spark.createDataFrame([(1, i, i + 1, p) for i, p in enumerate("abab")], "utt long, start_frame long, end_frame long, phn string")
    assert got(sequence.pattern_match(seg, ["a", "b"]), "start_frame", "end_frame") == [(0, 2), (2, 4)]


@pytest.mark.parametrize("n", [7, 20, 33])
def test_block_threshold_against_a_loop(spark, n):
    v = np.random.default_rng(n).integers(-3, 9, n).astype(float)
    rows = {r["frame"]: r["threshold"] for r in sequence.block_threshold(frames(spark, v), 10, 0.7).collect()}
    for i in range(n):
        block = v[i // 10 * 10 : i // 10 * 10 + 10] if i // 10 < n // 10 else v[max(0, n - 10) :]
        s = np.sort(block[block > 0])
        assert rows[i] == (s[int(0.7 * len(s))] if len(s) else None)


def test_detect_scores_empty_windows(spark):
    rng = np.random.default_rng(0)
    x = rng.random((12, 3)) < 0.3
    x[4:9] = False
    w = rng.integers(-4, 5, (4, 3)) / 2
    bits = spark.createDataFrame([(1, int(t), int(f)) for t, f in zip(*np.nonzero(x))], "utt long, frame long, f int")
    cells = spark.createDataFrame([(0, a, b, float(w[a, b])) for a in range(4) for b in range(3)], "comp int, dt long, f int, w double")
    spine = spark.createDataFrame([(1, t, 12) for t in range(12)], "utt long, frame long, n long")
    out = dict(got(templates.detect(bits, cells, spine, spark.createDataFrame([(0, 4, 0.5)], "comp int, len int, c double")), "frame", "score"))
    assert out == {t: 0.5 + float((x[t : t + 4] * w).sum()) for t in range(9)}


def test_best_filter_takes_the_lowest_on_ties(spark):
    s = spark.createDataFrame([(1, 0, c, v) for c, v in ((2, 1.0), (1, 1.0), (0, 0.5))], "utt long, frame long, comp int, score double")
    assert got(templates.best_filter(s), "comp") == [(1,)]


def test_roc_is_monotone_and_ends_at_one(spark):
    rng = np.random.default_rng(1)
    s = spark.createDataFrame([(float(rng.integers(0, 9)), bool(rng.random() < 0.5)) for _ in range(80)], "score double, positive boolean")
    c = evaluate.roc(s).orderBy(F.desc("score")).toPandas()
    assert (c["tpr"].diff().dropna() > 0).all() and (c["fpr"].diff().dropna() >= 0).all() and c["tpr"].iloc[-1] == 1


def test_greedy_suppression(spark):
    d = spark.createDataFrame([(1, 0, 3.0), (1, 2, 5.0), (1, 5, 4.0), (1, 6, 4.5)], "utt long, frame long, value double")
    assert got(models.suppress(d, 3), "frame") == [(2,), (6,)]


def test_bernoulli_mixture_climbs(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.random((60, 8)) < 0.9, rng.random((30, 8)) < 0.1]).astype(float)
    ex = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "ex long, x array<double>")
    w, t, ll = models.bernoulli_mixture(ex, 2, rounds=30, tol=0)
    assert all(b >= a - 1e-6 for a, b in zip(ll, ll[1:])) and abs(max(w) - 2 / 3) < 0.1


def test_gaussian_mixture_finds_two_means(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (50, 2)), rng.normal(6, 1, (50, 2))])[rng.permutation(100)]
    _, m, v = models.gaussian_mixture(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "ex long, x array<double>"), 2, rounds=40)
    assert np.allclose(np.sort(m[:, 0]), [0, 6], atol=0.8) and (v < 4).all()


def test_shift_mixture_climbs_and_finds_the_shape(spark):
    rng = np.random.default_rng(4)
    shape, x = np.array([4.0, -4, 4, -4]), rng.normal(0, 0.3, (80, 8))
    for r in x:
        at = rng.integers(0, 5)
        r[at : at + 4] += shape
    w, m, v, ll = models.shift_mixture(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "ex long, x array<double>"), 1, 4, rounds=12)
    assert all(b >= a - 1e-6 for a, b in zip(ll, ll[1:])) and w.tolist() == [1] and v.shape == m.shape == (1, 4)


def test_placed_mixture_climbs_and_finds_the_object(spark):
    rng = np.random.default_rng(5)
    x = (rng.random((120, 14, 6)) < 0.1).astype(float)
    for r in x:
        s, n = rng.integers(2, 5), rng.integers(5, 8)
        r[s : s + n] = rng.random((n, 6)) < 0.9
    ex = spark.createDataFrame([(i, r.ravel().tolist()) for i, r in enumerate(x)], "ex long, x array<double>")
    w, t, ll = models.placed_mixture(ex, 1, 7, 5, 3, np.full(6, 0.1), rounds=10)
    assert all(b >= a - 1e-6 for a, b in zip(ll, ll[1:])) and abs(w.sum() - 1) < 1e-9 and (t[0, 1:5] > 0.8).all()


def test_two_part_templates_against_a_loop(spark):
    rng = np.random.default_rng(6)
    p, back = rng.random((8, 2)), np.array([0.2, 0.3])
    t = spark.createDataFrame([(i, f, float(p[i, f])) for i in range(8) for f in range(2)], "dt int, feat int, p double")
    b = spark.createDataFrame([(f, float(back[f])) for f in range(2)], "feat int, p double")
    rows = {r[:3]: r[3] for r in templates.two_part_templates(t, b, 8, 5).collect()}
    assert len(rows) == 5 * 10 * 2
    for (c, i, f), v in rows.items():
        here = ([p[i, f]] if i < 5 else []) + ([p[3 + i - c, f]] if c <= i < c + 5 else [])
        assert abs(v - (np.mean(here) if here else back[f])) < 1e-12


def test_cutoff_keeps_ties_out(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 1.0), ("b", 1.0)], "k string, score double")
    assert got(evaluate.score_cutoffs(rows, "k", 2), "k", "cutoff") == [("a", 3.0)]


def test_slices_are_padded(spark):
    iv = spark.createDataFrame([(1, -1, 2), (1, 2, 2)], "utt long, start long, end long")
    assert got(sequence.slices(iv, frames(spark, [5, 6]), 9.0), "start", "dt", "value") == [(-1, 0, 9.0), (-1, 1, 5.0), (-1, 2, 6.0)]


def test_own_length_breaks(spark):
    d = spark.createDataFrame([(1, 0, 3), (1, 3, 9), (1, 11, 1)], "utt long, frame long, len long")
    assert got(sequence.cluster_own_length(d), "c_start", "c_end") == [(0, 1), (3, 12)]


def test_tapers_are_orthonormal():
    t = models.tapers(64, 3.0, 5)
    assert np.allclose(t @ t.T, np.eye(5), atol=1e-8)


def test_scales_invert(spark):
    d = spark.createDataFrame([(x,) for x in (10.0, 500.0, 3000.0)], "f double")
    for there, back in ((fn.hz_to_mel, fn.mel_to_hz), (fn.hz_to_mel_linear, fn.mel_linear_to_hz)):
        assert all(abs(a - b) < 1e-6 for a, b in d.select("f", back(there(F.col("f")))).collect())
    assert got(spark.createDataFrame([(1.0,), (0.99,), (0.0,)], "p double").select(fn.quantize(F.col("p"), 4).alias("q")), "q") == [(0.125,), (0.875,), (1.0,)]


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=6, freq="20min"), "user_id": [1, 1, 2, 2, 1, 2], "event_type": "a", "value": [1.0, 2, 3, 4, 5, 6]})
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, user_id long, event_type string, value double").parquet(f"{tmp_path}/in")
    q = running.running_background(stream).writeStream.outputMode("update").format("memory").queryName("bg").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert got(spark.table("bg"), "user_id", "n") == [(1, 3), (2, 3)]
    assert running.window_means(spark.read.parquet(f"{tmp_path}/in")).agg(F.sum("n")).first()[0] == 12


@pytest.mark.parametrize("values", [[], [None], [2.0], [None, 1.0, None], [5.0, 5.0, -3.0, None, 1e9, 0.5], [float("-inf"), 0.0, 1.0, float("inf")], [1.0, 2.0, float("nan")]], ids=str)
def test_running_totals_by_value(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "best double").groupBy("best").agg(F.count("*").alias("n"))
    key = lambda v: (v is not None, v is not None and v != v, v if v is not None and v == v else 0.0)
    got = sorted((key(r.best), r.n_run, r.n_all) for r in evaluate.running(rows, "best", "n").collect())
    assert got == sorted((key(v), sum(key(x) >= key(v) for x in values), len(values)) for v in {key(v): v for v in values}.values())


@pytest.mark.parametrize("percent", [0, 30, 50, 100])
def test_threshold_at_a_rank(spark, percent):
    for values in ([], [None], [4.0], [None, None, 3.0, 1.0], [2.0, 2.0, 2.0, 7.0, -1.0, None], [float(x % 13) for x in range(50)]):
        got = [r.threshold for r in evaluate.threshold_at(spark.createDataFrame([(v,) for v in values], "best double"), percent).collect()]
        ranked = sorted(values, key=lambda v: (v is not None, v or 0.0))
        at = max((len(values) - 1) * percent // 100, values.count(None))
        assert got == ([ranked[at]] if at < len(ranked) else [])


def test_intervals_of_any_length_meet_once(spark):
    """Against all pairs: points, intervals over many spans of time, empty ones, touching ends, two utterances."""
    rng = np.random.default_rng(7)
    span = intervals.SPAN
    at = lambda: int(rng.integers(0, 6 * span))
    d = [(int(rng.integers(2)), i, a, a + int(rng.choice([1, 5, span, 3 * span]))) for i, a in enumerate(at() for _ in range(60))]
    t = [(int(rng.integers(2)), a, a + int(rng.choice([0, 1, 4, span + 1, 2 * span]))) for a in sorted({at() for _ in range(60)})]
    t += [(u, e, e + 3) for u, _, _, e in d[:6]] + [(u, s - 3, s) for u, _, s, _ in d[6:12]]
    t = sorted(set(t))
    clusters = spark.createDataFrame(d, "utt long, cid long, c_start long, c_end long")
    truths = spark.createDataFrame(t, "utt long, t_start long, t_end long")
    for closed in (False, True):
        meets = lambda x, y: x[0] == y[0] and (y[2] >= x[2] and y[1] <= x[3] if closed else y[2] > x[2] and y[1] < x[3])  # noqa: E731, B023
        pairs = intervals.met(clusters, truths, F.col("t_start"), F.col("t_end"), closed).select("d.cid", "t.utt", "t.t_start", "t.t_end")
        assert got(pairs, "cid", "utt", "t_start", "t_end") == sorted((x[1], *y) for x in d for y in t if meets(x, y))
    over = lambda x, y: x[0] == y[0] and y[2] > x[2] and y[1] < x[3]
    assert got(intervals.truth_hits(clusters, truths), "cid", "hits") == sorted((x[1], sum(over(x, y) for y in t)) for x in d)
    assert got(intervals.false_alarms(clusters, truths), "cid") == sorted((x[1],) for x in d if not any(over(x, y) for y in t))
    assert got(intervals.missed(clusters, truths), "utt", "t_start", "t_end") == sorted(y for y in t if not any(over(x, y) for x in d))
    rates = intervals.rates(clusters, truths, 500, 0.01).first()
    assert abs(rates.fpr - sum(not any(over(x, y) for y in t) for x in d) / 5) < 1e-9
    assert abs(rates.tpr - sum(any(over(x, y) for x in d) for y in t) / len(t)) < 1e-9
    assert intervals.rates(clusters.limit(0), truths.limit(0), 1).first().tpr is None


def test_running_totals_with_values_far_off(spark):
    values = [float("-inf"), -1e300, *[x / 100 for x in range(500)], 1e9, 1e300, float("inf"), float("nan")]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, n long")
    out = {repr(r.v): (r.n_run, r.n_all) for r in evaluate.running(rows, "v", "n").collect()}
    total = sum(range(len(values)))
    assert out == {repr(v): (sum(range(i, len(values))), total) for i, v in enumerate(values)}


def test_slopes_over_a_window_by_regression(spark):
    from larkspan.operators import features

    rng = np.random.default_rng(3)
    arrays = {1: rng.normal(size=(30, 3)), 2: rng.normal(size=(2, 3))}
    rows = spark.createDataFrame([(u, t, x.tolist()) for u, a in arrays.items() for t, x in enumerate(a)], "utt long, frame long, S array<double>")
    for r in features.deltas(rows, 9, size=8).collect():
        a = arrays[r.utt]
        y = a[np.clip(np.arange(r.frame - 4, r.frame + 5), 0, len(a) - 1)]
        assert np.allclose(r.S, np.polyfit(np.arange(9), y, 1)[0])


@pytest.mark.parametrize("by_table", [False, True])
def test_scores_of_arrays_by_a_loop(spark, by_table):
    rng = np.random.default_rng(1)
    p, b, x = rng.uniform(0.05, 0.95, (2, 12)), rng.uniform(0.1, 0.4, 12), (rng.random((5, 12)) < 0.4).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ex long, x array<double>")
    log = (lambda q: np.log(int(100 * q + 0.5) / 100)) if by_table else np.log
    for r in templates.array_scores(rows, p, b, by_table).collect():
        want = [sum(log(q) - log(c) if v else log(1 - q) - log(1 - c) for v, q, c in zip(x[r.ex], one, b, strict=True)) for one in p]
        assert np.allclose(r.scores, want)
