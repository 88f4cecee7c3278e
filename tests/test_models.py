"""Recursion, cascades, starts, padding, inverted classifiers, the cache and stored models against plain forms."""

import random

import numpy as np
import pytest

from larkspan.functions import tables as tf
from larkspan.operators import evaluate, inversion, models, padding, splitting, starts, templates
from larkspan.sources import cache, stored


def plain_split(times, gap, most):
    """Clusters one cut at a time, by the place of the first largest gap."""
    parts, at = [], [0]
    for i in range(1, len(times)):
        if times[i] - times[i - 1] >= gap[i - 1]:
            at.append(i)
    todo = [list(range(a, b)) for a, b in zip(at, [*at[1:], len(times)], strict=True)]
    while todo:
        c = todo.pop(0)
        if len(c) > 1 and times[c[-1]] - times[c[0]] > most[c[0]]:
            gaps = [times[b] - times[a] for a, b in zip(c, c[1:], strict=False)]
            k = gaps.index(max(gaps)) + 1
            todo += [c[:k], c[k:]]
        else:
            parts.append((times[c[0]], times[c[-1]] + 1, len(c)))
    return sorted(parts)


def test_splitting_by_one_cut_at_a_time(spark):
    rng, rows, want = random.Random(3), [], []
    for utt in range(40):
        times = sorted(rng.sample(range(90), rng.randrange(1, 45)))
        gap, most = [rng.choice([3, 4, 6]) for _ in times], [float(rng.choice([2, 4.5, 9])) for _ in times]
        rows += [(utt, t, g, m) for t, g, m in zip(times, gap, most, strict=True)]
        want += [(utt, *c) for c in plain_split(times, gap, most)]
    rows += [(99, t, 2, 7.0) for t in range(400)]  # equal gaps: one level
    want += [(99, *c) for c in plain_split(list(range(400)), [2] * 400, [7.0] * 400)]
    frame = spark.createDataFrame(rows, "utt long, frame long, gap int, most double")
    assert sorted(tuple(r) for r in splitting.split_clusters(frame, 20).collect()) == sorted(want)
    assert splitting.split_clusters(frame.limit(0)).collect() == []


def test_suppression_by_comparing_with_all(spark):
    rng = random.Random(8)
    rows = [(u, t, float(rng.randrange(12))) for u in range(5) for t in rng.sample(range(200), 80)]
    got = sorted(tuple(r) for r in models.suppress(spark.createDataFrame(rows, "utt long, frame long, value double"), 6).collect())
    want = []
    for u in range(5):
        taken = []
        for r in sorted((r for r in rows if r[0] == u), key=lambda r: (-r[2], r[1])):
            if all(abs(r[1] - t[1]) >= 6 for t in taken):
                taken.append(r)
        want += taken
    assert got == sorted(want)


def test_cascade_curve_without_positives_or_rows(spark):
    rows = spark.createDataFrame([(1.0, 5.0, False), (3.0, 1.0, False)], "coarse double, score double, positive boolean")
    got = {(r.coarse, r.threshold): (r.tpr, r.fps) for r in evaluate.cascade_roc(rows, (2.0, 0.0), (4.0, 0.0), 2.0).collect()}
    assert got == {(0.0, 0.0): (None, 1.0), (0.0, 4.0): (None, 0.5), (2.0, 0.0): (None, 0.5), (2.0, 4.0): (None, 0.0)}
    assert {(r.tpr, r.fps) for r in evaluate.cascade_roc(rows.limit(0), (0.0,), (0.0,), 1.0, missed=2).collect()} == {(0.0, 0.0)}


def test_starts_by_a_plain_loop(spark):
    """The same draws, distances of whitened rows, and the same thinning out."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, (60, 3)) * [1, 10, 0] + [0, 0, 7] for m in (-4, 0, 5)])  # a constant feature
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ex long, x array<double>").repartition(3)
    k, seed, rounds, each = 3, 4, 3, 2.0
    got = starts.centres(frame, k, seed, rounds, each)
    draws = {(r.ex, t): r[f"d{t}"] for r in frame.select("ex", *[starts.draw(seed, t).alias(f"d{t}") for t in range(rounds + 1)]).collect() for t in range(rounds + 1)}
    scale = np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
    z = (x - x.mean(axis=0)) / scale
    found = [z[min(range(len(x)), key=lambda i: draws[i, 0])]]
    for t in range(1, rounds + 1):
        d = np.array([min(((p - c) ** 2).sum() for c in found) for p in z])
        found = found + [z[i] for i in range(len(x)) if draws[i, t] * d.sum() < each * k * d[i]]
    near = np.array([int(np.argmin([((p - c) ** 2).sum() for c in found])) for p in z])
    want = starts.spread_centres(np.array(found), np.bincount(near, minlength=len(found)).astype(float), k, np.random.default_rng(seed))
    np.testing.assert_allclose(got, want * scale + x.mean(axis=0), atol=1e-9)
    assert sorted(np.round(got[:, 0] / 5)) == [-1, 0, 1]  # one in each heap
    w, m, _ = models.gaussian_mixture(frame, 3, start=(got, x.var(axis=0)))
    np.testing.assert_allclose(sorted(w), [1 / 3] * 3, atol=1e-3)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "ex long, x array<double>")
    assert starts.centres(same, 3, 1).tolist() == [[1.0, 2.0]]


def test_padding_is_a_function_of_seed_and_cell(spark):
    sizes = spark.createDataFrame([(i, i % 5) for i in range(400)], "ex long, len long")
    bits = spark.createDataFrame([(4, 0, 1)], "ex long, dt long, feat int")
    pad = lambda seed, n=4: sorted(tuple(r) for r in padding.pad_bits(bits, sizes.repartition(n), (0.0, 0.25, 1.0), 4, seed).collect())
    got = pad(1)
    assert got == pad(1, 1) and got != pad(2) and (4, 0, 1) in got
    cells = sum(4 - i % 5 for i in range(400) if i % 5 < 4)
    count = lambda f: sum(r[2] == f for r in got if r[:2] != (4, 0))
    assert count(0) == 0 and count(2) == cells and abs(count(1) / cells - 0.25) < 0.05
    assert all(r[1] >= r[0] % 5 for r in got if r[0] != 4)
    values = padding.pad_values(spark.createDataFrame([], "ex long, dt long, feat int, x double"), sizes, (3.0, 1.0), (0.0, 2.0), 4, 1).toPandas()
    assert set(values[values.feat == 0]["x"]) == {3.0}
    x = values[values.feat == 1]["x"]
    assert abs(x.mean() - 1) < 0.3 and abs(x.std() - 2) < 0.3


def test_inversion_by_the_fixed_point(spark):
    """The scale is where the ratio's constant is the scale times the SVM's; iterating towards it ends there too."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for key in range(12):
        p, w = rng.uniform(0.1, 0.9, 20), rng.normal(size=20)
        true = 0.5 + key / 8
        constant = lambda s, p=p, w=w: float(np.log((1 - p) / (1 - np.clip(1 / (1 + (1 / p - 1) * np.exp(s * w)), 1e-4, 1 - 1e-4))).sum())
        b = constant(true) / true
        rows += [(key, f, float(p[f]), float(w[f]), b) for f in range(20)]
        want[key] = (constant, b, p)
    got = inversion.inverted(spark.createDataFrame(rows, "key int, feat int, p double, w double, b double"), "key").toPandas()
    assert len(got)
    ended = met = 0
    for key, own in got.groupby("key"):
        constant, b, p = want[key]
        s = own["scale"].iloc[0]
        assert abs(constant(s) - s * b) < 1e-6
        own = own.sort_values("feat")
        np.testing.assert_allclose(own["c"], s * b)
        np.testing.assert_allclose(np.log((1 - p) / (1 - own["q"])).sum(), s * b, atol=1e-6)
        np.testing.assert_allclose(own["w"], np.log(p / (1 - p) * (1 - own["q"]) / own["q"]), atol=1e-9)
        again, steps = 1.0, []  # the iteration, which may end at another such scale, at 0 or nowhere
        for _ in range(3000):
            again = constant(again) / b
            steps.append(again)
        if np.isfinite(again) and again > 0.01 and abs(steps[-1] - steps[-2]) < 1e-9:
            ended += 1
            assert abs(constant(again) - again * b) < 1e-6
            met += abs(again - s) < 1e-6
    assert ended and met
    none = spark.createDataFrame([(1, 0, 0.5, 0.0, 1.0)], "key int, feat int, p double, w double, b double")
    assert inversion.inverted(none, "key").collect() == []


def test_family_of_classifiers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    rows = spark.createDataFrame([(v.tolist(), int(v[0] > 0.2)) for v in x], "x array<double>, y int")
    got = inversion.svm_family(rows, (1.0, 10.0)).toPandas()
    assert sorted(set(got["c"])) == [1.0, 10.0] and len(got) == 4
    for _, own in got.groupby("c"):
        own = own.sort_values("feat")
        side = x @ own["w"].to_numpy() + own["b"].iloc[0] > 0
        assert (side == (x[:, 0] > 0.2)).mean() > 0.8


def test_false_positive_filters_need_both_kinds(spark):
    bits = spark.createDataFrame([(k, 0, float(k % 2)) for k in range(6)], "vec_id long, feat int, x double")
    judged = spark.createDataFrame([(0, 1, True), (1, 1, False), (2, 2, True), (3, 2, True)], "vec_id long, pred int, positive boolean")
    got = inversion.against_false_positives(bits, judged, "vec_id").collect()
    assert [(r.pred, r.n_pos, r.n_neg) for r in got] == [(1, 1, 1)] and got[0].w < -9


def test_table_functions(spark):
    tf.register(spark)
    spark.createDataFrame([(u, t, float(t) if t else None) for u in (1, 2) for t in range(u * 3)], "utt long, frame long, value double").createOrReplaceTempView("tf_rows")
    got = spark.sql("SELECT * FROM windows_of(TABLE(tf_rows) PARTITION BY (utt) ORDER BY (frame), 3, 2)").collect()
    assert sorted((r.utt, r.win, r.s) for r in got) == [(1, 0, [0, 1, 2]), (2, 0, [0, 1, 2]), (2, 1, [2, 3, 4])]
    got = spark.sql("SELECT p.* FROM VALUES (array(1D, 2D, 3D, 4D, 5D)), (array(1D)), (NULL) v(x), LATERAL patches_of(v.x, 2, 2) p").collect()
    assert sorted((r.start, r.s) for r in got) == [(0, [1, 2]), (2, [3, 4])]


def test_cache_reads_through_and_refreshes_by_utterance(spark, tmp_path):
    path, root, built = str(tmp_path / "in"), str(tmp_path / "cache"), spark.sparkContext.accumulator(0)

    def build(rows):
        def count(batches):
            for b in batches:
                built.add(len(b))
                yield b.assign(value=b["value"] * 2)

        return rows.mapInPandas(count, "utt long, frame long, value double")

    def read(settings=None):
        return cache.read_through(spark.read.parquet(path), root, settings or {"scale": 2}, build, buckets=4)

    rows = lambda df: sorted((r.utt, r.frame, r.value) for r in df.collect())
    made = lambda values: spark.createDataFrame([(u, t, float(v)) for u, vs in values.items() for t, v in enumerate(vs)], "utt long, frame long, value double")
    made({1: [1, 2], 2: [3], 3: [4]}).write.parquet(path)
    assert rows(read()) == [(1, 0, 2), (1, 1, 4), (2, 0, 6), (3, 0, 8)] and built.value == 4
    again = read()
    assert rows(again) == [(1, 0, 2), (1, 1, 4), (2, 0, 6), (3, 0, 8)] and built.value == 4
    assert again._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert all("/features/gen=0/" in f for f in again.inputFiles())
    made({1: [1, 2], 2: [5], 4: [6]}).write.mode("overwrite").parquet(path)  # one changed, one gone, one new
    assert rows(read()) == [(1, 0, 2), (1, 1, 4), (2, 0, 10), (4, 0, 12)] and built.value == 6
    assert rows(read()) == [(1, 0, 2), (1, 1, 4), (2, 0, 10), (4, 0, 12)] and built.value == 6
    assert rows(read({"scale": 3})) == rows(read()) and built.value == 10
    assert cache.fingerprint({"a": 1, "b": 2}) == cache.fingerprint({"b": 2, "a": 1}) != cache.fingerprint({"a": 2, "b": 1})


def test_stored_models_detect_as_before(spark, tmp_path):
    rng = np.random.default_rng(2)
    p, background = rng.uniform(0.1, 0.9, (2, 3, 4)), rng.uniform(0.2, 0.4, 4)
    stored.save_model(spark, str(tmp_path / "m"), "bernoulli", {"templates": p, "background": background, "weights": np.array([0.25, 0.75])}, seed=3)
    arrays, metadata = stored.load_model(spark, str(tmp_path / "m"), "bernoulli")
    assert metadata["seed"] == 3 and set(arrays) == {"templates", "background", "weights"}
    np.testing.assert_array_equal(arrays["templates"], p)
    with pytest.raises(ValueError, match="bernoulli"):
        stored.load_model(spark, str(tmp_path / "m"), "normal")
    x = rng.random((9, 4)) < 0.4
    bits = spark.createDataFrame([(1, t, f) for t, f in zip(*map(np.ndarray.tolist, np.nonzero(x)), strict=True)], "utt long, frame long, f int")
    spine = spark.createDataFrame([(1, t, 9) for t in range(9)], "utt long, frame long, n long")
    back = spark.createDataFrame([(f, float(b)) for f, b in enumerate(arrays["background"])], "feat int, p double")
    bank, bias = stored.filters_of(stored.templates_table(spark, arrays["templates"]), back)
    got = {(r.frame, r.comp): r.score for r in templates.detect(bits, bank, spine, bias).collect()}
    assert len(got) == 14
    for (t, k), score in got.items():
        w = x[t : t + 3]
        want = np.where(w, np.log(p[k] / background), np.log((1 - p[k]) / (1 - background))).sum()
        assert abs(score - want) < 1e-9


def rows_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "ex long, x array<double>").repartition(3)


@pytest.mark.parametrize("hard", [False, True])
def test_bernoulli_mixture_by_a_plain_loop(spark, hard):
    rng = np.random.default_rng(3)
    true = rng.uniform(0.1, 0.9, (2, 9))
    x = (rng.random((150, 9)) < true[rng.integers(0, 2, 150)]).astype(float)
    w, t, seen = models.bernoulli_mixture(rows_of(spark, x), 2, rounds=6, tol=0, hard=hard)
    a = np.eye(2)[np.arange(150) % 2]
    want = []
    for turn in range(6):
        if turn:
            like = np.array([[np.log(weights[k]) + sum(np.log(p if v else 1 - p) for v, p in zip(row, templates[k], strict=True)) for k in range(2)] for row in x])
            norm = like.max(axis=1) if hard else np.log(np.exp(like).sum(axis=1))
            want.append(norm.sum())
            a = np.eye(2)[like.argmax(axis=1)] if hard else np.exp(like - norm[:, None])
        n = a.sum(axis=0)
        weights, templates = n / n.sum(), np.clip((a.T @ x) / n[:, None], 0.01, 0.99)
    np.testing.assert_allclose(w, weights)
    np.testing.assert_allclose(t, templates)
    np.testing.assert_allclose(seen, want)
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:], strict=False))


def test_mixture_of_the_worked_example(spark):
    """Three rows, two components: two thirds and a third."""
    w, t, _ = models.bernoulli_mixture(rows_of(spark, [[1, 1, 0], [0, 0, 1], [1, 1, 1]]), 2, rounds=20)
    assert sorted(np.round(w, 2)) == [0.33, 0.67]
    np.testing.assert_allclose(t[np.argmax(w)], [0.99, 0.99, 0.5], atol=0.05)


def test_normal_mixture_by_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(-2, 1, (60, 3)), rng.normal(2, 0.5, (40, 3))])
    w, m, v = models.gaussian_mixture(rows_of(spark, x), 2, rounds=5)
    a = np.eye(2)[np.arange(100) % 2]
    for turn in range(5):
        if turn:
            like = np.log(weights) + np.array([[-0.5 * (np.log(var[k]) + (row - mean[k]) ** 2 / var[k]).sum() for k in range(2)] for row in x])
            a = np.exp(like - like.max(axis=1, keepdims=True))
            a /= a.sum(axis=1, keepdims=True)
        n = a.sum(axis=0)
        weights, mean = n / n.sum(), (a.T @ x) / n[:, None]
        var = np.array([(a[:, k, None] * (x - mean[k]) ** 2).sum(axis=0) / n[k] for k in range(2)])
    np.testing.assert_allclose(w, weights, atol=1e-7)
    np.testing.assert_allclose(m, mean, atol=1e-7)
    np.testing.assert_allclose(v, var, atol=1e-6)


def test_shifted_mixture_by_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    shape = np.array([[0, 3, 0, -3.0], [2, 2, -2, -2.0]])
    x = rng.normal(0, 0.3, (50, 6))
    for i in range(50):
        at = rng.integers(3)
        x[i, at : at + 4] += shape[i % 2]
    w, m, v, seen = models.shift_mixture(rows_of(spark, x), 2, 4, rounds=4)
    places = [(k, s) for k in range(2) for s in range(3)]
    a = np.array([[1.0 if (k, s) == (i % 2, 0) else 0.0 for k, s in places] for i in range(50)])
    want = []
    for turn in range(4):
        if turn:
            like = np.array([[np.log(weights[k] / 3) - 0.5 * (np.log(2 * np.pi * var[k]) + (row[s : s + 4] - mean[k]) ** 2 / var[k]).sum() for k, s in places] for row in x])
            norm = np.log(np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)) + like.max(axis=1)
            want.append(norm.sum())
            a = np.exp(like - norm[:, None])
        n = np.array([sum(a[:, j].sum() for j, (c, _) in enumerate(places) if c == k) for k in range(2)])
        weights = n / n.sum()
        mean = np.array([sum((a[:, j, None] * x[:, s : s + 4]).sum(axis=0) for j, (c, s) in enumerate(places) if c == k) / n[k] for k in range(2)])
        var = np.array([sum((a[:, j, None] * x[:, s : s + 4] ** 2).sum(axis=0) for j, (c, s) in enumerate(places) if c == k) / n[k] for k in range(2)]) - mean**2
        var = np.maximum(var, 1e-3)
    np.testing.assert_allclose(w, weights, atol=1e-6)
    np.testing.assert_allclose(m, mean, atol=1e-6)
    np.testing.assert_allclose(v, var, atol=1e-6)
    np.testing.assert_allclose(seen, want, rtol=1e-8)


def test_length_clusters_by_all_partitions(spark):
    """Centres of sorted lengths are means of runs; of two well apart heaps no other cut is better."""
    lengths = [3] * 5 + [4] * 9 + [5] + [20] * 4 + [22] * 2
    got = models.length_clusters(spark.createDataFrame([(x,) for x in lengths], "len long"), 2)
    best = min(range(1, len(lengths)), key=lambda k: np.var(lengths[:k]) * k + np.var(lengths[k:]) * (len(lengths) - k))
    np.testing.assert_allclose(got, [np.mean(lengths[:best]), np.mean(lengths[best:])])


def test_linear_svm_margins_by_subgradients(spark):
    """The margins' signs, and a hinge loss with its penalty no worse than a long plain descent's."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.3, 120) > 0).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "x array<double>, y int")
    got = models.linear_svm(rows).toPandas()
    points = np.stack(got["x"].to_numpy())
    sign = 2 * got["y"].to_numpy() - 1
    design = np.column_stack([points, np.ones(len(points))])
    fitted = np.linalg.lstsq(design, got["margin"].to_numpy(), rcond=None)[0]
    np.testing.assert_allclose(design @ fitted, got["margin"], atol=1e-8)  # margins are linear in x
    scale = points.std(axis=0, ddof=1)
    loss = lambda w: np.maximum(0, 1 - sign * (design @ w)).mean() + 0.005 * ((w[:-1] * scale) ** 2).sum()
    w = np.zeros(4)
    for step in range(1, 4001):
        bad = sign * (design @ w) < 1
        grad = -(design * sign[:, None])[bad].sum(axis=0) / len(points)
        grad[:-1] += 0.01 * w[:-1] * scale**2
        w -= grad / np.sqrt(step)
    assert loss(fitted) <= loss(w) + 0.02
    assert ((got["margin"] > 0) == (got["y"] == 1)).mean() > 0.9
