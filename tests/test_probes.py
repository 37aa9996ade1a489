import numpy as np
import pytest
from pyspark.sql import functions as F

from heldout.operators import moments as Mo, probes as P, spatial as Sp


def _folds(df, seeds):
    return P.with_folds(df, "scene_index", seeds).cache()


def test_scatter_and_standardiser(probe_data):
    df, _, x, _, _ = probe_data
    g = Mo.gather(Mo.scatter(df, "x"))[()]
    assert np.allclose(g, x.T @ x, rtol=1e-10)
    by = Mo.gather(Mo.scatter(df.withColumn("k", F.col("frame_index") % 3), "x", ["k"]), ["k"])
    assert np.allclose(sum(by.values()), g, rtol=1e-10) and len(by) == 3
    mean, scale = Mo.standardiser(df, "x")
    assert np.allclose(mean, x.mean(0)) and np.allclose(scale, x.std(0))


def test_ridge_equals_direct_fits(probe_data):
    df, scene, x, y, _ = probe_data
    rows = _folds(df, [0, 1])
    fits = P.fit_ridge(rows, "x", ["y1", "y2"], [0, 1])
    member = {r.scene_index: r.folds for r in rows.select("scene_index", "folds").distinct().collect()}
    for s, fit in enumerate(fits):
        f = np.array([member[v][s] for v in scene])
        tr = f >= 0
        m, sd = x[tr].mean(0), x[tr].std(0)
        z = (x - m) / sd

        def solve(rows_, t, alpha):
            a = np.hstack([z[rows_], np.ones((rows_.sum(), 1))])
            pen = np.diag(np.append(np.full(x.shape[1], alpha), 0.0))
            return np.linalg.solve(a.T @ a + pen, a.T @ y[rows_, t])

        for t in range(2):
            cv = []
            for alpha in P.RIDGE_ALPHAS:
                scores = []
                for k in range(5):
                    w = solve(tr & (f != k), t, alpha)
                    v = f == k
                    e = y[v, t] - z[v] @ w[:-1] - w[-1]
                    scores.append(1 - (e ** 2).sum() / ((y[v, t] - y[v, t].mean()) ** 2).sum())
                cv.append(np.mean(scores))
            assert np.allclose(fit.cv_scores[:, t], cv, atol=1e-8)
            assert fit.penalty[t] == P.RIDGE_ALPHAS[int(np.argmax(cv))]
            w = solve(tr, t, fit.penalty[t])
            raw, b = fit.folded()
            assert np.allclose(x @ raw[:, t] + b[t], z @ w[:-1] + w[-1], atol=1e-7)
    got = rows.select("y1", P.linear_scores(F.col("x"), fits).alias("p")).limit(5).collect()
    assert all(len(r.p) == 4 for r in got)


def test_noise_target_takes_the_largest_penalty_and_constant_columns_stay_finite(spark):
    rng = np.random.default_rng(11)
    n = 1500
    x = rng.normal(size=(n, 8))
    x[:, 0] = 3.0
    noise = rng.normal(size=n)
    df = spark.createDataFrame([(i // 10, [float(v) for v in x[i]], float(x[i, 1]), float(noise[i])) for i in range(n)],
                               "scene_index long, x array<double>, signal double, noise double")
    rows = _folds(df, [0])
    fit = P.fit_ridge(rows, "x", ["signal", "noise"], [0])[0]
    assert fit.penalty[0] < 10 and fit.penalty[1] >= 1e3
    p = np.array([r.p for r in rows.select(P.linear_scores(F.col("x"), [fit]).alias("p")).collect()])
    assert np.isfinite(p).all()


def test_vector_targets(probe_data):
    df = probe_data[0]
    rows = _folds(df.withColumn("t", F.array("y1", "y2")), [0])
    a, b = P.fit_ridge(rows, "x", "t", [0])[0], P.fit_ridge(rows, "x", ["y1", "y2"], [0])[0]
    assert np.allclose(a.coef, b.coef) and (a.penalty == b.penalty).all()


def test_logistic_solves_the_penalised_problem(probe_data):
    df, scene, x, _, c = probe_data
    rows = _folds(df, [0, 1])
    fits = P.fit_logistic(rows, "x", "c", [0, 1])
    member = {r.scene_index: r.folds for r in rows.select("scene_index", "folds").distinct().collect()}
    for s, fit in enumerate(fits):
        f = np.array([member[v][s] for v in scene])
        tr = f >= 0
        z = (x - x[tr].mean(0)) / x[tr].std(0)

        def newton(rows_, cc):
            a, t = np.hstack([z[rows_], np.ones((rows_.sum(), 1))]), c[rows_]
            w = np.zeros(a.shape[1])
            pen = np.append(np.full(x.shape[1], 1 / cc), 0.0)
            for _ in range(60):
                p = 1 / (1 + np.exp(-a @ w))
                w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pen), a.T @ (p - t) + pen * w)
            return w

        scores = []
        for cc in P.LOGISTIC_CS:
            per = []
            for k in range(5):
                w = newton(tr & (f != k), cc)
                v = f == k
                hit = (z[v] @ w[:-1] + w[-1] > 0).astype(int)
                per.append(np.mean([(hit[c[v] == q] == q).mean() for q in (0, 1)]))
            scores.append(np.mean(per))
        assert np.allclose(fit.cv_scores[:, 0], scores, atol=0.01)
        w = newton(tr, fit.penalty[0])
        assert np.allclose(fit.coef[:, 0], w[:-1], atol=2e-2, rtol=2e-2) and abs(fit.intercept[0] - w[-1]) < 3e-2
        assert 0 < fit.iterations < 20
        raw, b = fit.folded()
        held = f == -1
        hit = (x[held] @ raw[:, 0] + b[0] > 0).astype(int)
        assert np.mean([(hit[c[held] == q] == q).mean() for q in (0, 1)]) > 0.7


def test_one_class_is_skipped_and_the_cap_refuses(probe_data):
    rows = _folds(probe_data[0].withColumn("one", F.lit(1)), [0])
    assert P.fit_logistic(rows, "x", "one", [0]) == [None]
    with pytest.raises(RuntimeError, match="did not converge"):
        P.fit_logistic(rows, "x", "c", [0], max_iter=1)


def test_ragged_vectors_are_refused(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "x array<double>").repartition(1)
    with pytest.raises(Exception, match="one length"):
        Mo.scatter(df, "x").collect()


def test_patch_probe_finds_a_planted_patch(spark):
    rng = np.random.default_rng(0)
    rows = []
    for f in range(300):
        y = int(rng.random() < 0.5)
        at = rng.integers(6)
        for p in range(6):
            v = rng.normal(size=4)
            if y and p == at:
                v[2] += 6
            rows.append((f // 10, f % 10, p, [float(a) for a in v], y))
    df = spark.createDataFrame(rows, "scene long, frame int, patch int, x array<double>, y int").repartition(4).cache()
    train, test = df.where("scene < 22"), df.where("scene >= 22")
    fit = Sp.fit_max_pooled(train, "x", "y", ["scene", "frame"])
    assert np.argmax(np.abs(fit.coef[:, 0])) == 2
    s = Sp.pooled_scores(test, "x", ["scene", "frame"], fit).join(test.select("scene", "frame", "y").distinct(), ["scene", "frame"]).toPandas()
    pos, neg = s.y_score[s.y == 1].values, s.y_score[s.y == 0].values
    assert (pos[:, None] > neg).mean() > 0.9
    every = df.select("scene", "frame", P.linear_scores(F.col("x"), [fit])[0].alias("v")).toPandas().groupby(["scene", "frame"]).v.max()
    assert np.allclose(sorted(s.y_score), sorted(every[every.index.get_level_values(0) >= 22]))


def test_patch_probe_reaches_the_optimum_on_weak_signal(spark):
    """Against plain descent in NumPy on the same objective, and it refuses to stop early."""
    rng = np.random.default_rng(7)
    n, p, d = 240, 4, 6
    x = rng.normal(size=(n, p, d))
    y = (x[:, :, 1].max(1) + 0.5 * rng.normal(size=n) * 3 > 1.0).astype(int)
    df = spark.createDataFrame([(i // 8, i % 8, j, [float(v) for v in x[i, j]], int(y[i])) for i in range(n) for j in range(p)], "scene long, frame int, patch int, x array<double>, y int")
    fit = Sp.fit_max_pooled(df, "x", "y", ["scene", "frame"])
    flat = x.reshape(-1, d)
    z = (x - flat.mean(0)) / flat.std(0, ddof=1)

    def loss(w):
        s = (z @ w[:-1] + w[-1]).max(1)
        return (np.logaddexp(0, s) - y * s).mean() + 0.5e-3 * (w[:-1] ** 2).sum()

    w = np.append((flat[np.repeat(y, p) == 1].mean(0) - flat[np.repeat(y, p) == 0].mean(0)) / flat.std(0, ddof=1), 0.0)
    for t in range(6000):
        s = z @ w[:-1] + w[-1]
        win = s.argmax(1)
        a = np.hstack([z[np.arange(n), win], np.ones((n, 1))])
        g = a.T @ (1 / (1 + np.exp(-s.max(1))) - y) / n + np.append(1e-3 * w[:-1], 0)
        w = w - 0.5 / (1 + t / 500) * g
    ours = np.append(fit.coef[:, 0], fit.intercept)
    assert loss(ours) <= loss(w) + 1e-4
    auc = lambda v: ((lambda s: (s[y == 1][:, None] > s[y == 0]).mean())((z @ v[:-1] + v[-1]).max(1)))
    assert abs(auc(ours) - auc(w)) < 0.01
    with pytest.raises(RuntimeError):
        Sp.fit_max_pooled(df, "x", "y", ["scene", "frame"], max_scans=2)


def test_penalties_tied_to_twelve_places_give_the_least():
    """With many rows small penalties score alike but for the noise of the sums, which must not choose."""
    chosen_by_noise = 0
    for seed in range(20):
        rng = np.random.default_rng(seed)
        folds = {}
        for f in range(5):
            c = 1 + 1e-4 * rng.normal()
            folds[f] = 1e7 * np.array([[1.0, 0.1, 0.2], [0.1, 2.0, c], [0.2, c, 1.0 + 1e-4 * rng.normal()]])
        fit = P.ridge_from_moments(folds, 1, np.zeros(3), np.ones(3), [1e-6, 1e-5, 1e-4, 1e-3])
        if len(set(np.round(fit.cv_scores[:, 0], 12))) == 1:
            assert fit.penalty[0] == 1e-6
            chosen_by_noise += np.argmax(fit.cv_scores[:, 0]) != 0
    assert chosen_by_noise > 0


def test_patch_probe_passes_kinks_in_many_dimensions(spark):
    """With about as many weights as frames the best patches change along every step; two models share the scans."""
    rng = np.random.default_rng(11)
    n, p, d = 200, 5, 40
    x, y = rng.normal(size=(n, p, d)), rng.integers(0, 2, n)
    df = spark.createDataFrame([(i // 4, i % 4, [float(v) for v in x[i, j]], int(y[i])) for i in range(n) for j in range(p)], "scene long, frame int, x array<double>, y int").cache()
    fit = Sp.fit_max_pooled(df, "x", "y", ["scene", "frame"])
    flat = x.reshape(-1, d)
    z = (x - flat.mean(0)) / flat.std(0, ddof=1)

    def at(w):
        s = z @ w[:-1] + w[-1]
        a = np.hstack([z[np.arange(n), s.argmax(1)], np.ones((n, 1))])
        s = s.max(1)
        return (np.logaddexp(0, s) - y * s).mean() + 0.5e-3 * (w[:-1] ** 2).sum(), a.T @ (1 / (1 + np.exp(-s)) - y) / n + np.append(1e-3 * w[:-1], 0)

    w = np.append((flat[np.repeat(y, p) == 1].mean(0) - flat[np.repeat(y, p) == 0].mean(0)) / flat.std(0, ddof=1), 0.0)
    least = np.inf
    for t in range(6000):
        value, g = at(w)
        least, w = min(least, value), w - 0.5 / (1 + t / 500) * g
    ours = np.append(fit.coef[:, 0], fit.intercept)
    assert at(ours)[0] <= least + 2e-3
    both = Sp.fit_max_pooled_all(df.withColumn("u", F.array(F.lit(True), F.col("scene") < 30)), "x", "y", ["scene", "frame"], "u", 2)
    assert np.allclose(both[0].coef, fit.coef, atol=1e-6)
    assert np.allclose(both[1].coef, Sp.fit_max_pooled(df.where("scene < 30"), "x", "y", ["scene", "frame"]).coef, atol=1e-4)


def test_partial_matrices_travel_as_halves_in_few_rows(monkeypatch):
    """A model's sums are one row for usual widths, pieces for large ones, and come back whole in any order."""
    import pyarrow as pa
    from heldout.operators import grid
    rng = np.random.default_rng(0)
    for n, piece, rows in ((66, 1 << 16, 1), (66, 100, 23), (1, 100, 1)):
        monkeypatch.setattr(grid, "PIECE", piece)
        m = rng.normal(size=(n, n))
        m = m @ m.T
        sums = grid._Sums(["cell"])
        sums.add((3,), grid._packed(m))
        sums.add((3,), grid._packed(m))
        table = pa.Table.from_batches(list(sums.told()))
        assert table.num_rows == rows and sum(map(len, table.column("row").to_pylist())) == n * (n + 1) // 2
        assert np.array_equal(grid._whole(grid._vector(table.take(pa.array(rng.permutation(rows))))), m + m)


def test_steps_of_singular_matrices_are_the_shortest():
    from heldout.operators.probes import _solved
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(50, 8)), rng.normal(size=8)
    assert np.allclose(_solved(x.T @ x, g), np.linalg.lstsq(x.T @ x, g, rcond=None)[0], rtol=1e-9)
    x[:, 3] = x[:, 2]
    assert np.allclose(_solved(x.T @ x, x.T @ x[:, 0]), np.linalg.pinv(x.T @ x) @ (x.T @ x[:, 0]), atol=1e-9)
