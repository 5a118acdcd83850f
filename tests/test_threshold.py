"""Threshold sweep, AUC, ROC and histogram: fixtures and properties."""

import numpy as np

from hearth.operators import threshold as T
from hearth.operators.prefix import running_sum


def test_sweep_fixture(spark):
    df = spark.createDataFrame([(50.0, 4), (100.0, 4), (120.0, 2), (150.0, 2), (200.0, 2),
                                (None, 4), (None, 2)], "rav double, o int")
    r = T.fit_threshold(df, score="rav", label="o").first()
    assert r.threshold == 120.0 and r.n_err == 1 and r.n == 7


def _brute_error(s, y, t):
    pred = np.where(~np.isnan(s) & (s >= t), 2, 4)
    return int((pred != y).sum())


def test_sweep_is_global_optimum_per_group(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(4):
        s = np.round(rng.normal(g, 1.0, 300), 1)
        y = np.where(rng.random(300) < 1 / (1 + np.exp(-(s - g))), 2, 4)
        rows += [(g, float(a), int(b)) for a, b in zip(s, y)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    fit = {r.g: r for r in T.fit_threshold(df, score="s", label="y", group_by=["g"]).collect()}
    arr = np.array([(g, s, y) for g, s, y in rows])
    for g in range(4):
        sub = arr[arr[:, 0] == g]
        s, y = sub[:, 1], sub[:, 2].astype(int)
        best = min(_brute_error(s, y, t) for t in list(np.unique(s)) + [np.inf])
        assert fit[g].n_err == best
        t = fit[g].threshold
        assert _brute_error(s, y, np.inf if t is None else t) == best


def test_band_rule(spark):
    df = spark.createDataFrame([(1 / 23,), (1 / 20,), (1 / 17,), (1 / 16,)], "imc double")
    r = [x.p for x in df.select(T.band_rule(T.threshold_predict("imc", 10.0), "imc").alias("p")).collect()]
    assert r == [3, 3, 3, 4]


def test_auc_fixture_and_symmetry(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, y int")
    assert T.roc_auc(df, score="s", label="y").first().auc == 0.875
    neg = df.selectExpr("-s AS s", "y")
    assert abs(T.roc_auc(neg, score="s", label="y").first().auc - 0.125) < 1e-12


def test_roc_curve_points(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, y int")
    pts = sorted((r.fpr, r.tpr) for r in T.roc_curve(df, score="s", label="y").collect())
    assert pts == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-1000.0,), (1999.0,), (2000.0,), (2001.0,), (-1001.0,)], "v double")
    r = sorted((x.bin, x.n) for x in T.histogram(df, "v").collect())
    assert r == [(1, 1), (30, 2)]


def test_running_sum_matches_cumsum(spark):
    rng = np.random.default_rng(0)
    g = rng.integers(0, 3, 2000)
    g[:1200] = 0  # one hot group holding most rows
    x = rng.integers(0, 10, 2000)
    rows = [(int(a), i, int(b)) for i, (a, b) in enumerate(zip(g, x))]
    df = spark.createDataFrame(rows, "g int, o long, x long")
    out = running_sum(df, order_by=["o"], sums=["x"], partition_by=["g"], num_partitions=7)
    got = {r.o: r.cum_x for r in out.collect()}
    for grp in range(3):
        idx = [i for i in range(2000) if g[i] == grp]
        cs = np.cumsum([x[i] for i in idx])
        assert all(got[i] == c for i, c in zip(idx, cs))


def test_roc_single_class_gives_null_rates(spark):
    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "s double, y int")
    r = T.roc_curve(df, score="s", label="y").collect()
    assert all(x.fpr is None for x in r) and max(x.tpr for x in r) == 1.0
    assert T.roc_auc(df, score="s", label="y").first().auc is None


def test_thresholds_of_the_other_folds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if rng.random() < 0.1 else float(rng.integers(0, 12)), int(rng.choice([2, 4, 3])), ["a", "b", None][i % 3],
             int(rng.integers(0, 4))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s double, y int, g string, fold int")
    for by in (["g"], []):
        fits = {(r.g if by else 0, r.fold): r for r in T.fit_threshold_held_out(
            df, score="s", label="y", fold="fold", n_folds=4, group_by=by).collect()}
        assert len(fits) == 4 * (3 if by else 1)
        for (g, f), r in fits.items():
            train = [x for x in rows if x[4] != f and (not by or x[3] == g)]
            errors = lambda t: sum((2 if x[1] is not None and t is not None and x[1] >= t else 4) != x[2] for x in train)
            best = min([(errors(t), 0, t) for t in {x[1] for x in train if x[1] is not None}] + [(errors(None), 1, 0)])
            assert (r.n_err, r.threshold) == (best[0], None if best[1] else best[2])
