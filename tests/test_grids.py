"""Staged grids against fits of single points, and the kernel SVM against an
exact dual solution."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array

from hearth.operators import evaluate as EV
from hearth.operators import grids as G
from hearth.operators import kernel as K
from hearth.operators import threshold as T


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(180, 2))
    y = (x[:, 0] ** 2 + x[:, 1] + rng.normal(size=180) * 0.4 > 0.8).astype(int)
    frame = pd.DataFrame({"id": np.arange(180) * 2 + 1, "a": x[:, 0], "b": x[:, 1], "y": y, "fold": np.arange(180) % 3})
    return frame, spark.createDataFrame(frame, "id long, a double, b double, y int, fold int")


def _scores(df):
    out = {}
    for r in df.collect():
        assert (r.candidate, r.id) not in out
        out[r.candidate, r.id] = r.score
    return out


HOW = {"features": ["a", "b"], "id_col": "id", "n_folds": 3}


def _single(df, fitter):
    return {r.id: r.score for r in EV.oof_predict(df, fitter, id_col="id", n_folds=3).collect()}


def test_boosted_stages(spark, data):
    frame, df = data
    grid = {"rounds": [2, 5], "eta": [0.2], "depth": [2], "min_child_weight": [1.0], "subsample": [0.8, 1.0], "gamma": [0.0]}
    got = _scores(G.boosted_grid(df, grid, **HOW))
    assert len(got) == 4 * 180
    p = {"rounds": 5, "eta": 0.2, "depth": 2, "min_child_weight": 1.0, "subsample": 0.8, "gamma": 0.0}
    one = _single(df, EV.boosted_trees(["a", "b"], id_col="id", **p))
    # bins of all rows, not of each fold's: only the cuts differ
    assert np.corrcoef([one[i] for i in frame.id], [got[G.name_of("gbt", p), i] for i in frame.id])[0, 1] > 0.9


def test_neighbours_of_all_folds(spark, data):
    frame, df = data
    got = _scores(G.neighbour_grid(df, {"k": [5, 9], "weights": ["uniform", "distance"], "p": [1, 2, 3]}, **HOW))
    assert len(got) == 12 * 180
    for k, w, p in ((5, "uniform", 1), (9, "distance", 2), (5, "distance", 3)):
        one = _single(df, EV.neighbour_vote(["a", "b"], id_col="id", k=k, weights=w, p=p))
        name = G.name_of("knn", {"k": k, "weights": w, "p": p})
        assert all(abs(one[i] - got[name, i]) < 1e-9 for i in frame.id)


def test_forest_prefixes_and_depths(spark, data):
    frame, df = data
    train = EV._assemble(df, ["a", "b"])
    model = RandomForestClassifier(featuresCol="__x", labelCol="y", seed=1, numTrees=12, maxDepth=6).fit(train)
    forest = G.Forest(spark, model)
    want = {r["id"]: r.p for r in model.transform(train).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    share = forest.shares(frame[["a", "b"]].to_numpy(), [4, 12], [0, 3, 6])
    assert np.allclose(share[2, 1], [want[i] for i in frame.id])
    # the root knows the training share of its own sample only
    assert share[0, 1].std() < 1e-12 and abs(share[0, 1, 0] - frame.y.mean()) < 0.05
    got = _scores(G.forest_grid(df, {"numTrees": [4, 12], "maxDepth": [3, 6]}, **HOW))
    assert len(got) == 4 * 180 and all(0 <= s <= 1 for s in got.values())


def test_results_of_all_candidates_at_once(spark, data):
    _, df = data
    grids = {"knn": {"k": [1, 15], "weights": ["uniform"], "p": [2]}, "svm": {"C": [1.0], "gamma": [0.5]}}
    out = G.compare_grids(df, grids, **HOW)
    got = {r.candidate: r for r in out["results"].collect()}
    # a training row is its own nearest neighbour
    assert len(got) == 3 and got["knn(k=1,weights=uniform,p=2)"].train_accuracy == 1.0
    assert out["best"].first().auc == max(r.auc for r in got.values())
    assert len({(r.candidate, r.fold, r.is_train) for r in out["accuracy"].collect()}) == 3 * 4 * 2
    assert out["confusion"].toPandas().n.sum() == 180
    for name, r in got.items():
        alone = out["scores"].where(out["scores"].candidate == name)
        assert abs(T.roc_auc(alone, score="score", label="label").first()["auc"] - r.auc) < 1e-12
        cut = EV.score_cut(name)
        rows = alone.collect()
        assert abs(np.mean([(s.score > cut) == s.label for s in rows]) - r.accuracy) < 1e-12 and r.auc > 0.7


def _exact_svm(x, y, gamma, c):
    """Dual coordinate pairs (SMO) of the kernel SVM; margins of all rows."""
    k, n = K.rbf(x, x, gamma), len(x)
    t, alpha = np.where(y > 0, 1.0, -1.0), np.zeros(len(x))
    grad = -np.ones(n)
    for _ in range(100_000):
        up = ((t > 0) & (alpha < c)) | ((t < 0) & (alpha > 0))
        low = ((t < 0) & (alpha < c)) | ((t > 0) & (alpha > 0))
        v = -t * grad
        i, j = np.where(up, v, -np.inf).argmax(), np.where(low, v, np.inf).argmin()
        if v[i] - v[j] < 1e-6:
            break
        step = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        room_i = c - alpha[i] if t[i] > 0 else alpha[i]
        room_j = alpha[j] if t[j] > 0 else c - alpha[j]
        step = min(step, room_i, room_j)
        alpha[i] += t[i] * step
        alpha[j] -= t[j] * step
        grad += t * step * (k[:, i] - k[:, j])
    return k @ (alpha * t) + (v[i] + v[j]) / 2


@pytest.mark.parametrize("landmarks", [180, 40])
def test_margins_against_the_exact_svm(spark, data, landmarks):
    frame, df = data
    x, y = frame[["a", "b"]].to_numpy(), frame.y.to_numpy()
    params = [K.SvmParams(C=c, gamma=g) for c in (0.5, 2.0) for g in (0.05, 0.5)]
    fit = K.fit_svm(df.repartition(3), params, features=["a", "b"], id_col="id", landmarks=landmarks)
    got = {(r.model, r["id"]): r.score for r in fit.score(df).collect()}
    for m, p in enumerate(params):
        mine = np.array([got[m, i] for i in frame.id])
        exact = _exact_svm(x, y, p.gamma, p.C)
        # 40 landmarks of 180 rows: the margin error is that of the projection
        assert np.abs(mine - exact).max() < (0.05 if landmarks == 180 else 0.5)
        auc = lambda s: np.mean((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0]))
        assert abs(auc(mine) - auc(exact)) < 0.005


def test_importances_name_the_planted_features(spark, data):
    frame, _ = data
    rng = np.random.default_rng(9)
    noisy = frame.assign(c=rng.normal(size=len(frame)), d=rng.normal(size=len(frame)))
    df = spark.createDataFrame(noisy, "id long, a double, b double, y int, fold int, c double, d double")
    rows = []
    G.forest_grid(df, {"numTrees": [20], "maxDepth": [5]}, features=["c", "a", "d", "b"], id_col="id", n_folds=3, importances=rows)
    top = EV.mean_importances(rows, spark, n_folds=3, top=3).collect()
    assert {top[0].feature, top[1].feature} == {"a", "b"} and len(top) == 3
    assert abs(sum(v for _, _, v in rows) / 3 - 100.0) < 1e-6


def test_best_candidate_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.5, 0.8), ("a", 0.4, 0.8), ("c", 0.9, 0.7)], "candidate string, accuracy double, auc double")
    assert EV.best_candidate(df, "auc").first()["candidate"] == "a"
    assert EV.best_candidate(df, "accuracy").first()["candidate"] == "c"


def test_models_and_folds_of_a_grid_are_fitted_together(spark, monkeypatch):
    import threading
    meet = threading.Barrier(2, timeout=60)
    rows = spark.createDataFrame([("a", 1, 0, 1, 0.5, False)], "candidate string, id long, fold int, label int, score double, is_train boolean")

    def waits(df, grid, **how):
        meet.wait()
        return rows
    monkeypatch.setattr(G, "GRID_SCORES", {"x": waits, "y": waits})
    assert G.grid_scores(rows, {"x": {}, "y": {}}, features=[], id_col="id").count() == 2
    assert G.together(spark, [lambda: (meet.wait(), 1)[1], lambda: (meet.wait(), 2)[1]]) == [1, 2]


def test_sums_reach_the_driver_once_a_key_and_small_tables_are_dealt(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from hearth.operators import partials as P
    sent, collect = [], Classic.collect
    monkeypatch.setattr(Classic, "collect", lambda df: sent.append(collect(df)) or sent[-1])
    df = spark.range(1000).withColumnRenamed("id", "x").repartition(12)
    found = P.array_sums(df, lambda frame: [(k, np.array([len(frame), frame["x"].sum() * k])) for k in (0, 1, 2)])
    assert {k: list(v) for k, v in found.items()} == {k: [1000, 499500 * k] for k in (0, 1, 2)}
    assert [len(rows) for rows in sent] == [3]
    assert P.array_sums(df.where("x < 0"), lambda frame: [(0, np.ones(1))]) == {}
    assert P.dealt(spark.range(100).coalesce(1), "id").rdd.getNumPartitions() == P.FIT_TASKS


def test_rows_are_scored_for_the_folds_that_are_asked_for(spark, data, monkeypatch):
    _, df = data
    made, real = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda x, name="stage": made.append((name, real(x, name))) or made[-1][1])
    grids = {"gbt": {"rounds": [2, 5], "depth": [2], "gamma": [0.0, 0.1]}, "svm": {"C": [1.0, 2.0], "gamma": [0.5]},
             "rf": {"numTrees": [4], "maxDepth": [2, 3]}}
    for train_side in (False, True):
        for m, grid in grids.items():
            made.clear()
            long = G.GRID_SCORES[m](df, grid, train_side=train_side, **HOW)
            wide = [x for name, x in made if name == "fold-scores"]
            # one row a row and fold, with an array of all candidates
            assert sum(x.count() for x in wide) == 180 * (3 if train_side else 1)
            n = len(EV.param_grid(grid))
            assert {r.n for x in wide for r in x.selectExpr("size(scores) n").distinct().collect()} == {n}
            assert long.count() == n * 180 * (3 if train_side else 1)


def test_training_rows_vote_with_the_donors_at_their_place(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, size=(90, 2)).astype(float)  # many rows at one place
    y = [None if i % 11 == 0 else int(v) for i, v in enumerate(rng.integers(0, 2, 90))]
    x[0] = (90.0, 90.0)  # alone, and without a label
    rows = [(i * 2 + 1, float(a), float(b) if i != 5 else None, y[i], i % 3) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, fold int")
    asked, real = [], G.NB.nearest_neighbours
    monkeypatch.setattr(G.NB, "nearest_neighbours", lambda q, d, **how: asked.append(q.count()) or real(q, d, **how))

    def scores(*weights):
        grid = {"k": [1, 4], "weights": weights, "p": [1]}
        return {(r.candidate, r.id, r.fold): (r.is_train, r.label, r.score)
                for r in G.neighbour_grid(df, grid, train_side=True, **HOW).collect() if "distance" in r.candidate}
    got = scores("distance")
    # beside uniform weights, all rows are searched
    want = scores("uniform", "distance")
    assert asked[1] == 270 and asked[0] < 150 and got.keys() == want.keys() and len(got) >= 2 * 89 * 3
    for at, (train, label, score) in want.items():
        assert got[at][:2] == (train, label)
        assert score == got[at][2] if score is None or got[at][2] is None else abs(score - got[at][2]) < 1e-9


def test_forest_is_read_by_trees(spark, data):
    _, df = data
    model = RandomForestClassifier(featuresCol="__x", labelCol="y", seed=2, numTrees=7, maxDepth=4).fit(EV._assemble(df, ["a", "b"]))
    forest = G.Forest(spark, model)
    assert [len(t[0]) for t in forest.trees] == [t.numNodes for t in model.trees]


def test_cubes_are_powers():
    x, y = np.random.default_rng(8).normal(size=(2, 20, 4))
    want = (np.abs(x[:, None] - y[None]) ** 3).sum(axis=2) ** (1 / 3)
    assert np.allclose(G.NB._pairwise(x, y, "minkowski", 3), want, rtol=1e-12)


def test_hessians_travel_as_triangles_and_kernels_share_their_distances(spark, data, monkeypatch):
    frame, df = data
    asked, real = [], K.array_sums
    monkeypatch.setattr(K, "array_sums", lambda *a, **how: asked.append(real(*a, **how)) or asked[-1])
    params = [K.SvmParams(C=c, gamma=g, fold=1) for c in (0.5, 2.0) for g in (0.05, 0.5)]
    fit = K.fit_svm(df, params, features=["a", "b"], id_col="id", fold_col="fold", landmarks=40)
    for m, w in enumerate(fit.weights):
        assert len(asked[0][m]) == 1 + len(w) + len(w) * (len(w) + 1) // 2
    x = frame[["a", "b"]].to_numpy()
    for gamma, k in zip((0.05, 0.5), K.kernels(x, x[:40], [0.05, 0.5])):
        assert np.allclose(k, np.exp(-gamma * ((x[:, None] - x[:40]) ** 2).sum(axis=2)))
    got = {(r.model, r["id"]): r.score for r in fit.score(df).collect()}
    assert np.allclose(fit.margins(x, 1), [[got[m, i] for m in range(4)] for i in frame.id])
