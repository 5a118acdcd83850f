"""Nearest neighbours: fixtures and brute force over several blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from hearth.operators import evaluate as EV
from hearth.operators import neighbors as NB


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double").withColumn(
        "v", NB.as_vector(["x"]))


def test_inverse_distance_mean(spark):
    donors = _frame(spark, [(1, 1.0, 10.0), (2, 2.0, 20.0), (3, 4.0, 40.0), (4, 9.0, 90.0)])
    q = _frame(spark, [(100, 0.0, None)])
    r = NB.knn_regress(q.select("id", "v"), donors.select("id", "v", "y"), k=3, id_col="id",
                       vec="v", target="y").first()
    assert abs(r.prediction - 30.0 / 1.75) < 1e-9


def test_zero_distance_uses_exact_matches(spark):
    donors = _frame(spark, [(1, 0.0, 7.0), (2, 1.0, 10.0), (3, 2.0, 20.0)])
    q = _frame(spark, [(100, 0.0, None)])
    r = NB.knn_regress(q.select("id", "v"), donors.select("id", "v", "y"), k=3, id_col="id",
                       vec="v", target="y").first()
    assert r.prediction == 7.0


def test_blocked_search_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = rng.integers(0, 5, size=(300, 3)).astype(float)  # many ties
    q = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts[:120])],
                              "qid long, v array<double>")
    d = spark.createDataFrame([(1000 + i, [float(v) for v in p]) for i, p in enumerate(pts)],
                              "did long, v array<double>")
    for metric, ordp in (("euclidean", 2), ("manhattan", 1)):
        nn = NB.nearest_neighbours(q, d, k=4, q_id="qid", q_vec="v", d_id="did", d_vec="v",
                                   metric=metric, cell_rows=20)
        got = {}
        for r in nn.collect():
            got.setdefault(r.qid, []).append((r.rank, r.did))
        for i in range(120):
            dist = np.linalg.norm(pts - pts[i], ord=ordp, axis=1)
            order = sorted(range(300), key=lambda j: (dist[j], 1000 + j))[:4]
            assert [did for _, did in sorted(got[i])] == [1000 + j for j in order]


def _brute(q, d, k, ordp, digits=None, allowed=None):
    out = {}
    for i, x in enumerate(q):
        dist = np.linalg.norm(d - x, ord=ordp, axis=1)
        key = np.round(dist, digits) if digits is not None else dist
        order = sorted((j for j in range(len(d)) if allowed is None or allowed(i, j)), key=lambda j: (key[j], j))
        out[i] = order[:k]
    return out


def _points(spark, x, name, extra=None):
    rows = [(i, [float(v) for v in p], *(() if extra is None else (int(extra[i]),))) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} long, v array<double>" + (", g int" if extra is not None else ""))


def _found(nn):
    out = {}
    for r in sorted(nn.collect(), key=lambda r: (r.q, r["rank"])):
        out.setdefault(r.q, []).append(r.d)
        assert r["rank"] == len(out[r.q])
    return out


@pytest.mark.parametrize("metric,ordp", [("euclidean", 2), ("manhattan", 1), ("minkowski", 3)])
def test_pruned_cells_are_exact(spark, metric, ordp, monkeypatch):
    monkeypatch.setattr(NB, "TASK_ROWS", 40)  # large cells are cut on both sides
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 3)) * 20
    d = np.concatenate((centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 3)), np.repeat(centres[:1], 150, axis=0)))
    q = np.concatenate((d[::9], centres[:1].repeat(60, axis=0), rng.normal(size=(20, 3)) * 30))
    nn = NB.nearest_neighbours(_points(spark, q, "q"), _points(spark, d, "d"), k=7, q_id="q", q_vec="v", d_id="d",
                               d_vec="v", metric=metric, p=ordp, rank_digits=9, cell_rows=25)
    assert _found(nn) == _brute(q, d, 7, ordp, 9)


def test_other_groups_and_self_over_cells(spark):
    rng = np.random.default_rng(5)
    x, g = rng.normal(size=(400, 4)), rng.integers(0, 4, 400)
    df = _points(spark, x, "q", g)
    nn = NB.nearest_neighbours(df, df.withColumnRenamed("q", "d"), k=5, q_id="q", q_vec="v", d_id="d", d_vec="v",
                               other_group="g", rank_digits=9, cell_rows=30)
    assert _found(nn) == _brute(x, x, 5, 2, 9, lambda i, j: g[i] != g[j])
    nn = NB.nearest_neighbours(df, df.withColumnRenamed("q", "d"), k=5, q_id="q", q_vec="v", d_id="d", d_vec="v",
                               exclude_self=True, rank_digits=9, cell_rows=30)
    assert _found(nn) == _brute(x, x, 5, 2, 9, lambda i, j: i != j)


def test_fewer_donors_than_k_and_none(spark):
    q = _points(spark, np.zeros((3, 2)), "q")
    d = _points(spark, np.eye(2), "d")
    names = {"k": 5, "q_id": "q", "q_vec": "v", "d_id": "d", "d_vec": "v"}
    for method in ("cells", "lsh"):
        assert _found(NB.nearest_neighbours(q, d, **names, cell_rows=1, method=method)) == {i: [0, 1] for i in range(3)}
        assert NB.nearest_neighbours(q, d.limit(0), **names, method=method).collect() == []


def test_shuffled_rows_grow_slower_than_pairs(spark):
    """Ten times the parts: the rows that move stay below N ** 1.5."""
    moved = []
    for sf in ("sf0.01", "sf0.1"):
        part = spark.read.parquet(f"/root/testdata/{sf}/part.parquet")
        x = part.select("p_partkey", NB.as_vector(["p_retailprice", F.length("p_type"), F.length("p_brand")]).alias("v"), "p_size")
        report = []
        NB.nearest_neighbours(x.where("p_size > 45"), x.where("p_size <= 45").withColumnRenamed("p_partkey", "near"), k=3,
                              q_id="p_partkey", q_vec="v", d_id="near", d_vec="v", report=report).count()
        moved.append(sum(report) + 2 * x.count())
    assert moved[1] < moved[0] * 10 ** 1.5


def test_lsh_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 8)) * 6
    d = centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 8))
    q = centres[rng.integers(0, 60, 150)] + rng.normal(size=(150, 8))
    for metric, ordp in (("euclidean", 2), ("manhattan", 1)):
        got = _found(NB.nearest_neighbours(_points(spark, q, "q"), _points(spark, d, "d"), k=5, q_id="q", q_vec="v",
                                           d_id="d", d_vec="v", metric=metric, method="lsh"))
        want = _brute(q, d, 5, ordp)
        assert all(len(got[i]) == 5 for i in want)
        assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.9


def test_donors_at_one_place_are_bounded(spark):
    """copies of a place made pairs with the square of their number."""
    rng = np.random.default_rng(21)
    places = rng.integers(0, 5, size=(6, 2)).astype(float)
    d, q = places[rng.integers(0, 6, 900)], places + 0.25
    donors = _points(spark, d, "d")
    plain = donors.select(F.col("d").alias("__did"), F.col("v").alias("__dv"))
    assert NB._thinned(plain, 4, []).count() == 4 * len(np.unique(d, axis=0))
    twice = NB._thinned(plain.unionByName(plain), 4, [])
    assert twice.select("__did").distinct().count() == 4 * len(np.unique(d, axis=0)) == twice.count() / 2
    names = {"k": 4, "q_id": "q", "q_vec": "v", "d_id": "d", "d_vec": "v"}
    want = _brute(q, d, 4, 2)
    for method in ("cells", "lsh"):
        assert _found(NB.nearest_neighbours(_points(spark, q, "q"), donors, **names, method=method)) == want
    own = _found(NB.nearest_neighbours(donors.withColumnRenamed("d", "q"), donors, **names, exclude_self=True))
    assert all(own[i] == [j for j in _brute(d[i:i + 1], d, 5, 2)[0] if j != i][:4] for i in range(0, 900, 50))


def test_coarse_pivots_leave_cells_as_they_are(monkeypatch):
    """every row was compared with every pivot, so the work grew with rows times pivots."""
    rng = np.random.default_rng(22)
    pivots = np.unique(rng.uniform(0, 100, size=(900, 3)), axis=0)
    x, limit = rng.uniform(-5, 105, size=(4000, 3)), rng.uniform(0, 30, 4000)
    limit[::97] = np.inf
    looked, plain = [], NB._pairwise

    def counted(a, b, metric, p):
        looked.append(len(a) * len(b))
        return plain(a, b, metric, p)
    monkeypatch.setattr(NB, "_pairwise", counted)
    for metric, p in (("euclidean", 2.0), ("manhattan", 1.0), ("minkowski", 3.0)):
        found, work = [], []
        for least in (10 ** 9, 100):
            monkeypatch.setattr(NB, "COARSE_PIVOTS", least)
            cells = NB.Cells(pivots, metric, p)
            cells.sizes = np.random.default_rng(1).integers(0, 9, size=(len(pivots), 3))
            cells.radius = np.where(cells.sizes[:, 0] > 0, np.random.default_rng(2).uniform(0, 8, len(pivots)), -np.inf)
            cells.least = np.where(cells.sizes[:, 0] > 0, 0.5, np.inf)
            cells.bins = np.arange(len(pivots)) // 2
            looked.clear()
            cell, away = cells.nearest(x)
            work.append(sum(looked))
            first = cells.first(x[:500], [(0, 1) if i % 2 else (0,) for i in range(500)], 12, True)
            seen = [f[:1] for f in first]
            found.append((cell.tolist(), away.tolist(), [f.tolist() for f in first],
                          [f.tolist() for f in cells.within(x[:500], limit[:500], seen)]))
        assert found[0] == found[1]
        assert work[1] < work[0] / 2


def test_lsh_query_recall(spark):
    rows = E.queries()["knn_lsh"](spark, "/root/testdata/sf0.01").collect()
    asked = {r.p_partkey for r in rows}
    assert len(rows) == 10 * len(asked) and sum(r.exact for r in rows) >= 0.9 * len(rows)


def test_columns_filled_by_one_search_as_by_ten(spark, capsys):
    rng = np.random.default_rng(9)
    n, cols = 500, [f"t{i}" for i in range(10)]
    f = rng.integers(0, 30, size=(n, 2)).astype(float)
    t = rng.normal(size=(n, 10))
    gone = rng.random((n, 10)) < np.linspace(0.02, 0.9, 10)
    rows = [(i, *map(float, f[i]), *(None if gone[i, j] else float(t[i, j]) for j in range(10))) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, " + ", ".join(f"{c} double" for c in cols))
    one = NB.knn_impute(df, id_col="id", fill_cols=cols, feature_cols=["a", "b"], cell_rows=40)
    capsys.readouterr()
    one.explain()
    assert capsys.readouterr().out.count("FlatMapCoGroupsInPandas") == 1  # the first visits are written
    got = {r.id: r for r in one.collect()}
    for c in cols:
        alone = NB.knn_impute(df.select("id", "a", "b", c), id_col="id", fill_cols=[c], feature_cols=["a", "b"],
                              cell_rows=10 ** 6)
        assert all(abs(got[r.id][c] - r[c]) < 1e-9 for r in alone.collect())


def test_impute_fills_only_missing(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 1.0, 10.0), (3, 2.0, 20.0), (4, 4.0, 40.0),
                                (5, 9.0, 90.0)], "id long, f double, t double")
    out = {r.id: r.t for r in NB.knn_impute(df, id_col="id", fill_cols=["t"],
                                             feature_cols=["f"]).collect()}
    assert abs(out[1] - 30.0 / 1.75) < 1e-9 and out[2] == 10.0


def test_stratified_fold_sizes(spark):
    rows = [(i, 0) for i in range(7)] + [(100 + i, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, y int")
    f = EV.stratified_folds(df, id_col="id", label="y", n_folds=5, seed=1)
    sizes = {}
    for r in f.collect():
        sizes.setdefault(r.y, [0] * 5)[r.fold] += 1
    assert sizes[0] == [2, 2, 1, 1, 1] and sizes[1] == [1, 1, 1, 0, 0]


def test_holdout_exact_size(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "k")
    h = EV.holdout_split(df, id_col="k", test_fraction=0.25)
    assert h.where(F.col("is_test")).count() == 26


def test_grid_search_ranks_candidates(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=120)
    y = (x + rng.normal(scale=0.5, size=120) > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "id long, x double, y int")
    df = EV.stratified_folds(df, id_col="id", label="y", n_folds=3)
    res = EV.grid_search(df, lambda p: EV.neighbour_vote(["x"], id_col="id", k=p["k"], p=2),
                         {"k": [1, 15]}, id_col="id", n_folds=3)
    rows = {r.candidate: r for r in res.collect()}
    assert set(rows) == {"k=1", "k=15"}
    assert all(0.5 < r.auc <= 1.0 for r in rows.values())
    best = EV.best_candidate(res, "auc").first()
    assert best.auc == max(r.auc for r in rows.values())


def test_product_and_sums_pick_the_same_neighbours(monkeypatch):
    rng = np.random.default_rng(21)
    x = np.concatenate((rng.normal(size=(300, 16)) + 50, np.repeat(rng.normal(size=(5, 16)) + 50, 30, axis=0)))
    queries = pd.DataFrame({"__qid": np.arange(len(x)), "__qv": list(x), "__limit": np.where(np.arange(len(x)) % 2, np.inf, 5.0),
                            "__lanes": [np.array([0])] * len(x), "__qg": np.arange(len(x)) % 3})
    donors = pd.DataFrame({"__did": np.arange(len(x)), "__dv": list(x), "__dg": np.arange(len(x)) % 3, "y": np.arange(len(x))})
    for digits in (None, 9, 1):
        for self_out, grouped in ((True, False), (False, True), (False, False)):
            search = NB._search_cell(7, "euclidean", 2.0, self_out, grouped, ["y"], [], digits)
            called = []
            monkeypatch.setattr(NB, "_may_be_near", lambda *a, f=NB._may_be_near: called.append(1) or f(*a))
            got = search(queries, donors)
            monkeypatch.undo()
            monkeypatch.setattr(NB, "PRODUCT_DIM", 1000)
            want = search(queries, donors)
            monkeypatch.undo()
            assert called
            by = ["__qid", "__key", "__did"]
            pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True), want.sort_values(by, ignore_index=True), check_dtype=False)


def test_a_query_moves_once_for_a_bin_of_cells(spark):
    """Nothing is pruned in 24 dimensions: rows moved follow the bins, not the cells."""
    rng = np.random.default_rng(22)
    x = rng.normal(size=(1500, 24))
    df, report = _points(spark, x, "q"), []
    nn = NB.nearest_neighbours(df, df.withColumnRenamed("q", "d"), k=3, q_id="q", q_vec="v", d_id="d", d_vec="v",
                               exclude_self=True, rank_digits=9, cell_rows=8, report=report)
    assert _found(nn) == _brute(x, x, 3, 2, 9, lambda i, j: i != j)
    assert sum(report) < 1500 * 100  # by cells of 8: more than 1500 * 187


def test_lists_of_bins_keep_no_distance_matrix():
    rng = np.random.default_rng(23)
    cells = NB.Cells(rng.normal(size=(200, 3)), "euclidean", 2.0)
    cells.sizes, cells.bins = np.ones((200, 1), np.int64), np.arange(200, dtype=np.int32) // 4
    assert all(x.base is None for x in cells.first(rng.normal(size=(50, 3)), [[0]] * 50, 5, False))
