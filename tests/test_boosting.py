"""Second-order boosting against a plain numpy version."""

import numpy as np
import pandas as pd
import pytest

from hearth.operators import boosting as B
from hearth.operators import partials


def _grow(x, y, ids, p, bounds):
    """Margins and trees, node by node and threshold by threshold."""
    margin, trees = np.zeros(len(x)), []
    bins = np.stack([(x[:, i:i + 1] > b).sum(axis=1) for i, b in enumerate(bounds)], axis=1)
    for r in range(p.rounds):
        prob = 1 / (1 + np.exp(-margin))
        used = np.flatnonzero(B.uniform(ids, r, p.seed) < p.subsample) if p.subsample < 1 else np.arange(len(x))
        g, h = (prob - y), prob * (1 - prob)
        cols = np.flatnonzero(B.columns_of(p, x.shape[1], r))
        w = lambda rows: -g[rows].sum() / (h[rows].sum() + p.reg_lambda) * p.eta
        s = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + p.reg_lambda)

        def node(rows, depth):
            best = None
            if depth < p.depth:
                for f in cols:
                    for b in range(len(bounds[f])):
                        left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                        if min(h[left].sum(), h[right].sum()) < max(p.min_child_weight, 1e-12):
                            continue
                        gain = s(left) + s(right) - s(rows)
                        if gain > B.LEAST_GAIN and (best is None or gain > best[0] + 1e-10):
                            best = (gain, f, b, left, right)
            if best is None:
                return {"value": w(rows)}
            gain, f, b, left, right = best
            out = {"gain": gain, "f": f, "b": b, "l": node(left, depth + 1), "r": node(right, depth + 1), "value": w(rows)}
            if gain < p.gamma and "f" not in out["l"] and "f" not in out["r"]:
                return {"value": out["value"]}
            return out
        tree = node(used, 0)
        trees.append(tree)

        def leaf(t, i):
            while "f" in t:
                t = t["l"] if bins[i, t["f"]] <= t["b"] else t["r"]
            return t["value"]
        margin = margin + np.array([leaf(tree, i) for i in range(len(x))])
    return margin, trees


def _same(tree, want, node=0):
    if "f" not in want:
        return tree.feature[node] < 0 and abs(tree.value[node] - want["value"]) < 1e-9
    return (tree.feature[node] == want["f"] and tree.cut[node] == want["b"] and abs(tree.gain[node] - want["gain"]) < 1e-7
            and _same(tree, want["l"], 2 * node + 1) and _same(tree, want["r"], 2 * node + 2))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(600, 3)), 2)
    x[:, 2] = rng.integers(0, 4, 600)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=600) > 1.5).astype(int)
    frame = pd.DataFrame({"id": np.arange(600) * 3, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "fold": np.arange(600) % 3})
    return x, y, frame, spark.createDataFrame(frame).repartition(3)


PARAMS = [B.BoostParams(rounds=12, depth=3, min_child_weight=2.0, gamma=0.3),
          B.BoostParams(rounds=5, depth=4, min_child_weight=4.0, subsample=0.8, columns=0.67, gamma=1.5),
          B.BoostParams(rounds=12, depth=3, min_child_weight=2.0, fold=1)]


def test_trees_are_those_of_a_plain_version(spark, data):
    x, y, frame, df = data
    fit = B.boost(df, PARAMS, features=["a", "b", "c"], id_col="id", fold_col="fold", max_bins=16)
    ids = frame["id"].to_numpy()
    for m, p in enumerate(PARAMS):
        mine = np.ones(600, bool) if p.fold is None else frame["fold"].to_numpy() != p.fold
        margin, trees = _grow(x[mine], y[mine], ids[mine], p, fit.bounds)
        assert all(_same(fit.trees[r][m], trees[r]) for r in range(p.rounds))
        got = {r["id"]: r.score for r in fit.score(df).where(f"model = {m}").collect()}
        assert np.allclose([got[i] for i in ids[mine]], 1 / (1 + np.exp(-margin)))
    # pruning and the hessian floor are not idle
    assert any((t[1].feature >= 0).sum() < 15 for t in fit.trees if t[1] is not None)


def test_stages_are_shorter_fits(spark, data):
    _, _, _, df = data
    p = B.BoostParams(rounds=11, depth=2, subsample=0.9)
    whole = B.boost(df, [p], features=["a", "b"], id_col="id")
    stages = {(r["id"], r.stage): r.score for r in whole.score(df, stages=[[0, 4, 11]]).collect()}
    short = B.boost(df, [B.BoostParams(rounds=4, depth=2, subsample=0.9)], features=["a", "b"], id_col="id")
    assert all(abs(stages[r["id"], 4] - r.score) < 1e-12 for r in short.score(df).collect())
    assert {s for (_, n), s in stages.items() if n == 0} == {0.5}


def test_sums_over_many_partitions(spark, data, monkeypatch):
    _, _, _, df = data
    one = B.boost(df, PARAMS[:1], features=["a", "b", "c"], id_col="id")
    monkeypatch.setattr(partials, "DIRECT_PARTITIONS", 0)
    many = B.boost(df.repartition(7), PARAMS[:1], features=["a", "b", "c"], id_col="id")
    for a, b in zip(one.trees, many.trees):
        assert np.array_equal(a[0].feature, b[0].feature) and np.allclose(a[0].value, b[0].value)


def test_constant_unknown_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0, None, 1), (2, 1.0, 2.0, 0), (3, 1.0, 3.0, None)], "id long, a double, b double, y int")
    fit = B.boost(df, [B.BoostParams(rounds=3, min_child_weight=0.0)], features=["a", "b"], id_col="id")
    assert len(fit.score(df).collect()) == 3 and not any(t[0].feature[0] == 0 for t in fit.trees)
    none = B.boost(df.limit(0), [B.BoostParams(rounds=2)], features=["a", "b"], id_col="id")
    assert {r.score for r in none.score(df).collect()} == {0.5}


def test_models_of_equal_trees_are_fitted_as_one(spark, data, monkeypatch):
    _, _, frame, df = data
    asked, real = [], B.array_sums
    monkeypatch.setattr(B, "array_sums", lambda *a, **how: asked.append(real(*a, **how)) or asked[-1])
    p = {"rounds": 8, "depth": 3, "min_child_weight": 2.0, "fold": 1, "subsample": 0.9}
    params = [B.BoostParams(**{**p, "gamma": g, "rounds": r}) for g, r in ((0.0, 8), (1e-6, 5), (3.0, 8))]
    how = {"features": ["a", "b", "c"], "id_col": "id", "fold_col": "fold", "max_bins": 16}
    for held in (10, 1):
        monkeypatch.setattr(B, "ROUNDS_HELD", held)
        asked.clear()
        fit = B.boost(df, params, **how)
        assert all(fit.trees[r][0] is fit.trees[r][1] for r in range(5)) and fit.trees[5][1] is None
        # one sum serves all three until the third prunes what the others keep
        assert [*asked[0]] == [0] and any(set(found) == {0, 2} for found in asked) and all(1 not in found for found in asked)
        both = {(r.model, r["id"]): r.score for r in fit.score(df).collect()}
        x = frame[["a", "b", "c"]].to_numpy()
        staged = fit.stage_scores(x, [0, 1, 2], [0, 5, 8])
        for m, one in enumerate(params):
            alone = {r["id"]: r.score for r in B.boost(df, [one], **how).score(df).collect()}
            assert all(abs(alone[i] - both[m, i]) < 1e-9 for i in frame["id"])
            assert np.allclose(staged[:, m, 1 if m == 1 else 2], [both[m, i] for i in frame["id"]], atol=1e-12)
        assert (staged[:, :, 0] == 0.5).all()


def test_rows_of_earlier_rounds_are_deleted(spark, data, monkeypatch):
    import glob

    from hearth.session import ensure_checkpoint_dir
    _, _, _, df = data
    monkeypatch.setattr(B, "ROUNDS_HELD", 1)
    B.boost(df, [B.BoostParams(rounds=4, depth=2)], features=["a", "b"], id_col="id")
    assert not glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/hearth-boost-rows-*")
