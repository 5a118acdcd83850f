"""Ward cut, scaling and cluster description."""

import math

import numpy as np

from hearth.operators import clusters as CL
from hearth.operators import partials as PS
from hearth.operators import scaling as SC


def test_ward_fixture(spark):
    c = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [10.0])], "micro_id long, centre array<double>")
    member, link = CL.ward_cut(c, height=None)
    hs = sorted(r.height for r in link.collect())
    assert abs(hs[0] - 1.0) < 1e-12 and abs(hs[1] - math.sqrt(4 / 3) * 9.5) < 1e-9
    member, _ = CL.ward_cut(c, height=5.0)
    m = {r.micro_id: r.cluster for r in member.collect()}
    assert m[0] == m[1] != m[2]


def _greedy_ward(x, t):
    clusters = {i: (x[i].copy(), 1.0, {i}) for i in range(len(x))}
    while len(clusters) > 1:
        best = None
        ks = sorted(clusters)
        for a in range(len(ks)):
            for b in range(a + 1, len(ks)):
                ca, wa, _ = clusters[ks[a]]
                cb, wb, _ = clusters[ks[b]]
                h = math.sqrt(2 * wa * wb / (wa + wb)) * np.linalg.norm(ca - cb)
                if best is None or h < best[0]:
                    best = (h, ks[a], ks[b])
        h, u, v = best
        if h > t:
            break
        cu, wu, mu = clusters.pop(u)
        cv, wv, mv = clusters.pop(v)
        clusters[u] = ((cu * wu + cv * wv) / (wu + wv), wu + wv, mu | mv)
    return sorted(sorted(m) for _, _, m in clusters.values())


def test_ward_matches_greedy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(30, 3))
    c = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)],
                              "micro_id long, centre array<double>")
    for t in (0.8, 1.6, 3.0):
        member, _ = CL.ward_cut(c, height=t)
        groups = {}
        for r in member.collect():
            groups.setdefault(r.cluster, []).append(r.micro_id)
        assert sorted(sorted(g) for g in groups.values()) == _greedy_ward(x, t)


def _merges(x, w):
    """Every merge of greedy Ward: heights, and the members of both sides."""
    c = {i: (x[i].copy(), w[i], frozenset([i])) for i in range(len(x))}
    out = []
    ids = sorted(c)
    while len(ids) > 1:
        v, m = np.array([c[i][0] for i in ids]), np.array([c[i][1] for i in ids])
        h = np.sqrt(2 * m[:, None] * m / (m[:, None] + m) * ((v[:, None] - v) ** 2).sum(axis=2))
        h[np.tril_indices(len(ids))] = np.inf
        a, b = np.unravel_index(h.argmin(), h.shape)
        (vu, wu, mu), (vv, wv, mv) = c.pop(ids[a]), c.pop(ids[b])
        out.append((h[a, b], min(mu), min(mv), wu + wv))
        c[min(mu | mv)] = ((vu * wu + vv * wv) / (wu + wv), wu + wv, mu | mv)
        ids = sorted(c)
    return out


def _centres(spark, x, w=None):
    w = np.ones(len(x)) if w is None else w
    return spark.createDataFrame([(i, [float(v) for v in p], float(m)) for i, (p, m) in enumerate(zip(x, w))],
                                 "micro_id long, centre array<double>, w double")


def test_linkage_of_300_points_is_the_greedy_one(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(300, 5)), rng.integers(1, 9, 300).astype(float)
    for weights, name in ((np.ones(300), None), (w, "w")):
        link = CL.ward_linkage(_centres(spark, x, w), weight=name).collect()
        want = sorted(_merges(x, weights))
        got = sorted((r.height, min(r.left, r.right), max(r.left, r.right), r["size"]) for r in link)
        assert len(got) == 299
        for g, h in zip(got, want):
            assert abs(g[0] - h[0]) < 1e-9 and g[1:3] == (min(h[1:3]), max(h[1:3])) and g[3] == h[3]


def test_one_linkage_is_cut_at_any_height(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    centres = _centres(spark, x)
    link = CL.ward_linkage(centres)
    heights = [0.0, 0.9, 1.7, 3.0, 100.0]
    got = {h: {} for h in heights}
    for r in CL.cut_linkage(centres, link, heights).collect():
        got[r.height].setdefault(r.cluster, []).append(r.micro_id)
    for h in heights:
        groups = sorted(sorted(g) for g in got[h].values())
        assert groups == _greedy_ward(x, h)
        assert all(c == min(g) for c, g in got[h].items())


def test_ward_edges(spark):
    assert CL.ward_linkage(_centres(spark, np.zeros((0, 2)))).collect() == []
    member, link = CL.ward_cut(_centres(spark, np.zeros((1, 2))))
    assert [tuple(r) for r in member.collect()] == [(0, 0)] and link.count() == 0
    # equal points and equal distances
    member, link = CL.ward_cut(_centres(spark, np.array([[0.0], [0.0], [0.0], [1.0], [2.0], [3.0]])))
    assert {r.cluster for r in member.collect()} == {0} and link.count() == 5


def _lloyd(x, c, steps):
    for _ in range(steps):
        at = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(len(c))])
    return c, ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)


def test_lloyd_against_numpy_and_bounds_skip(spark):
    rng = np.random.default_rng(12)
    means = rng.normal(size=(8, 4)) * 3
    x = means[rng.integers(0, 8, 1500)] + rng.normal(size=(1500, 4))
    start = np.concatenate((x[:7], [[500.0] * 4]))  # the last one stays empty
    pts = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, v array<double>").repartition(4)
    init = spark.createDataFrame([(10 + i, [float(v) for v in p]) for i, p in enumerate(start)], "cluster long, centre array<double>")
    for steps in (1, 2, 6):
        assign, final = CL.refine_kmeans(pts, init, id_col="id", vec="v", steps=steps)
        want, at = _lloyd(x, start, steps)
        got = np.array([r.centre for r in sorted(final.collect(), key=lambda r: r.cluster)])
        assert np.allclose(got, want, atol=1e-9)
        assert [r.cluster - 10 for r in sorted(assign.collect(), key=lambda r: r.id)] == at.tolist()
    computed = []
    assign, final = CL.refine_kmeans(pts, init, id_col="id", vec="v", tol=0.0, report=computed)
    c = np.array([r.centre for r in sorted(final.collect(), key=lambda r: r.cluster)])
    assert np.allclose(_lloyd(x, c, 1)[0], c)
    assert min(computed) < 0.2 * len(x)


def test_lloyd_in_blocks(spark, monkeypatch):
    """points travel as blocks, and few small sums go to the driver without a second stage."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(700, 3))
    pts = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, v array<double>")
    init = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x[:5])], "cluster long, centre array<double>")
    monkeypatch.setattr(CL, "BLOCK_VALUES", 100)
    monkeypatch.setattr(CL, "TASK_VALUES", 500)
    monkeypatch.setattr(CL, "CENTRES_PER_BLOCK", 2)
    want, at = _lloyd(x, x[:5], 4)
    for most in (0, PS.DIRECT_BYTES):
        monkeypatch.setattr(PS, "DIRECT_BYTES", most)
        assign, final = CL.refine_kmeans(pts, init, id_col="id", vec="v", steps=4)
        assert np.allclose([r.centre for r in sorted(final.collect(), key=lambda r: r.cluster)], want, atol=1e-9)
        assert [r.cluster for r in sorted(assign.collect(), key=lambda r: r.id)] == at.tolist()
    packed = pts.select(pts.v.alias("__v")).mapInPandas(CL._blocks(3), "__n int, __v binary").collect()
    assert sum(r["__n"] for r in packed) == 700 and max(len(r["__v"]) for r in packed) <= 8 * 100


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>")
    value, vector = np.linalg.eigh(np.cov(x.T))
    value, vector = value[::-1], vector[:, ::-1]
    ratio = [r.ratio for r in SC.pca_variance(df, vec="v", dim=5).orderBy("component").collect()]
    assert np.allclose(ratio, value / value.sum())
    scores = np.array([r.pcs for r in SC.pca_project(df, k=3, vec="v", keep=["id"]).orderBy("id").collect()])
    want = (x - x.mean(axis=0)) @ vector[:, :3]
    assert np.allclose(scores * np.sign((scores * want).sum(axis=0)), want)


def test_population_scaling(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    st = SC.fit_scaler(df, ["x"])
    assert abs(st["x"][0] - 7 / 3) < 1e-12 and abs(st["x"][1] - 1.247219128924647) < 1e-12
    back = SC.inverse_scale(SC.standardize(df, st), st).collect()
    assert [round(r.x, 9) for r in back] == [1.0, 2.0, 4.0]


def test_vtest_matches_formula(spark):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 3, 200)
    v = rng.normal(size=200) + g
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "c int, v double")
    out = {r.c: r for r in CL.describe_clusters(df, cluster="c", cols=["v"]).collect()}
    n, m, s = len(v), v.mean(), v.std()
    for k in range(3):
        sub = v[g == k]
        nk = len(sub)
        vt = (sub.mean() - m) / math.sqrt(s * s / nk * (n - nk) / (n - 1))
        assert abs(out[k].v_test - vt) < 1e-9
        p = math.erfc(abs(vt) / math.sqrt(2))
        assert abs(out[k].p_value - p) < 1e-6


def test_pca_ratios(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) * np.array([3.0, 2.0, 1.0, 0.5])
    df = spark.createDataFrame([([float(a) for a in r],) for r in x], "v array<double>")
    var = [r.ratio for r in SC.pca_variance(df, vec="v", dim=4).orderBy("component").collect()]
    assert abs(sum(var) - 1.0) < 1e-9 and var == sorted(var, reverse=True)
    assert SC.pca_components_kept(var, 2 / 3) >= 1


def test_micro_cluster_query_places_every_point(spark, tmp_path, monkeypatch):
    from hearth.plans import q_clusters as Q
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=Q.DIM)], i % 3) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(Q, "MICRO_K", 5)
    got = Q.micro_cluster(spark, str(tmp_path)).collect()
    assert sum(r["size"] for r in got) == 60 and [r["n_misplaced"] for r in got] == [0] * len(got)
    z, _, _ = Q.scaled_embeddings(spark, str(tmp_path))
    assign, centres = Q.CL.micro_cluster(z, id_col="vec_id", vec="z", k=5, seed=1)
    swapped = assign.withColumn("micro_id", (assign.micro_id + 1) % 5)
    row = Q._misplaced(z.select("vec_id", "z"), swapped, centres.select("micro_id", "centre"), id_col="vec_id", vec="z",
                       cluster="micro_id", centre="centre").first()
    assert row["n_points"] == 60 and row["n_misplaced"] > 50


def test_micro_cluster_query_counts_every_placed_point(spark, tmp_path, monkeypatch):
    from hearth.plans import q_clusters as Q
    rng = np.random.default_rng(4)
    # far groups, of which one has rows without an id and one rows of one id
    rows = [([None, 7, i][i % 3], [float(v) for v in rng.normal(size=Q.DIM) + 50 * (i % 3)], i % 3) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(Q, "MICRO_K", 3)
    got = Q.micro_cluster(spark, str(tmp_path)).collect()
    assert [(r["size"], r["n_points"], r["n_misplaced"]) for r in got] == [(20, 20, 0)] * 3
    # against centres of which one is wrong, its points are misplaced
    real = Q.CL.micro_cluster

    def off(df, **how):
        assign, centres = real(df, **how)
        least = centres.agg(Q.F.min("micro_id")).first()[0]
        return assign, centres.withColumn("centre", Q.F.when(centres.micro_id == least, Q.F.transform("centre", lambda x: x + 1000.0)).otherwise(
            Q.F.col("centre")))
    monkeypatch.setattr(Q.CL, "micro_cluster", off)
    got = Q.micro_cluster(spark, str(tmp_path)).collect()
    assert sum(r["n_points"] for r in got) == 60 and sorted(r["n_misplaced"] for r in got) == [0, 0, 20]
