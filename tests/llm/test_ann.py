import numpy as np
import pytest

from hearth.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows
          if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            s = sorted({(-float((v * w).sum()), j) for j, w in ok if j != i and len(w) == len(v)})
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def found(spark, rows, k, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(A.search(df, df.where("vec_id % 20 = 0"), k, **kw).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def same(got, want):
    assert set(got) == {q for q in want if want[q]}
    for q in got:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("scale", [False, True])
def test_factor_one_is_exact(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12)) * (rng.lognormal(size=(1500, 1)) if scale else 1)
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    same(found(spark, rows, 7, rows_per_shard=400, queries_per_block=40), brute(rows, 7))


def test_smaller_factors_compare_less():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 6)) * 5
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 6))
    tree = A.VantageTree(x, leaf=32)
    exact, seen = tree.search(x[:200], 10, 1.0)
    some, fewer = tree.search(x[:200], 10, 0.7)
    assert fewer.mean() < 0.8 * seen.mean() < len(x)
    order = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert (exact == order).all()
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(some, order)])
    assert 0.5 < recall <= 1


def test_edges(spark):
    same_vec = [1.0, 2.0, 0.5]
    rows = [(i, same_vec) for i in range(60)] + [(100, [0.0, 0.0, 0.0]), (120, None), (140, [1.0, None, 2.0]),
            (160, [float("nan"), 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0]), (None, [9.0, 9.0, 9.0]),
            (200, [3.0, 1.0, 1.0]), (200, [3.0, 1.0, 1.0]), (220, [1.0, 1.0]), (240, [])]
    got = found(spark, rows, 20)
    same(got, brute(rows, 20))
    assert [v for v, _ in got[0]] == [200, *range(1, 20)] and [v for v, _ in got[200]] == list(range(20))
    assert found(spark, rows[:1], 20) == {}
    assert found(spark, rows[60:61], 20) == {}


@pytest.mark.parametrize("values,dim", [((0, 1), 16), ((-1, 0, 1), 5), ((0, 0, 0, 1), 12)])
def test_ties_of_many_unlike_vectors(spark, values, dim):
    rng = np.random.default_rng(dim)
    x = rng.choice(values, (1200, dim))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    same(found(spark, rows, 20, rows_per_shard=500), brute(rows, 20))


def test_query_over_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    out = {}
    for r in sorted(A.op9_nearest(spark, "/root/testdata/sf0.001").collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    same(out, brute(rows, 20))
