import math

import duckdb
import numpy as np
import pytest

from hearth.llm import rotcodes as C
from tests.llm.helpers import union_find

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=C.COSINE):
    """``{(vec_id, label, vector): (n_links, component_id, kept)}`` of unlike rows."""
    seen, todo = {}, []
    for i, v, label in rows:
        v = None if v is None else tuple(None if c is None else float(np.float32(c)) for c in v)
        seen[(i, label, repr(v))] = v
    for key, v in seen.items():
        if key[0] is not None and key[1] is not None and v and None not in v and np.isfinite(v).all() and any(v):
            todo.append((key, np.array(v) / np.linalg.norm(v)))
    links = [(a, b) for x, (a, va) in enumerate(todo) for b, vb in todo[x + 1:]
             if a[1] == b[1] and len(va) == len(vb) and va @ vb >= cosine]
    index = {k: n for n, k in enumerate(seen)}
    root = union_find(index.values(), [(index[a], index[b]) for a, b in links])
    n, least = dict.fromkeys(seen, 0), {}
    for a, b in links:
        n[a], n[b] = n[a] + 1, n[b] + 1
    for k, x in index.items():
        least[root[x]] = min(least.get(root[x], math.inf), math.inf if k[0] is None else k[0])
    out = []
    for k, x in index.items():
        c = None if k[0] is None else least[root[x]]
        out.append((k[0], n[k], c, k[0] == c))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, C.near_vectors(df, **kw).collect()), key=str)


def clusters(seed, groups, d=24, noise=(0.0, 0.02, 0.05, 0.08)):
    """Groups of vectors around common directions, spread below and above the link angle."""
    rng = np.random.default_rng(seed)
    rows = []
    for g, size in enumerate(groups):
        centre = rng.normal(size=d)
        for _ in range(size):
            v = centre * rng.uniform(0.5, 4) + rng.normal(size=d) * rng.choice(noise) * np.linalg.norm(centre)
            rows.append((len(rows) * 3, [float(np.float32(c)) for c in v], g % 3))
    order = rng.permutation(len(rows))
    return [(int(rows[i][0]), rows[j][1], rows[j][2]) for i, j in enumerate(order)]


@pytest.mark.parametrize("bucket", [256, 8])
def test_groups_against_brute_force(spark, bucket, monkeypatch):
    rows = clusters(1, [90, 60, 40, 25, 10, 5, 3, 2, 2] + [1] * 150)
    want = brute(rows)
    assert sum(n for _, n, _, _ in want) > 4000
    assert found(spark, rows, bucket=bucket) == want


def test_balls_and_blocks_against_brute_force(spark, monkeypatch):
    for name, value in (("HEAVY", 4), ("PIECE", 60), ("BLOCK", 40), ("STRIPE", 16)):
        monkeypatch.setattr(C, name, value)
    rows = clusters(2, [150, 120, 30, 8] + [1] * 60, noise=(0.01, 0.03, 0.045))
    rows += [(9000 + i, rows[0][1], rows[0][2]) for i in range(50)]  # copies
    assert found(spark, rows, bucket=16) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0),
            (8, [0.0, 0.0, 0.0], 0), (9, [1.0, None, 3.0], 0), (10, [1.0, nan, 3.0], 0), (11, [1.0, inf, 3.0], 0),
            (None, v, 0), (12, [1.0, 2.0], 0), (13, [1.0, 2.1], 0), (14, [-1.0, -2.0, -3.0], 0), (0, [3e38, 3e38, 0.0], 0),
            (15, [1e-30, 1e-30, 0.0], 0), (1, [9.0, -1.0, 0.0], 0), (16, [-0.0, 1.0, 0.0], 2), (17, [0.0, 1.0, 0.0], 2)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, rows[:1]) == brute(rows[:1])
    wide = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", node long, ball string, n double")
    assert sorted(map(tuple, C.near_vectors(wide).collect()), key=str) == brute(rows)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(3)
    d, cos = 64, 0.93
    o = C.units(rng.normal(size=(4000, d)))
    across = rng.normal(size=(4000, d))
    across -= (across * o).sum(1, keepdims=True) * o
    q = cos * o + math.sqrt(1 - cos ** 2) * C.units(across)
    codes, factors = C.encode(o)
    assert np.allclose(np.linalg.norm(C.rotate(o, 1), axis=1), 1)
    assert np.allclose((C.rotate(o, 2) * C.rotate(q, 2)).sum(1), cos)
    signs = np.unpackbits(codes, axis=1).astype(float) * 2 - 1
    estimate = (signs * C.rotate(q, 0)).sum(1) / (math.sqrt(d) * factors)
    assert abs(estimate.mean() - cos) < 0.003
    assert (np.abs(estimate - cos) <= np.sqrt(1 - factors ** 2) / factors * math.sqrt(1 - cos ** 2) + 1e-9).all()
    # every planted pair is found, and nearly all unlike pairs are settled by their codes
    x = np.concatenate((o[:500], q[:500]))
    codes, factors = C.encode(x)
    every = np.arange(1000)
    a, b, s, computed = C.close_pairs(x, codes, factors, np.zeros(1000), every, every, cos - 1e-9)
    assert {(i, i + 500) for i in range(500)} <= set(zip(a.tolist(), b.tolist()))
    assert computed < 0.01 * 1000 * 999 / 2


def test_tables_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    o = C.units(rng.normal(size=(3000, 64)))
    across = rng.normal(size=(3000, 64))
    across -= (across * o).sum(1, keepdims=True) * o
    q = C.COSINE * o + math.sqrt(1 - C.COSINE ** 2) * C.units(across)
    for most in (200, 5000, 100_000):
        bits, tables = C.plan_tables(most, C.COSINE)
        share = (C.segments(o, bits, tables) == C.segments(q, bits, tables)).any(axis=1).mean()
        assert share >= 0.998


def test_sql_over_a_table_with_copies(spark, tmp_path):
    rows = clusters(5, [40, 20, 6, 2] + [1] * 200, d=64, noise=(0.0, 0.01, 0.03))
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    out, want = C.op12_vector_near_dedup(spark, str(tmp_path)), con.sql(C._SQL)
    assert out.columns == want.columns
    order = lambda r: sorted(r, key=str)
    assert order(map(tuple, out.collect())) == order(want.fetchall()) == brute(rows)
