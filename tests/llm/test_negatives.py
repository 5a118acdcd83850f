import duckdb
import numpy as np
import pytest

from hearth.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = []
    for i, v, label in rows:
        if i is None or label is None or v is None or None in v or not np.isfinite(v).all():
            continue
        ok.append((i, (label + 1) % 10 if i % 7 == 0 else label,
                   tuple(int(x) for x in np.floor(256 * np.array(np.array(v, np.float32), np.float64)))))
    ok = sorted(set(ok))
    out = []
    for a, la, va in ok:
        if a % 100:
            continue
        score = sorted((-sum(x * y for x, y in zip(va, vb)), b, lb) for b, lb, vb in ok if b != a and len(va) == len(vb))
        for p, pos, _ in [s for s in score if s[2] == la][:5]:
            fits = [s for s in score if s[2] != la and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, pos, r, n, -p, -s) for r, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    r = N.integer_rows(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(x) for x in N.mine_negatives(r, N.anchors_of(r), **kw).collect())


def some_rows(n, d, seed, labels=4, step=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.lognormal(size=(n, 1), sigma=0.4)
    return [(i * step, [float(np.float32(c)) for c in v], int(c)) for i, (v, c) in enumerate(zip(x, rng.integers(0, labels, n)))]


@pytest.mark.parametrize("cells,block", [(1 << 19, 8192), (600, 3)])
def test_against_brute_force(spark, cells, block):
    rows = some_rows(700, 9, 1, step=5)
    want = brute(rows)
    assert len(want) > 200
    assert mined(spark, rows, cells_per_shard=cells, queries_per_block=block) == want


def test_ties_and_few_rows(spark):
    rng = np.random.default_rng(7)
    # few values: many equal scores
    rows = [(i, [float(c) for c in rng.integers(0, 2, 6)], int(rng.integers(0, 3))) for i in range(400)]
    assert mined(spark, rows, cells_per_shard=300) == brute(rows)
    assert mined(spark, rows[:101:25]) == brute(rows[:101:25])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = some_rows(60, 5, 3, labels=2, step=10)
    rows += [(100, None, 1), (200, [1.0, None, 1.0, 1.0, 1.0], 0), (300, [nan] * 5, 0), (400, [inf] * 5, 1),
             (500, [1.0] * 5, None), (None, [1.0] * 5, 1), (1000, [], 1), (1001, [], 0), (1100, [1.0, 2.0], 1),
             (1102, [2.0, 2.0], 1), (1103, [2.0, 1.5], 0), (1200, [0.0] * 5, 1), (1201, [0.0] * 5, 0)]
    rows += rows[:30]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, rows[:1]) == []
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", shard int, block string")
    r = N.integer_rows(wide)
    assert sorted(tuple(x) for x in N.mine_negatives(r, N.anchors_of(r)).collect()) == brute(rows)


def test_index_leaves_out_and_prunes():
    rng = np.random.default_rng(5)
    scale = np.linspace(3, 0.05, 32)
    x = np.floor(256 * rng.normal(size=(3000, 32)) * scale)
    q = np.floor(256 * rng.normal(size=(20, 32)) * scale)
    score = q @ x.T
    t = np.sort(score, axis=1)[:, -8]
    index = N.SuffixIndex(x, t.min(), np.sqrt((q ** 2).sum(axis=1).max()))
    query, row, s = index.at_least(q, t)
    assert {(a, b, c) for a, b, c in zip(query, row, s)} == {(a, b, score[a, b]) for a, b in zip(*np.nonzero(score >= t[:, None]))}
    assert (index.kept < len(index.edges) - 1).any()
    assert index.touched < 0.8 * x.size


def test_sql_over_the_table(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    out = N.op11_hard_negatives(spark, "/root/testdata/sf0.1")
    want = con.sql(N._SQL)
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect())) == sorted(want.fetchall())
