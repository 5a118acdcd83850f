"""The running sum far above any sample size, with a payload column, however
Spark plans its exchanges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.operators import evaluate as EV
from hearth.operators import threshold as T
from hearth.operators.prefix import bucket_bounds, bucket_of, dense_codes, running_sum

N = 400_000


@pytest.fixture(params=[(True, 8), (False, 31)], ids=str)
def conf(spark, request):
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.exchange.reuse", str(request.param[0]).lower())
    spark.conf.set("spark.sql.shuffle.partitions", request.param[1])
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(N).select(
        "id", (F.xxhash64("id") / 2.0 ** 63).alias("s"), F.lit(1).alias("one"),
        (F.pmod(F.hash("id"), F.lit(3)) == 0).cast("int").alias("g"),
        F.concat(F.lit("payload "), F.col("id").cast("string")).alias("payload"))


def test_ranks_and_sums(spark, conf, rows):
    got = running_sum(rows, order_by=["s", "id"], sums=["one", "id"], partition_by=["g"], prefix="c_").toPandas()
    assert len(got) == N and got.id.is_unique
    for _, part in got.groupby("g"):
        part = part.sort_values(["s", "id"])
        assert (part.c_one.to_numpy() == np.arange(1, len(part) + 1)).all()
        assert (part.c_id.to_numpy() == part.id.cumsum().to_numpy()).all()
    assert (got.payload == "payload " + got.id.astype(str)).all()


def test_descending_and_exclusive(spark, conf, rows):
    got = running_sum(rows, order_by=["s"], descending=True, inclusive=False, sums=["one"], prefix="c_").toPandas()
    assert (got.sort_values("s", ascending=False).c_one.to_numpy() == np.arange(N)).all()


def test_holdout_is_exact(spark, conf, rows):
    h = EV.holdout_split(rows, id_col="id").toPandas()
    assert len(h) == N and h.id.is_unique and h.is_test.sum() == math.ceil(0.25 * N)


def test_folds_written_one_by_one_hold_every_id_once(spark, conf, rows):
    f = EV.stratified_folds(rows, id_col="id", label="g")
    parts = [f.where(F.col("fold") == k).select("id", "g").toPandas() for k in range(5)]
    ids = np.concatenate([p.id for p in parts])
    assert len(ids) == N == len(np.unique(ids))
    for g in (0, 1):
        sizes = [(p.g == g).sum() for p in parts]
        assert max(sizes) - min(sizes) <= 1


def test_auc_and_roc(spark, conf, rows):
    x = rows.withColumn("y", (F.col("s") + F.rand(7) > 0.4).cast("int"))
    x = spark.createDataFrame(x.select("s", "y", "payload").toPandas())
    p = x.toPandas()
    rank = p.s.rank()
    pos, neg = (p.y == 1).sum(), (p.y == 0).sum()
    want = (rank[p.y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
    assert abs(T.roc_auc(x, score="s", label="y").first()["auc"] - want) < 1e-12
    roc = T.roc_curve(x, score="s", label="y").toPandas().sort_values("tp")
    assert roc.tp.max() == pos and roc.fp.max() == neg and (roc.sort_values(["tp", "fp"]).fp.diff().dropna() >= 0).all()


def test_codes_are_dense(spark, conf, rows):
    c = dense_codes(rows, "payload").toPandas().sort_values("payload")
    assert (c.code.to_numpy() == np.arange(N)).all()


def test_one_exchange_of_the_rows(spark, rows, capsys):
    running_sum(rows, order_by=["s"], sums=["one"]).explain()
    plan = capsys.readouterr().out
    moved = [line for line in plan.splitlines() if "Exchange" in line and "partial" not in line]
    # the rows, the combined totals, and the totals' own window
    assert len(moved) <= 3 and "rangepartitioning" not in plan


@pytest.mark.parametrize("buckets", [2, 3, 8, 31, 200, 999])
def test_bounds_are_found_by_halving(spark, buckets):
    df = spark.range(2000).select((F.pmod(F.xxhash64("id"), F.lit(500)) - 9).alias("a"),
                                  F.when(F.col("id") % 7 > 0, F.pmod(F.hash("id"), F.lit(9)).cast("string")).alias("b"))
    bounds = bucket_bounds(df, ["a", "b"], buckets)
    got = df.select("a", "b", bucket_of(df, ["a", "b"], bounds).alias("n")).collect()
    low = lambda t: (t[0], t[1] is not None, t[1] or "")
    assert all(r.n == sum(low(b) <= low((r.a, r.b)) for b in bounds) for r in got)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", None), (None, 4)], "g string, x int")
    got = running_sum(df, order_by=["x"], sums=["x"], partition_by=["g"]).collect()
    assert sorted((str(r.g), r.x or 0, r.cum_x) for r in got) == [
        ("None", 1, 1), ("None", 2, 3), ("None", 4, 7), ("a", 0, 0), ("a", 3, 3)]
    assert running_sum(df.limit(0), order_by=["x"], sums=["x"]).collect() == []
