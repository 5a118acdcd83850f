"""Feature expressions against hand-worked rows."""

from pyspark.sql import functions as F

from hearth.functions import features as X
from hearth.operators import features as FE


def test_row_sum_null_skipping(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, None, None)], "a double, b double, c double")
    assert [r.s for r in df.select(X.row_sum(["a", "b", "c"]).alias("s")).collect()] == [3.0, None]


def test_recode_and_backfill(spark):
    df = spark.createDataFrame([("mediation", 1), ("mediation", 2), ("xyz", 1), ("mediation", None)],
                               "orientation_old string, orientation int")
    codes = {"surendettement": 4, "accompagnement": 2, "mediation": 3}
    old = X.map_values("orientation_old", codes, 0)
    out = [r.o for r in df.select(X.backfill_label("orientation", old).alias("o")).collect()]
    assert out == [3, 2, 1, None]


def test_filters_and_nulling(spark):
    df = spark.createDataFrame(
        [(1, 1, 10.0, 5.0, 10.0), (2, 2, 10.0, 5.0, 10.0), (3, 4, 10.0, 5.0, 80000.0),
         (4, 5, 10.0, 5.0, 10.0), (5, 2, 0.0, 5.0, 10.0), (6, 4, 10.0, 5.0, 80001.0),
         (7, 3, 10.0, None, 10.0)],
        "id long, orientation int, charges double, revenus_tot double, sum_mensualite double")
    assert sorted(r.id for r in FE.filter_cases(df).collect()) == [2, 3]
    ages = spark.createDataFrame([(17, -1), (18, 0), (90, 10), (91, 11)],
                                 "age int, personne_charges int")
    ages = ages.withColumn("sum_mensualite", F.lit(1.0))
    r = FE.null_outliers(ages).collect()
    assert [x.age for x in r] == [None, 18, 90, None]
    assert [x.personne_charges for x in r] == [None, 0, 10, None]


def test_null_implausible_keeps_missing_housing(spark):
    df = spark.createDataFrame([("locataire", 0.0), ("proprietaire", 0.0), ("locataire", 300.0),
                                (None, 0.0)], "logement string, loyer double")
    r = [x.loyer for x in FE.null_implausible(df, cols=["loyer"]).collect()]
    assert r == [None, 0.0, 300.0, 0.0]


def test_labels_and_rounding(spark):
    df = spark.createDataFrame([(2, 0.5), (3, 0.51), (4, 1.5)], "o int, s double")
    r = df.select(X.binary_label("o").alias("y"), X.round_half_even("s").alias("c")).collect()
    assert [x.y for x in r] == [0, 0, 1] and [x.c for x in r] == [0, 1, 2]


def test_indicators(spark):
    df = spark.createDataFrame([("marie", 2), ("celibataire", 0), ("marie", None)],
                               "situation string, personne_charges int")
    u = [round(r.u, 6) if r.u is not None else None
         for r in df.select(X.consumption_units("situation", "personne_charges").alias("u")).collect()]
    assert u == [2.1, 1.0, None]
    one = spark.createDataFrame([(2000.0, 900.0, 200.0, 1.8)], "i double, c double, m double, u double")
    assert abs(one.select(X.disposable_per_unit("i", "c", "m", "u")).first()[0] - 500.0) < 1e-9
    r = spark.createDataFrame([(100.0, 50.0), (100.0, 0.0), (0.0, 0.0), (-5.0, 0.0), (None, 50.0)],
                              "i double, b double")
    assert [x.r for x in r.select(X.income_ratio("i", "b").alias("r")).collect()] == \
        [2.0, 0.0, None, None, None]


def test_encode_categories(spark):
    df = spark.createDataFrame([("b",), ("0",), (None,), ("a",)], "c string")
    enc, mapping = FE.encode_categories(df, ["c"])
    assert [r.c for r in enc.collect()] == [2, 0, 0, 1]
    m = {r.label: r.code for r in mapping.collect()}
    assert m == {"None": 0, "a": 1, "b": 2}


def test_quality_report(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "x double")
    r = {x.rule: (x.n_rows, x.pct) for x in FE.quality_report(df, {"neg": F.col("x") < 0}).collect()}
    assert r["neg"][0] == 1 and abs(r["neg"][1] - 100 / 3) < 1e-5
