"""Edge-row fixtures for the relational operators (worked by hand)."""

import datetime as dt

from pyspark.sql import functions as F

import pytest

from hearth.operators import relational as R


def test_pivot_counts_types_including_null(spark):
    credits = spark.createDataFrame(
        [(1, 0, 100.0, 12, 1000.0), (1, 0, 50.0, 24, 500.0), (1, 2, None, None, None),
         (2, None, 30.0, 6, 300.0), (2, 9, 10.0, 6, 100.0), (3, 1, 20.0, 10, 200.0)],
        "id_dossier long, type_credit int, mensualite double, nb_mensualite int, solde double")
    p = R.pivot_measures(R.credits_by_type(credits)).orderBy("id_dossier").collect()
    c1, c2, c3 = p
    assert c1["nombre_credits"] == 2 and c1["sum_mensualite_0"] == 150
    assert c1["moy_nb_mensualite_0"] == 18 and c1["sum_solde_0"] == 1500
    assert c1["sum_mensualite_2"] is None and c1["moy_nb_mensualite_2"] is None
    assert c2["nombre_credits"] == 2
    assert all(c2[f"{m}_{t}"] is None for m in ("sum_mensualite", "moy_nb_mensualite", "sum_solde")
               for t in range(6))
    assert c3["nombre_credits"] == 1 and c3["sum_mensualite_1"] == 20
    assert c3["moy_nb_mensualite_1"] == 10 and c3["sum_solde_1"] == 200


def test_latest_budget_keeps_one_row(spark):
    d = dt.date
    budget = spark.createDataFrame(
        [(1, 1, "Reel", d(2015, 1, 1)), (2, 1, "Reel", d(2016, 1, 1)), (3, 1, "Reel", d(2016, 1, 1)),
         (4, 1, "Impaye", d(2017, 1, 1)), (5, 2, None, d(2016, 1, 1)), (6, 3, "Reel", None),
         (7, None, "Reel", d(2016, 1, 1))],
        "id_budget long, id_dossier long, typ string, dat_budget date")
    b = R.exclude_like(budget, "typ", "Impaye")
    assert [r.id_budget for r in R.latest_per_key(b).collect()] == [3]
    assert [r.id_budget for r in R.latest_per_key_literal(b).collect()] == [3]
    assert sorted(r.id_budget for r in R.latest_rows(b).collect()) == [2, 3]


def test_null_ids_are_never_first_or_latest(spark):
    d = dt.date(2016, 1, 1)
    action = spark.createDataFrame([(None, 1, "a"), (11, 1, "b"), (12, 1, "c"), (None, 2, "d")],
                                   "id_action long, id_dossier long, objectfull string")
    assert [r.id_action for r in R.first_per_key(action).collect()] == [11]
    assert [r.id_action for r in R.min_ids_in(action, key="id_dossier", id_col="id_action").collect()] == [11]
    budget = spark.createDataFrame([(None, 1, "Reel", d), (None, 2, "Reel", d), (5, 2, "Reel", d)],
                                   "id_budget long, id_dossier long, typ string, dat_budget date")
    assert [r.id_budget for r in R.latest_per_key(budget).collect()] == [5]
    assert [r.id_budget for r in R.latest_per_key_literal(budget).collect()] == [5]


def test_uniqueness_audit_raises(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,), (None,)], "id int")
    with pytest.raises(ValueError, match="births.id is not unique"):
        R.require_unique(df, "id", "births")
    assert R.require_unique(df.where("id = 1 or id is null"), "id", "births").count() == 3


def test_not_like_may_ignore_case(spark):
    df = spark.createDataFrame([("Impaye",), ("IMPAYE",), ("Reel",), (None,)], "typ string")
    assert R.exclude_like(df, "typ", "Impaye").count() == 2
    assert [r.typ for r in R.exclude_like(df, "typ", "Impaye", ignore_case=True).collect()] == ["Reel"]


def test_first_action_includes_null_key(spark):
    action = spark.createDataFrame([(10, 1, "a"), (11, 1, "b"), (12, 2, "c"), (13, None, "d")],
                                   "id_action long, id_dossier long, objectfull string")
    assert sorted(r.id_action for r in R.first_per_key(action).collect()) == [10, 12, 13]
    assert sorted(r.id_action for r in
                  R.min_ids_in(action, key="id_dossier", id_col="id_action").collect()) == [10, 12, 13]


def test_star_join_drops_other_platform_keeps_missing_sides(spark):
    cases = spark.createDataFrame([(1, 100), (2, 200)], "id long, id_group long")
    partners = spark.createDataFrame([(100, "autre"), (200, "social")],
                                     "id_partenaire long, plateforme string")
    kept = R.keep_values(partners, "plateforme", ["bancaire", "social"])
    credits = spark.createDataFrame([], "id_dossier long, nombre_credits long")
    x = R.inner_dimension(cases, kept, left_key="id_group", right_key="id_partenaire",
                          dim_cols=["plateforme"])
    x = R.left_attach(x, "id", credits, "id_dossier").collect()
    assert len(x) == 1 and x[0]["id"] == 2 and x[0]["nombre_credits"] is None


def test_consistency_check(spark):
    df = spark.createDataFrame([(0, 1, "x"), (1, 1, "x"), (2, 1, "y"), (3, 1, "y"), (4, 1, "x"),
                                (5, 2, "z")], "o long, id long, inv string")
    keep = R.consistency_check(df, id_col="id", invariant_cols=["inv"], order_col="o")
    assert sorted(r.o for r in keep.collect()) == [0, 1, 3, 4, 5]
    strict = R.consistency_check(df, id_col="id", invariant_cols=["inv"], order_col="o",
                                 strict=True)
    assert sorted(r.o for r in strict.collect()) == [0, 1, 4, 5]


def test_age(spark):
    cases = spark.createDataFrame([(1, dt.date(2016, 5, 1)), (2, dt.date(2016, 5, 1))],
                                  "id long, date_ouverture date")
    births = spark.createDataFrame([(1, 1970), (2, 2020)], "id long, annee_naissance int")
    r = {x.id: x.age for x in R.attach_age(cases, births).collect()}
    assert r == {1: 46, 2: -4}


def test_merge_rare(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), ("c",), (None,)], "g string")
    out = sorted((r.g is None, r.g) for r in R.merge_rare(df, "g", floor=2,
                                                          merged_value="m").collect())
    assert [g for _, g in out] == ["a", "a", "a", "m", "m", None]


def test_row_audit(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    r = R.row_audit({"t": (df, "k")}).first()
    assert (r.n_rows, r.n_keys) == (3, 1)


def test_value_counts_skip_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "g string")
    assert {r.g: r.n for r in R.value_counts(df, "g").collect()} == {"a": 2}
    _ = F


def test_exclude_like_by_collation(spark):
    df = spark.createDataFrame([("Impaye",), ("IMPAYÉ",), ("impayés",), ("Réel",), (None,)], "typ string")
    left = lambda p, **kw: sorted(r.typ for r in R.exclude_like(df, "typ", p, **kw).collect())
    ci_ai = {"collation": "UNICODE_CI_AI"}
    assert left("Impaye", **ci_ai) == ["Réel", "impayés"] and left("impaye%", **ci_ai) == ["Réel"]
    assert left("%PAYÉ%", **ci_ai) == ["Réel"] and left("%el", **ci_ai) == ["IMPAYÉ", "Impaye", "impayés"]
    assert left("%", **ci_ai) == [] and left("Impaye") == ["IMPAYÉ", "Réel", "impayés"]
    with pytest.raises(ValueError):
        R.exclude_like(df, "typ", "Imp_ye", **ci_ai)


def test_rows_of_a_case_move_once_and_no_split_is_held_before(spark, monkeypatch):
    rows = [(i // 3 if i else None, i % 3, 1.5, 2, 4.0) for i in range(300)] + [(7, None, 1.0, 1, 1.0)]
    credits = spark.createDataFrame(rows, "id_dossier long, type_credit int, mensualite double, nb_mensualite int, solde double")
    pivot = R.pivot_measures(R.credits_by_type(credits))
    plan = pivot._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan
    assert {r["id_dossier"]: r["nombre_credits"] for r in pivot.collect()} == {
        None: 0, 0: 2, 7: 4, **{i: 3 for i in range(1, 100) if i != 7}}
    monkeypatch.setattr(R, "TASK_ROWS", 10)
    assert R.dealt_by_key(credits, "id_dossier").rdd.getNumPartitions() == 31
