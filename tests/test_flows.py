"""End-to-end flows on a small inline case-file fixture."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth import config as C
from hearth.operators import evaluate as EV
from hearth.operators import relational as R
from hearth.plans import flows as P
from hearth.session import cut_lineage


def _tables(spark, n=80, seed=0):
    rng = np.random.default_rng(seed)
    dossier, births, credits, action, budget = [], [], [], [], []
    for i in range(n):
        orient = int(rng.choice([1, 2, 3, 4]))
        dossier.append((i, dt.date(2016, 1 + i % 12, 1), int(i % 3), int(rng.integers(1, 5)),
                        str(rng.choice(["ouvrier", "cadre"])),
                        str(rng.choice(["locataire", "proprietaire"])),
                        str(rng.choice(["marie", "celibataire", "pacs"])), orient,
                        str(rng.choice(["mediation", "surendettement", "accompagnement"])),
                        int(rng.integers(0, 4)), int(rng.integers(0, 2)), int(rng.integers(0, 2))))
        births.append((i, int(rng.integers(1940, 1995))))
        for j in range(int(rng.integers(1, 4))):
            credits.append((i * 10 + j, i, int(rng.integers(0, 6)), float(rng.integers(50, 900)),
                            int(rng.integers(6, 60)), float(rng.integers(500, 20000))))
        action.append((i * 2, i, "a"))
        action.append((i * 2 + 1, i, "b"))
        for j in range(2):
            amounts = [float(rng.integers(0, 1500)) for _ in C.BUDGET_COLUMNS]
            amounts[0] = float(rng.integers(800, 3000))
            budget.append((i * 2 + j, i, "Reel", dt.date(2015 + j, 1, 1), *amounts))
    known = ["id", "date_ouverture", "id_group", "id_user", "profession", "logement", "situation",
             "orientation", "orientation_old", "personne_charges", "retard_facture", "retard_pret"]
    others = [c for c in C.CASE_COLUMNS if c not in known]
    # a phone number of the case, which is no amount
    dossier = [(*row, *[0] * len(others), 555000 + row[0]) for row in dossier]
    dossier_s = ("id long, date_ouverture date, id_group long, id_user int, profession string, "
                 "logement string, situation string, orientation int, orientation_old string, "
                 "personne_charges int, retard_facture int, retard_pret int, "
                 + ", ".join(f"{c} int" for c in others) + ", tel_fixe long")
    budget_s = ("id_budget long, id_dossier long, typ string, dat_budget date, "
                + ", ".join(f"{c} double" for c in C.BUDGET_COLUMNS))
    return P.CaseTables(
        dossier=spark.createDataFrame(dossier, dossier_s),
        naissance=spark.createDataFrame(births, "id long, annee_naissance int"),
        credits=spark.createDataFrame(credits, "id_credit long, id_dossier long, type_credit int, "
                                      "mensualite double, nb_mensualite int, solde double"),
        action=spark.createDataFrame(action, "id_action long, id_dossier long, objectfull string"),
        budget=spark.createDataFrame(budget, budget_s),
        partenaire=spark.createDataFrame([(0, "social"), (1, "bancaire"), (2, "autre")],
                                         "id_partenaire long, plateforme string"))


PLATFORMS = ["bancaire", "social"]


def test_flows_end_to_end(spark):
    t = _tables(spark)
    extract = P.build_extract(t, PLATFORMS)
    ids = [r.id for r in extract.select("id").collect()]
    assert len(ids) == len(set(ids)) and all(i % 3 != 2 for i in ids)
    assert len(extract.columns) == 100 and extract.columns[:4] == ["id", "etat", "id_group", "plateforme"]
    phones = {r.id_dossier: r.tel_fixe for r in R.latest_per_key(t.budget).collect()}
    assert {r.id: r.tel_fixe for r in extract.select("id", "tel_fixe").collect()} == {i: phones[i] for i in ids}
    clean, mapping = P.clean_dataset(extract)
    rows = clean.collect()
    assert rows and all(r.charges > 400 and r.revenus_tot > 400 for r in rows)
    assert {"u_c", "rav", "imc"} <= set(clean.columns)
    assert mapping.where("column = 'situation'").count() >= 2
    rep = P.threshold_report(clean, adviser_floor=5, out_of_fold=True)
    assert rep["accuracy_by_adviser_out_of_fold"].first().n == len(rows)
    assert rep["fit"].count() == 1 and rep["accuracy"].first().n == len(rows)
    seg = P.segment_cases(clean, k=8, height=1e9, small_floor=1)
    assert seg["sizes"].count() >= 1 and seg["export"].count() >= 1


def test_classifier_flow(spark):
    clean, _ = P.clean_dataset(P.build_extract(_tables(spark, n=120, seed=3), PLATFORMS))
    clean = cut_lineage(clean.where("orientation != 3"))
    n = clean.count()
    feats = ["age", "charges", "revenus_tot", "sum_mensualite", "rav"]
    imp = []
    some = {"rf": EV.model("rf", feats, id_col="id", importances=imp, numTrees=5, maxDepth=3),
            "knn": EV.model("knn", feats, id_col="id", k=5)}
    out = P.evaluate_classifier(clean, some)
    scores = out["scores"].toPandas()
    assert sorted(scores.candidate.unique()) == ["knn", "rf"]
    assert all(len(g) == n and g.id.is_unique for _, g in scores.groupby("candidate"))
    results = {r.candidate: r for r in out["results"].collect()}
    assert set(results) == {"rf", "knn"} and results["knn"].train_accuracy == 1.0
    best = out["best"].first()
    assert best.auc == max(r.auc for r in results.values())
    assert {r.candidate for r in out["confusion"].collect()} == {best.candidate}
    assert out["confusion"].toPandas().n.sum() == n and out["roc"].count() > 1
    sides = {(r.candidate, r.fold, r.is_train) for r in out["accuracy"].collect()}
    assert len(sides) == 2 * 6 * 2


def test_unknown_features_raise(spark):
    extract = P.build_extract(_tables(spark), PLATFORMS)
    broken = extract.withColumn("epargne", F.when(F.col("id") % 2 == 0, F.col("epargne")))
    with pytest.raises(Exception, match="epargne"):
        P.clean_dataset(broken)[0].collect()
