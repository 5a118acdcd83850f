"""End-to-end flows on the case-file schema, wired from the operators.

A. ``build_extract`` + ``clean_dataset``: case tables -> one wide row per
   case -> clean, encoded, imputed dataset with indicators (+ mapping).
B. ``threshold_report``: global and per-adviser threshold rule.
C. ``evaluate_classifier``: out-of-fold scores, metrics, confusion, ROC.
D. ``segment_cases``: micro-clusters, Ward cut, refinement, description.

All steps are lazy DataFrame plans except where a value must be known to
continue (the stats of a scaler, a fitted model, an iterative round).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth import config as C
from hearth.operators import clusters as CL
from hearth.operators import evaluate as EV
from hearth.operators import features as FE
from hearth.operators import grids as GR
from hearth.operators import neighbors as NB
from hearth.operators import relational as R
from hearth.operators import scaling as SC
from hearth.operators import threshold as T
from hearth.session import cut_lineage


@dataclass
class CaseTables:
    dossier: DataFrame
    naissance: DataFrame
    credits: DataFrame
    action: DataFrame
    budget: DataFrame
    partenaire: DataFrame


@dataclass
class CleanConfig:
    charge_cols: Sequence[str] = tuple(C.CHARGE_COLUMNS)
    couples: Sequence[str] = tuple(C.COUPLE_SITUATIONS)
    impute_features: Sequence[str] | None = None  # default: all kept columns but sparse + id
    k: int = C.IMPUTE_NEIGHBOURS
    extra_keep: Sequence[str] = field(default_factory=tuple)


# --- A ----------------------------------------------------------------------------------------

def extract_columns() -> list[str]:
    """The 100 columns of the extract, in order."""
    case = list(C.CASE_COLUMNS)
    case.insert(case.index("id_group") + 1, "plateforme")
    pivot = [f"{m}_{t}" for m in C.CREDIT_MEASURES for t in C.CREDIT_TYPES]
    return case + ["age", "nombre_credits", *pivot, "typ", *C.BUDGET_COLUMNS, "dat_budget",
                   "objectfull"]


def build_extract(t: CaseTables, platforms: Sequence[str]) -> DataFrame:
    """The wide case record: cases with age, kept platforms only, credit
    pivot, latest budget (excluding the unpaid type) and first action.

    Every side is checked to be unique on its join key first (raises), so the
    record has one row for each case. Columns are taken by table: an amount
    comes from the budget also where the case table has a column of its name.
    """
    births = R.require_unique(t.naissance, "id", "naissance")
    partners = R.require_unique(t.partenaire.select("id_partenaire", "plateforme"),
                                "id_partenaire", "partenaire")
    R.require_unique(t.dossier, "id", "dossier")
    cases = R.attach_age(t.dossier, births)
    cases = R.inner_dimension(cases, R.keep_values(partners, "plateforme", platforms),
                              left_key="id_group", right_key="id_partenaire",
                              dim_cols=["plateforme"])
    cases = cases.select(*C.CASE_COLUMNS, "plateforme", "age")
    pivot = R.pivot_measures(R.credits_by_type(t.credits.where(F.col("id_dossier").isNotNull())))
    budget = R.exclude_like(t.budget, "typ", C.EXCLUDED_BUDGET_TYPE)
    budget = R.latest_per_key(budget, key="id_dossier", date_col="dat_budget",
                              id_col="id_budget")
    budget = budget.select("id_dossier", "typ", *C.BUDGET_COLUMNS, "dat_budget")
    action = R.first_per_key(t.action.where(F.col("id_dossier").isNotNull()),
                             key="id_dossier", order_col="id_action",
                             keep=["id_dossier", "objectfull"])
    x = R.left_attach(cases, "id", pivot, "id_dossier")
    x = R.left_attach(x, "id", budget, "id_dossier")
    x = R.left_attach(x, "id", action.drop("id_action"), "id_dossier")
    return x.select(*extract_columns())


def clean_dataset(extract: DataFrame, cfg: CleanConfig | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """Features, filters, encoding, plausibility nulling, neighbour
    imputation, indicators and the floor filter. Returns (clean, mapping)."""
    cfg = cfg or CleanConfig()
    # ~100 columns with many derived aliases: constraint inference is
    # exponential on such plans and buys nothing here
    extract.sparkSession.conf.set("spark.sql.constraintPropagation.enabled", "false")
    x = FE.create_features(extract, charge_cols=cfg.charge_cols)
    x = FE.filter_cases(x)
    keep = (C.OTHER_COLUMNS + C.CREDIT_DETAIL + C.CREDIT_TOTALS + C.BUDGET_COLUMNS
            + ["charges", "revenus_tot"] + list(cfg.extra_keep))
    x = FE.project(x, [c for c in dict.fromkeys(keep)])
    x = cut_lineage(x, "clean-filtered")
    # rules on labels come before encoding (housing, situation)
    x = FE.null_implausible(x)
    couple = F.col("situation").isin(list(cfg.couples))
    x = x.withColumn("__couple", couple)
    cats = [f.name for f in x.schema.fields if f.dataType.simpleString() == "string"]
    x, mapping = FE.encode_categories(x, cats)
    mapping = cut_lineage(mapping, "clean-mapping")
    x = FE.null_outliers(cut_lineage(x, "clean-encoded"))
    feats = cfg.impute_features or [c for c in x.columns
                                    if c not in C.SPARSE_COLUMNS + ["id", "__couple"]]
    x = NB.knn_impute(x, id_col="id", fill_cols=C.SPARSE_COLUMNS, feature_cols=feats, k=cfg.k)
    x = FE.add_indicators(x, couple=F.col("__couple")).drop("__couple")
    return FE.floor_filter(x), mapping


# --- B -----------------------------------------------------------------------------------------

def threshold_report(clean: DataFrame, *, adviser_floor: int = C.ADVISER_FLOOR, out_of_fold: bool = False
                     ) -> dict[str, DataFrame]:
    """Two-class rule on ``rav``: global fit, its accuracy and cross table;
    per-adviser fits after merging small advisers, and their accuracy (on the
    rows they were fitted on, as in the source; ``out_of_fold`` adds the
    accuracy under thresholds fitted on the other folds)."""
    x = clean.withColumn("orientation", F.when(F.col("orientation") == C.CLASS_MIDDLE,
                                               F.lit(C.CLASS_ABOVE))
                         .otherwise(F.col("orientation")))
    fit = T.fit_threshold(x, score="rav", label="orientation")
    pred = x.withColumn("pred", T.threshold_predict("rav", fit.first()["threshold"]))
    merged = R.merge_rare(x, "id_user", floor=adviser_floor, merged_value=C.MERGED_ADVISER)
    fits = T.fit_threshold(merged, score="rav", label="orientation", group_by=["id_user"])
    per = T.apply_thresholds(merged, fits, score="rav", group_by=["id_user"])
    more = {}
    if out_of_fold:
        folds = cut_lineage(EV.stratified_folds(merged, id_col="id", label="orientation"), "adviser-folds")
        held = T.fit_threshold_held_out(folds, score="rav", label="orientation", fold="fold", n_folds=C.N_FOLDS,
                                        group_by=["id_user"])
        scored = T.apply_thresholds(folds, held, score="rav", group_by=["id_user", "fold"])
        more = {"accuracy_by_adviser_out_of_fold": T.accuracy(scored, "pred", "orientation")}
    return {**more, "fit": fit, "accuracy": T.accuracy(pred, "pred", "orientation"),
            "crosstab": T.crosstab_long(pred, "pred", "orientation"),
            "fits_by_adviser": fits, "accuracy_by_adviser": T.accuracy(per, "pred", "orientation")}


# --- C -----------------------------------------------------------------------------------------

def evaluate_classifier(clean: DataFrame, candidates: Mapping[str, EV.Fitter] | None = None,
                        models: Sequence[str] = tuple(EV.MODELS), grids: Mapping[str, Mapping] | None = None
                        ) -> dict[str, DataFrame]:
    """Out-of-fold evaluation of every candidate (by default the chosen
    parameters of every model; ``grids`` for whole grids from few fits): train and test accuracy by fold, AUC, the best
    candidate by AUC, and its confusion matrix and ROC."""
    x = clean.withColumn("y", F.when(F.col("orientation") == C.CLASS_BELOW, 1).otherwise(0))
    feats = [c for c in x.columns if c not in ("orientation", "id", "id_user", "y")]
    x = cut_lineage(EV.stratified_folds(x, id_col="id", label="y"), "folds")
    imp: list = []
    if candidates is None:
        out = GR.compare_grids(x, GR.chosen_grids(models) if grids is None else grids, features=feats, id_col="id",
                               importances=imp)
    else:
        out = EV.compare_candidates(x, candidates, id_col="id")
    if imp:
        out["importances"] = EV.mean_importances(imp, clean.sparkSession)
    return out


# --- D -----------------------------------------------------------------------------------------

def segment_cases(clean: DataFrame, *, k: int = C.MICRO_CLUSTERS, height: float = C.WARD_CUT,
                  small_floor: int = C.SMALL_CLUSTER_FLOOR) -> dict[str, DataFrame]:
    """Scale all columns but the id, micro-clusters, Ward cut, small clusters
    merged, refined k-means, centres back in units, description."""
    cols = [c for c in clean.columns if c != "id"]
    stats = SC.fit_scaler(clean, cols)
    z = SC.standardize(clean, stats).select("id", NB.as_vector(cols).alias("z"))
    _, centres = CL.micro_cluster(z, id_col="id", vec="z", k=k, seed=C.MICRO_SEED)
    member, linkage = CL.ward_cut(centres, height=height)
    labelled = CL.label_clusters(member, floor=small_floor, small_id=C.SMALL_CLUSTER_ID)
    pts = centres.join(labelled, "micro_id")
    init = CL.cluster_centroids(pts, cluster="cluster", vec="centre", dim=len(cols))
    assign, final = CL.refine_kmeans(pts, init, id_col="micro_id", vec="centre")
    means = [stats[c][0] for c in cols]
    sds = [stats[c][1] for c in cols]
    export = centres.join(assign, "micro_id").select(
        "micro_id", SC.inverse_array("centre", means, sds).alias("centre"), "cluster")
    wide = export.select(*[F.col("centre")[i].alias(c) for i, c in enumerate(cols)], "cluster")
    return {"linkage": linkage, "centres": final.select(
        "cluster", SC.inverse_array("centre", means, sds).alias("centre")),
        "export": export, "description": CL.describe_clusters(wide, cluster="cluster", cols=cols,
                                                              limit=C.VTEST_LIMIT),
        "sizes": CL.cluster_sizes(export, "cluster")}
