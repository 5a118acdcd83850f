"""Supervised evaluation: reproducible splits, out-of-fold scoring with Spark
ML models, and result tables (importances, confusion, best candidate).

Folds and the hold-out split are functions of (id, seed) only — an md5 rank
within each class — so they do not depend on partitioning and an
independent engine reproduces them. Ranks are distributed running counts,
never a window over a whole class.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth import config as C
from hearth.operators import neighbors as NB
from hearth.operators import scaling as SC
from hearth.operators.boosting import BoostParams, boost
from hearth.operators.kernel import LANDMARKS, SvmParams, fit_svm
from hearth.operators.prefix import running_sum
from hearth.session import cut_lineage


def _hash_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def _hash_bucket(h: str) -> Column:
    """The first three hex digits of an md5: 4,096 even parts of its order."""
    return F.conv(F.substring(h, 1, 3), 16, 10).cast("int")


# --- V1 V2 -----------------------------------------------------------------------------------

def stratified_folds(df: DataFrame, *, id_col: str, label: str, n_folds: int = C.N_FOLDS,
                     seed: int = C.FOLD_SEED, out: str = "fold") -> DataFrame:
    """Fold = (rank within class by md5(id:seed), id) mod n_folds: classes are
    spread evenly (fold sizes differ by at most one per class)."""
    x = df.withColumn("__h", _hash_key(id_col, seed)).withColumn("__one", F.lit(1))
    r = running_sum(x, order_by=["__h", id_col], sums=["__one"], partition_by=[label],
                    inclusive=False, bucket=_hash_bucket("__h"), prefix="__rk")
    return r.withColumn(out, F.pmod(F.col("__rk__one"), F.lit(n_folds)).cast("int")).drop(
        "__h", "__one", "__rk__one")


def holdout_split(df: DataFrame, *, id_col: str, test_fraction: float = C.HOLDOUT_TEST_FRACTION,
                  seed: int = C.HOLDOUT_SEED, out: str = "is_test") -> DataFrame:
    """Shuffled split with exactly ceil(test_fraction * n) test rows: the
    first rows in md5(id:seed) order."""
    n = df.count()
    n_test = math.ceil(test_fraction * n)
    x = df.withColumn("__h", _hash_key(id_col, seed)).withColumn("__one", F.lit(1))
    r = running_sum(x, order_by=["__h", id_col], sums=["__one"], inclusive=False,
                    bucket=_hash_bucket("__h"), prefix="__rk")
    return r.withColumn(out, F.col("__rk__one") < n_test).drop("__h", "__one", "__rk__one")


# --- V3 ---------------------------------------------------------------------------------------

def param_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the listed values, as a list of dicts."""
    combos = [{}]
    for name, values in grid.items():
        combos = [dict(c, **{name: v}) for c in combos for v in values]
    return combos


# --- model factories (V5 V6 V7 V8) --------------------------------------------------------------

Scorer = Callable[[DataFrame], DataFrame]
Fitter = Callable[[DataFrame, str], Scorer]
"""(training rows, fold label) -> a function that adds ``score`` to rows."""


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__x",
                           handleInvalid="keep").transform(df)


def random_forest(features: Sequence[str], *, label: str = "y", seed: int = 1,
                  importances: list | None = None, **params) -> Fitter:
    """Random forest probability of class 1 (Gini, sqrt features per split)."""
    p = dict(C.RF_PARAMS)
    p.update(params)

    def fit(train, fold):
        tr = _assemble(train, features).persist()
        m = RandomForestClassifier(featuresCol="__x", labelCol=label, seed=seed,
                                   featureSubsetStrategy="sqrt", impurity="gini",
                                   numTrees=p["numTrees"], maxDepth=p["maxDepth"]).fit(tr)
        tr.unpersist()
        if importances is not None:
            importances.extend((fold, f, float(v) * 100.0)
                               for f, v in zip(features, m.featureImportances.toArray()))
        return lambda rows: m.transform(_assemble(rows, features)).withColumn(
            "score", vector_to_array("probability")[1])
    return fit


def boosted_trees(features: Sequence[str], *, id_col: str, label: str = "y", seed: int = 1, **params) -> Fitter:
    """Second-order boosted trees (logistic loss) probability of class 1."""
    p = BoostParams(**{**C.GBT_PARAMS, "seed": seed, **params})

    def fit(train, fold):
        fitted = boost(train, [p], features=features, id_col=id_col, label=label)
        return lambda rows: fitted.score(rows).drop("model", "stage")
    return fit


def rbf_svm(features: Sequence[str], *, id_col: str, label: str = "y", C: float = 1.0, gamma: float = 0.01,
            landmarks: int = LANDMARKS) -> Fitter:
    """RBF-kernel SVM on Nystroem landmarks; score = margin."""
    def fit(train, fold):
        fitted = fit_svm(train, [SvmParams(C=C, gamma=gamma)], features=features, id_col=id_col, label=label,
                         landmarks=landmarks)
        return lambda rows: fitted.score(rows).drop("model")
    return fit


def neighbour_vote(features: Sequence[str], *, id_col: str, label: str = "y", k: int = 125,
                   weights: str = "distance", p: float = 1.0, rank_digits: int | None = None
                   ) -> Fitter:
    """k-nearest-neighbour vote on features standardised with the training
    fold's statistics (Minkowski distance of order ``p``)."""
    feats = list(features)
    metric = "manhattan" if p == 1 else ("euclidean" if p == 2 else "minkowski")

    def fit(train, fold):
        stats = SC.fit_scaler(train, feats)
        vec = NB.as_vector([((F.col(c).cast("double") - m) / s) for c, (m, s) in stats.items()])
        tr = train.withColumn("__v", vec).select(id_col, "__v", label)

        def score(rows):
            sc = NB.knn_classify(rows.withColumn("__v", vec).select(id_col, "__v"), tr, k=k,
                                 id_col=id_col, vec="__v", label=label, positive=1,
                                 weights=weights, metric=metric, p=p, rank_digits=rank_digits)
            return rows.join(sc, id_col, "left")
        return score
    return fit


#: The models that are compared, with the parameters that the source chose.
MODELS = {"rf": C.RF_PARAMS, "gbt": C.GBT_PARAMS, "svm": C.SVM_PARAMS, "knn": C.KNN_PARAMS}
#: Their grids.
GRIDS = {"rf": C.RF_GRID, "gbt": C.GBT_GRID, "svm": C.SVM_GRID, "knn": C.KNN_GRID}


def model(name: str, features: Sequence[str], *, id_col: str, label: str = "y",
          importances: list | None = None, **params) -> Fitter:
    """The fitter of a model by name, with its chosen parameters unless given."""
    p = {**MODELS[name], **params}
    if name == "rf":
        return random_forest(features, label=label, importances=importances, **p)
    if name == "gbt":
        return boosted_trees(features, id_col=id_col, label=label, **p)
    if name == "svm":
        return rbf_svm(features, id_col=id_col, label=label, **p)
    return neighbour_vote(features, id_col=id_col, label=label, **p)


def score_cut(candidate: str) -> float:
    """The score above which a candidate predicts class 1: 0 for margins
    (candidates named after the SVM), else one half."""
    return 0.0 if candidate.startswith("svm") else 0.5


# --- V4 -----------------------------------------------------------------------------------------

def cross_validate(df: DataFrame, fitter: Fitter, *, id_col: str, label: str = "y",
                   fold_col: str = "fold", n_folds: int = C.N_FOLDS, candidate: str = "model",
                   train_side: bool = True) -> DataFrame:
    """Fit on every fold but one and score the held-out fold, and the training
    rows as well with ``train_side``: ``(candidate, id, fold, label, score,
    is_train)``, ``fold`` being the held-out one.

    The folds are written once and every fit reads that table, so each row is
    scored by exactly one model that has not seen it. The loop is over folds
    (a handful of Spark jobs), never over rows."""
    df = cut_lineage(df, "folds")
    parts = []
    for f in range(n_folds):
        score = fitter(df.where(F.col(fold_col) != f), str(f))
        for is_train in (False, True) if train_side else (False,):
            rows = df.where(F.col(fold_col) != f if is_train else F.col(fold_col) == f)
            parts.append(score(rows).select(
                F.lit(candidate).alias("candidate"), F.col(id_col).alias("id"), F.lit(f).alias("fold"),
                F.col(label).alias("label"), F.col("score").cast("double").alias("score"),
                F.lit(is_train).alias("is_train")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oof_predict(df: DataFrame, fitter: Fitter, *, id_col: str, label: str = "y",
                fold_col: str = "fold", n_folds: int = C.N_FOLDS, candidate: str = "model"
                ) -> DataFrame:
    """One out-of-fold score per row: ``(candidate, id, fold, label, score)``."""
    return cross_validate(df, fitter, id_col=id_col, label=label, fold_col=fold_col,
                          n_folds=n_folds, candidate=candidate, train_side=False).drop("is_train")


def compare_candidates(df: DataFrame, candidates: Mapping[str, Fitter], *, id_col: str,
                       label: str = "y", fold_col: str = "fold", n_folds: int = C.N_FOLDS
                       ) -> dict[str, DataFrame]:
    """Every candidate out of fold. Returns ``scores`` (all rows, both sides),
    ``accuracy`` (by candidate, fold and side), ``results`` (a row for each
    candidate: accuracy, train accuracy, exact AUC), and of the candidate with
    the largest AUC its ``best`` row, ``confusion`` and ``roc``. The loop runs
    over candidates and folds, never over rows."""
    from hearth.operators.threshold import roc_auc, roc_curve
    rows, held, sides = [], {}, []
    for name, fitter in candidates.items():
        scores = cut_lineage(cross_validate(df, fitter, id_col=id_col, label=label,
                                            fold_col=fold_col, n_folds=n_folds, candidate=name), "scores")
        held[name] = scores.where(~F.col("is_train")).drop("is_train")
        side = fold_accuracy(scores, threshold=score_cut(name), by=("is_train",))
        sides.append(side)
        pooled = {r.is_train: r.accuracy for r in side.where(F.col("fold").isNull()).collect()}
        auc = roc_auc(held[name], score="score", label="label", positive=1).first()["auc"]
        rows.append((name, pooled.get(False), pooled.get(True), auc))
    # one row per candidate (bounded by the grid)
    results = df.sparkSession.createDataFrame(
        rows, "candidate string, accuracy double, train_accuracy double, auc double")
    best = best_candidate(results, "auc")
    name = best.first()["candidate"]
    accuracy, scores = sides[0], list(held.values())[0]
    for s in sides[1:]:
        accuracy = accuracy.unionByName(s)
    for s in list(held.values())[1:]:
        scores = scores.unionByName(s)
    return {"scores": scores, "accuracy": accuracy, "results": results, "best": best,
            "confusion": confusion(held[name], threshold=score_cut(name)),
            "roc": roc_curve(held[name], score="score", label="label", positive=1)}


def grid_candidates(name: str, grid: Mapping[str, Sequence], features: Sequence[str], *,
                    id_col: str, label: str = "y") -> dict[str, Fitter]:
    """A fitter for every combination of a model's grid, by its parameters."""
    return {f"{name}({','.join(f'{k}={v}' for k, v in p.items())})":
            model(name, features, id_col=id_col, label=label, **p) for p in param_grid(grid)}


def grid_search(df: DataFrame, make_fitter: Callable[[dict], Fitter], grid: Mapping[str, Sequence],
                *, id_col: str, label: str = "y", fold_col: str = "fold",
                n_folds: int = C.N_FOLDS) -> DataFrame:
    """Out-of-fold evaluation of every combination of ``grid``: one row per
    candidate (its parameters as text) with pooled accuracy on both sides and
    exact AUC; pick the winner with :func:`best_candidate`."""
    named = {",".join(f"{k}={v}" for k, v in p.items()): make_fitter(p) for p in param_grid(grid)}
    return compare_candidates(df, named, id_col=id_col, label=label, fold_col=fold_col,
                              n_folds=n_folds)["results"]


# --- V11 V12 T1 T3 ------------------------------------------------------------------------------

def fold_accuracy(scores: DataFrame, *, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy per fold and pooled (NULL fold), class = score rounded half to
    even (score > 0.5 for probabilities; for margins pass threshold 0)."""
    pred = (F.col("score") > threshold).cast("int")
    eq = (pred == F.col("label")).cast("int")
    agg = [F.avg(eq).alias("accuracy"), F.count(F.lit(1)).alias("n")]
    pooled = scores.groupBy("candidate", *by).agg(*agg).withColumn("fold", F.lit(None).cast("int"))
    return scores.groupBy("candidate", *by, "fold").agg(*agg).unionByName(pooled)


def confusion(scores: DataFrame, *, names: Mapping[int, str] | None = None,
              threshold: float = 0.5) -> DataFrame:
    """Real x predicted counts (long form) with class names (0 -> 2, 1 -> 4
    in the source's codes)."""
    names = names or {0: C.ORIENTATION_NAMES[2], 1: C.ORIENTATION_NAMES[4]}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    pred = (F.col("score") > threshold).cast("int")
    x = scores.select("candidate", m[F.col("label")].alias("real"), m[pred].alias("predicted"))
    return x.groupBy("candidate", "real", "predicted").agg(F.count(F.lit(1)).alias("n"))


def mean_importances(rows: list[tuple[str, str, float]], spark, *, n_folds: int = C.N_FOLDS,
                     top: int = 10) -> DataFrame:
    """Importances (fold, feature, value) averaged over folds, largest first."""
    df = spark.createDataFrame(rows, "fold string, feature string, importance double")
    m = df.groupBy("feature").agg((F.sum("importance") / n_folds).alias("importance"))
    return m.orderBy(F.desc("importance"), "feature").limit(top)


def best_candidate(results: DataFrame, metric: str) -> DataFrame:
    """The candidate with the largest ``metric`` (ties: first by name)."""
    return results.orderBy(F.desc(metric), "candidate").limit(1)

