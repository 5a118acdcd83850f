"""Whole parameter grids from few fits.

* boosted trees: one run fits every (fold, row sample, gamma) together, and its
  stages are all numbers of rounds;
* forests: one forest of the most trees and the greatest depth for each fold;
  its first n trees are a forest of n, and a tree stopped at depth d is a tree
  of depth d, since splits are found from the top down;
* neighbours: one search of the greatest k for each distance, all folds at
  once; every smaller k and both weightings follow from the ranks;
* SVM: one run of Newton passes fits every (fold, C, gamma).

A task writes the scores of all a model's candidates as one array a row, and
none of folds that are not asked for; the long form below is read from those.
Scores are out of fold, ``candidate, id, fold, label, score, is_train``; with
``train_side`` the rows that a fold's model was trained on come as well, ``fold``
being the one held out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth import config as C
from hearth.operators import evaluate as EV
from hearth.operators import neighbors as NB
from hearth.operators import scaling as SC
from hearth.operators.boosting import BoostParams, boost
from hearth.operators.kernel import SvmParams, fit_svm
from hearth.operators.threshold import roc_auc, roc_curve
from hearth.session import cut_lineage, delete_path, shared_path

BOOST_BINS = 64


def together(spark, jobs: Sequence[Callable]) -> list:
    """The results of ``jobs`` in their order, submitted from a thread each:
    the stages of one small fit leave most of a cluster idle."""
    with ThreadPoolExecutor(max(len(jobs), 1)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [r.result() for r in running]


def name_of(model: str, params: Mapping) -> str:
    return f"{model}({','.join(f'{k}={v}' for k, v in params.items())})"


def _sided(scores: DataFrame, candidate: Column, held: Column, train_side: bool, *, id_col: str, label: str,
           fold_col: str) -> DataFrame:
    out = scores.select(candidate.alias("candidate"), F.col(id_col).cast("long").alias("id"), held.cast("int").alias("fold"),
                        F.col(label).cast("int").alias("label"), F.col("score").cast("double").alias("score"),
                        (F.col(fold_col) != held).alias("is_train"))
    return out if train_side else out.where(~F.col("is_train"))


def _scored(df: DataFrame, scores: Callable[[np.ndarray, int], np.ndarray], folds: Sequence[int], *, features: Sequence[str],
            id_col: str, label: str, fold_col: str, train_side: bool) -> DataFrame:
    """``id, own, label, held, scores``: each row with what ``scores(features,
    fold)`` gives it (rows x candidates) for its own fold if that is one of
    ``folds``, or for all of them with ``train_side``. Written once."""
    names = ["id", "own", "label", "held", "scores"]

    def run(batches):
        for batch in batches:
            own = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1)
            for f in folds:
                at = np.arange(len(own)) if train_side else np.flatnonzero(own == f)
                if not len(at):
                    continue
                found = scores(x[at], f)
                some = batch.select([0, 1, 2]).take(pa.array(at))
                ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(at), f, np.int32)), pa.ListArray.from_arrays(
                    ends, pa.array(np.ascontiguousarray(found).ravel(), from_pandas=True))], names=names)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(fold_col).cast("int").alias("own"),
                     F.col(label).cast("int").alias("label"), *[F.col(c).cast("double") for c in features])
    if not train_side:
        rows = rows.where(F.col("own").isin(*folds))
    return cut_lineage(rows.mapInArrow(run, "id long, own int, label int, held int, scores array<double>"), "fold-scores")


def _long(wide: DataFrame, names: Sequence[str], train_side: bool) -> DataFrame:
    """A row for each of the ``names`` that the arrays of ``wide`` hold scores of."""
    each = wide.select("id", "own", "label", "held", F.posexplode("scores").alias("i", "score"))
    return _sided(each, F.array(*map(F.lit, names))[F.col("i")], F.col("held"), train_side, id_col="id", label="label", fold_col="own")


def boosted_grid(df: DataFrame, grid: Mapping[str, Sequence], *, features: Sequence[str], id_col: str, label: str = "y",
                 fold_col: str = "fold", n_folds: int = C.N_FOLDS, train_side: bool = False, max_bins: int = BOOST_BINS) -> DataFrame:
    """Every combination of ``grid``; the values of ``rounds`` are stages of one fit."""
    rounds = list(grid["rounds"])
    points = EV.param_grid({k: v for k, v in grid.items() if k != "rounds"})
    models = [(p, f) for p in points for f in range(n_folds)]
    fit = boost(df, [BoostParams(rounds=max(rounds), fold=f, **p) for p, f in models], features=features, id_col=id_col,
                label=label, fold_col=fold_col, max_bins=max_bins)
    names = [name_of("gbt", {"rounds": r, **p}) for p in points for r in rounds]

    def scores(x, f):
        return fit.stage_scores(x, range(f, len(models), n_folds), rounds).reshape(len(x), -1)
    wide = _scored(df, scores, range(n_folds), features=features, id_col=id_col, label=label, fold_col=fold_col, train_side=train_side)
    return _long(wide, names, train_side)


def svm_grid(df: DataFrame, grid: Mapping[str, Sequence], *, features: Sequence[str], id_col: str, label: str = "y",
             fold_col: str = "fold", n_folds: int = C.N_FOLDS, train_side: bool = False) -> DataFrame:
    points = EV.param_grid(grid)
    fit = fit_svm(df, [SvmParams(fold=f, **p) for p in points for f in range(n_folds)], features=features, id_col=id_col,
                  label=label, fold_col=fold_col)
    wide = _scored(df, fit.margins, range(n_folds), features=features, id_col=id_col, label=label, fold_col=fold_col,
                   train_side=train_side)
    return _long(wide, [name_of("svm", p) for p in points], train_side)


class Forest:
    """The trees of a fitted forest as arrays, read from its saved form."""

    def __init__(self, spark, model):
        path = shared_path(spark, "forest")
        model.write().save(path)
        node = F.col("nodeData")
        nodes = spark.read.parquet(f"{path}/data").select(
            "treeID", node["id"].alias("id"), node["split"]["featureIndex"].alias("feature"),
            F.coalesce(F.get(node["split"]["leftCategoriesOrThreshold"], 0), F.lit(0.0)).alias("cut"),
            node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["impurityStats"].alias("share")).toArrow()
        delete_path(spark, path)
        at = {c: nodes.column(c).to_numpy() for c in ("treeID", "id", "feature", "cut", "left", "right")}
        order = np.lexsort((at["id"], at["treeID"]))
        share = nodes.column("share").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        feature, cut, left, right = (at[c][order] for c in ("feature", "cut", "left", "right"))
        first = np.flatnonzero(np.diff(at["treeID"][order], prepend=-1))[1:]
        self.trees = [*zip(*(np.split(v, first) for v in (
            feature, cut, np.stack([left, right], axis=1), share[:, 1] / share.sum(axis=1))))]

    def shares(self, x: np.ndarray, sizes: Sequence[int], depths: Sequence[int]) -> np.ndarray:
        """Probability of class 1: depths x sizes x rows."""
        out, total = np.zeros((len(depths), len(sizes), len(x))), np.zeros((len(depths), len(x)))
        for n, (feature, cut, child, share) in enumerate(self.trees, 1):
            node, row = np.zeros(len(x), int), np.arange(len(x))
            for depth in range(max(depths) + 1):
                if depth in depths:
                    total[list(depths).index(depth)] += share[node]
                inner = child[node, 0] >= 0
                below = child[node, np.where(x[row, np.maximum(feature[node], 0)] <= cut[node], 0, 1)]
                node = np.where(inner, below, node)
            if n in sizes:
                out[:, list(sizes).index(n)] = total / n
        return out


def forest_grid(df: DataFrame, grid: Mapping[str, Sequence], *, features: Sequence[str], id_col: str, label: str = "y",
                fold_col: str = "fold", n_folds: int = C.N_FOLDS, train_side: bool = False, seed: int = 1,
                importances: list | None = None) -> DataFrame:
    sizes, depths, features = list(grid["numTrees"]), list(grid["maxDepth"]), list(features)
    names = [name_of("rf", {"numTrees": n, "maxDepth": d}) for d in depths for n in sizes]
    df = cut_lineage(df.select(id_col, fold_col, label, *features), "folds")

    def fit(f):
        train = EV._assemble(df.where(F.col(fold_col) != f), features).persist()
        model = RandomForestClassifier(featuresCol="__x", labelCol=label, seed=seed, featureSubsetStrategy="sqrt",
                                       impurity="gini", numTrees=max(sizes), maxDepth=max(depths)).fit(train)
        train.unpersist()
        forest = Forest(df.sparkSession, model)

        shares = [(str(f), c, float(v) * 100.0) for c, v in zip(features, model.featureImportances.toArray())]
        wide = _scored(df, lambda x, _: forest.shares(x, sizes, depths).reshape(len(names), -1).T, [f], features=features,
                       id_col=id_col, label=label, fold_col=fold_col, train_side=train_side)
        return shares, _long(wide, names, train_side)

    fits = together(df.sparkSession, [partial(fit, f) for f in range(n_folds)])
    if importances is not None:
        for shares, _ in fits:
            importances.extend(shares)
    return reduce(DataFrame.unionByName, [scores for _, scores in fits])


def neighbour_grid(df: DataFrame, grid: Mapping[str, Sequence], *, features: Sequence[str], id_col: str, label: str = "y",
                   fold_col: str = "fold", n_folds: int = C.N_FOLDS, train_side: bool = False,
                   rank_digits: int | None = None) -> DataFrame:
    """Features are scaled by each fold's training rows. A row stands in the
    space of its own fold as a query and in those of the others as a donor; one
    more coordinate keeps the spaces far apart and adds nothing inside one."""
    df = cut_lineage(df.select(id_col, fold_col, label, *features), "folds")
    spaces = []
    for f in range(n_folds):
        stats = SC.fit_scaler(df.where(F.col(fold_col) != f), features)
        spaces.append(F.struct(F.lit(f).alias("space"), NB.as_vector(
            [*[(F.col(c).cast("double") - m) / s for c, (m, s) in stats.items()], F.lit(1e9 * f)]).alias("v")))
    placed = cut_lineage(df.select(id_col, fold_col, label, F.explode(F.array(*spaces)).alias("at")).select(
        (F.col(id_col) * n_folds + F.col("at.space")).alias("q"), F.col(id_col).cast("long").alias("id"), F.col(fold_col).alias("own"),
        F.col(label).alias("label"), F.col(label).cast("double").alias("__y"), "at.*"), "fold-spaces")
    out_of_fold, in_fold = F.col("space") == F.col("own"), F.col("space") != F.col("own")
    # a donor stands once in each other space, under an id of its own
    known = placed.where(in_fold).select(F.col("q").alias("d"), "v", "__y")
    ks, weights = list(grid["k"]), list(grid["weights"])

    def scored(p):
        names = [name_of("knn", {"k": k, "weights": w, "p": p}) for k in ks for w in weights]
        ask, at_place = placed.where(out_of_fold), None
        if train_side and p == 1 and weights == ["distance"] and rank_digits is None:
            at_place = cut_lineage(_of_place(placed.where(in_fold), ks), "at-place")
            ask = ask.unionByName(placed.join(at_place.where(F.exists("scores", lambda s: s.isNull())).select("q"), "q", "left_semi"))
            at_place = at_place.where(F.forall("scores", lambda s: s.isNotNull()))
        elif train_side:
            ask = placed
        near = cut_lineage(NB.nearest_neighbours(ask.select("q", "v"), known, k=max(ks), q_id="q", q_vec="v", d_id="d", d_vec="v",
                                                 carry=["__y"], metric="minkowski", p=p, rank_digits=rank_digits), "neighbours")
        y, dist, aggs = F.col("__y"), F.col("dist"), []
        for k in ks:
            for w in weights:
                here = F.col("rank") <= k
                if w == "uniform":
                    value = F.avg(F.when(here, y))
                else:
                    zero = F.avg(F.when(here & (dist == 0), y))
                    value = F.coalesce(zero, F.try_divide(F.sum(F.when(here & (dist > 0), y / dist)),
                                                          F.sum(F.when(here & (dist > 0), 1.0 / dist))))
                aggs.append(value)
        scores = near.groupBy("q").agg(F.array(*aggs).alias("scores")).join(
            placed.select("q", "id", "own", "label", F.col("space").alias("held")), "q").drop("q")
        if at_place is not None:
            scores = scores.unionByName(at_place.drop("q"))
        return _long(cut_lineage(scores, "fold-scores"), names, train_side)

    return reduce(DataFrame.unionByName, together(df.sparkSession, [partial(scored, p) for p in grid["p"]]))


def _of_place(rows: DataFrame, ks: Sequence[int]) -> DataFrame:
    """The distance-weighted votes of rows that are donors themselves: the mean
    label of the ``k`` first donors at their place, as these are at distance zero
    and so the only ones that count. NULL where none of them has a label, or the
    place is unknown: there the nearest others decide."""
    place = Window.partitionBy("space", "v")
    nth = rows.withColumn("nth", F.dense_rank().over(place.orderBy("q")))
    real = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    votes = [F.when(real, F.avg(F.when(F.col("nth") <= k, F.col("__y"))).over(place)) for k in ks]
    return nth.select("q", "id", "own", "label", F.col("space").alias("held"), F.array(*votes).alias("scores"))


GRID_SCORES = {"rf": forest_grid, "gbt": boosted_grid, "svm": svm_grid, "knn": neighbour_grid}


def grid_scores(df: DataFrame, grids: Mapping[str, Mapping] | None = None, *, features: Sequence[str], id_col: str,
                label: str = "y", fold_col: str = "fold", n_folds: int = C.N_FOLDS, train_side: bool = False,
                importances: list | None = None) -> DataFrame:
    """Scores of every combination of every model's grid; the arrays that they are read from are written."""
    def scored(m, g):
        more = {"importances": importances} if m == "rf" else {}
        return GRID_SCORES[m](df, g, features=features, id_col=id_col, label=label, fold_col=fold_col,
                              n_folds=n_folds, train_side=train_side, **more)

    parts = together(df.sparkSession, [partial(scored, m, g) for m, g in (EV.GRIDS if grids is None else grids).items()])
    return reduce(DataFrame.unionByName, parts)


def chosen_grids(models: Sequence[str] = tuple(EV.MODELS)) -> dict[str, dict]:
    """A grid of one point for each model: the parameters that the source chose."""
    return {m: {k: [v] for k, v in EV.MODELS[m].items()} for m in models}


def _right() -> Column:
    """Whether the class of a score is the label."""
    cut = F.when(F.col("candidate").startswith("svm"), 0.0).otherwise(0.5)
    return ((F.col("score") > cut).cast("int") == F.col("label")).cast("int")


def grid_results(scores: DataFrame) -> DataFrame:
    """``candidate, accuracy, train_accuracy, auc``: a row for each candidate,
    all at once (train accuracy NULL without that side)."""
    side = lambda train: F.avg(F.when(F.col("is_train") == train, _right()))
    right = scores.groupBy("candidate").agg(side(False).alias("accuracy"), side(True).alias("train_accuracy"))
    # scores move under a number, not under a name many times as long
    code = F.xxhash64("candidate").alias("code")
    auc = roc_auc(scores.where(~F.col("is_train")).select(code, "score", "label"), score="score", label="label", positive=1,
                  group_by=["code"])
    return right.select("*", code).join(auc, "code").select("candidate", "accuracy", "train_accuracy", "auc")


def compare_grids(df: DataFrame, grids: Mapping[str, Mapping] | None = None, *, features: Sequence[str], id_col: str,
                  label: str = "y", fold_col: str = "fold", n_folds: int = C.N_FOLDS, train_side: bool = True,
                  importances: list | None = None) -> dict[str, DataFrame]:
    """What :func:`evaluate.compare_candidates` returns, of whole grids and
    from few fits."""
    scores = grid_scores(df, grids, features=features, id_col=id_col, label=label, fold_col=fold_col, n_folds=n_folds,
                         train_side=train_side, importances=importances)
    results = cut_lineage(grid_results(scores), "grid-results")
    best = EV.best_candidate(results, "auc")
    name, agg = best.first()["candidate"], [F.avg(_right()).alias("accuracy"), F.count(F.lit(1)).alias("n")]
    accuracy = scores.groupBy("candidate", "is_train", "fold").agg(*agg).unionByName(
        scores.groupBy("candidate", "is_train").agg(*agg).withColumn("fold", F.lit(None).cast("int")))
    held = scores.where(~F.col("is_train")).drop("is_train")
    won = held.where(F.col("candidate") == name)
    return {"scores": held, "accuracy": accuracy, "results": results, "best": best,
            "confusion": EV.confusion(won, threshold=EV.score_cut(name)),
            "roc": roc_curve(won, score="score", label="label", positive=1)}
