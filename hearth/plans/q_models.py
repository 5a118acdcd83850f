"""Supervised-evaluation queries on document features (documents joined to
labels; label = quality). Model scores depend on Spark ML's randomised
fitting, so these are checked on rows and invariants; the splits are
checked against SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth import config as C
from hearth.operators import evaluate as EV
from hearth.operators import features as FE
from hearth.operators import grids as GR
from hearth.operators import threshold as T
from hearth.plans.registry import query
from hearth.plans.tables import dbl, lng, table
from hearth.session import cut_lineage

FEATURES = ["s", "ratio", "n_words", "n_distinct", "n_chars", "lang"]


def doc_features(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    words = F.split(F.col("text"), " ")
    x = docs.join(labels, "doc_id", "inner").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"),
        (F.size(F.array_distinct(words)) * F.lit(1.0) / F.size(words)).alias("s"),
        (F.lit(1.0) / F.size(F.array_distinct(words))).alias("ratio"),
        F.size(words).cast("double").alias("n_words"),
        F.size(F.array_distinct(words)).cast("double").alias("n_distinct"),
        F.col("quality").cast("int").alias("y"))
    enc, _ = FE.encode_categories(x, ["lang"])
    enc = enc.withColumn("lang", F.col("lang").cast("double"))
    return EV.stratified_folds(enc, id_col="doc_id", label="y", n_folds=C.N_FOLDS,
                               seed=C.FOLD_SEED)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(doc_features(spark, d), "doc-features")


def _oof(spark: SparkSession, d: str, which: str, **how) -> DataFrame:
    """Out-of-fold scores of one model with its chosen parameters, all folds
    fitted together where the model allows it."""
    grid = GR.chosen_grids([which])[which]
    s = GR.GRID_SCORES[which](_features(spark, d), grid, features=FEATURES, id_col="doc_id", **how)
    return s.select(F.lit(which).alias("candidate"), "id", "fold", "label", "score")


def _checked_oof(spark: SparkSession, d: str, which: str) -> DataFrame:
    """Id, held-out fold, label and whether the score lies where that model's
    scores must (the scores themselves come from fits, which no SQL repeats)."""
    ok = (~F.isnan("score") if which == "svm" else F.col("score").between(0, 1))
    return _oof(spark, d, which).select("candidate", "id", "fold", "label", F.coalesce(ok, F.lit(False)).alias("score_ok"))


SQL_FOLDS = f"""
f AS (SELECT doc_id, quality, text, (row_number() OVER (PARTITION BY quality
        ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{C.FOLD_SEED}'), doc_id) - 1) % {C.N_FOLDS} AS fold
      FROM documents JOIN labels USING (doc_id))"""


def _sql_oof(which: str) -> str:
    return f"""WITH {SQL_FOLDS}
SELECT '{which}' AS candidate, CAST(doc_id AS BIGINT) AS id, CAST(fold AS INTEGER) AS fold,
       CAST(quality AS INTEGER) AS label, TRUE AS score_ok FROM f"""


@query("holdout_split", sql=f"""
WITH d AS (SELECT doc_id FROM documents JOIN labels USING (doc_id)),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{C.HOLDOUT_SEED}'), doc_id) - 1 AS rk,
              COUNT(*) OVER () AS n FROM d)
SELECT CAST(doc_id AS BIGINT) AS doc_id, rk < ceil({C.HOLDOUT_TEST_FRACTION} * n) AS is_test FROM r
""")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id").join(
        table(spark, d, "labels").select("doc_id"), "doc_id")
    h = EV.holdout_split(x, id_col="doc_id")
    return h.select(lng("doc_id").alias("doc_id"), "is_test")


@query("stratified_folds", sql=f"""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus,
       CAST((row_number() OVER (PARTITION BY o_orderstatus
             ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':{C.FOLD_SEED}'), o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM orders
""")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    f = EV.stratified_folds(o, id_col="o_orderkey", label="o_orderstatus")
    return f.select(lng("o_orderkey").alias("o_orderkey"), "o_orderstatus", "fold")


@query("rf_oof_folds", sql=_sql_oof("rf"))
def rf_oof_folds(spark: SparkSession, d: str) -> DataFrame:
    """Every row once, in its fold, with a score in the model's range."""
    return _checked_oof(spark, d, "rf")


@query("rf_oof")
def rf_oof(spark: SparkSession, d: str) -> DataFrame:
    """Random forest (120 trees, depth 10), out-of-fold probabilities."""
    return _oof(spark, d, "rf")


@query("gbt_oof_folds", sql=_sql_oof("gbt"))
def gbt_oof_folds(spark: SparkSession, d: str) -> DataFrame:
    """Every row once, in its fold, with a score in the model's range."""
    return _checked_oof(spark, d, "gbt")


@query("gbt_oof")
def gbt_oof(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees (58 rounds, step 0.2, depth 4), out-of-fold probabilities."""
    return _oof(spark, d, "gbt")


@query("svm_oof_folds", sql=_sql_oof("svm"))
def svm_oof_folds(spark: SparkSession, d: str) -> DataFrame:
    """Every row once, in its fold, with a score in the model's range."""
    return _checked_oof(spark, d, "svm")


@query("svm_oof")
def svm_oof(spark: SparkSession, d: str) -> DataFrame:
    """RBF SVM on Nystroem landmarks, out-of-fold margins."""
    return _oof(spark, d, "svm")


@query("knn_oof_folds", sql=_sql_oof("knn"))
def knn_oof_folds(spark: SparkSession, d: str) -> DataFrame:
    """Every row once, in its fold, with a score in the model's range."""
    return _checked_oof(spark, d, "knn")


KNN_DIGITS = 9  # distances are ranked to this many digits, as in SQL
_SCALED = "s ratio n_words n_distinct n_chars lang".split()
_KNN_DIST = " + ".join(f"abs((q.{c} - t.m_{c}) / t.s_{c} - (d.{c} - t.m_{c}) / t.s_{c})" for c in _SCALED)


@query("knn_oof", sql=f"""
WITH w AS (SELECT doc_id, lang AS name, n_chars, quality, string_split(text, ' ') AS w FROM documents JOIN labels USING (doc_id)),
 l AS (SELECT name, dense_rank() OVER (ORDER BY name) - 1 AS code FROM (SELECT DISTINCT name FROM w)),
 x AS (SELECT doc_id, quality AS y, len(list_distinct(w)) * 1.0::DOUBLE / len(w) AS s, 1.0::DOUBLE / len(list_distinct(w)) AS ratio,
              CAST(len(w) AS DOUBLE) AS n_words, CAST(len(list_distinct(w)) AS DOUBLE) AS n_distinct,
              CAST(n_chars AS DOUBLE) AS n_chars, CAST(code AS DOUBLE) AS lang,
              (row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{C.FOLD_SEED}'), doc_id) - 1) % {C.N_FOLDS} AS fold
       FROM w JOIN l USING (name)),
 t AS (SELECT f.fold, {", ".join(f"AVG({c}) AS m_{c}, CASE WHEN STDDEV_POP({c}) = 0 THEN 1 ELSE STDDEV_POP({c}) END AS s_{c}" for c in _SCALED)}
       FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold GROUP BY f.fold),
 p AS (SELECT q.doc_id, q.fold, q.y AS label, d.y, {_KNN_DIST} AS dist, d.doc_id AS near
       FROM x q JOIN t ON q.fold = t.fold JOIN x d ON q.fold <> d.fold
       QUALIFY row_number() OVER (PARTITION BY q.doc_id ORDER BY round({_KNN_DIST}, {KNN_DIGITS}), d.doc_id) <= {C.KNN_PARAMS["k"]})
SELECT 'knn' AS candidate, CAST(doc_id AS BIGINT) AS id, CAST(fold AS INTEGER) AS fold, CAST(label AS INTEGER) AS label,
       ROUND(coalesce(avg(CASE WHEN dist = 0 THEN y END),
                      sum(CASE WHEN dist <> 0 THEN y / dist END) / sum(CASE WHEN dist <> 0 THEN 1.0 / dist END)), 6) AS score
FROM p GROUP BY ALL
""")
def knn_oof(spark: SparkSession, d: str) -> DataFrame:
    """125-neighbour distance-weighted Manhattan vote on train-fold-scaled
    features, out-of-fold probabilities."""
    return _oof(spark, d, "knn", rank_digits=KNN_DIGITS).withColumn("score", dbl("score", 6))


def _grid_scores(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores of every point of every model's grid."""
    return GR.grid_scores(_features(spark, d), features=FEATURES, id_col="doc_id")


@query("cv_metrics")
def cv_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and exact AUC, out of fold, of every point of every grid."""
    return GR.grid_results(_grid_scores(spark, d))


@query("best_params")
def best_params(spark: SparkSession, d: str) -> DataFrame:
    """The candidate with the best out-of-fold AUC, of all points of all grids."""
    return EV.best_candidate(GR.grid_results(_grid_scores(spark, d)), "auc")


@query("chosen_metrics")
def chosen_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Pooled accuracy on both sides and exact AUC of the parameters that the
    source chose for every model."""
    return GR.compare_grids(_features(spark, d), GR.chosen_grids(), features=FEATURES, id_col="doc_id")["results"]


@query("importances")
def importances(spark: SparkSession, d: str) -> DataFrame:
    """Random-forest importances (x100) averaged over folds, top 10."""
    rows: list = []
    GR.forest_grid(_features(spark, d), GR.chosen_grids(["rf"])["rf"], features=FEATURES, id_col="doc_id", importances=rows)
    return EV.mean_importances(rows, spark, n_folds=C.N_FOLDS, top=10)


# --- metrics of one given score, which SQL can repeat ---------------------------------------------

SQL_SCORED = f"""{SQL_FOLDS},
x AS (SELECT doc_id, quality AS label, fold,
             len(list_distinct(string_split(text, ' '))) * 1.0 / len(string_split(text, ' ')) AS score FROM f)"""


def _text_scores(spark: SparkSession, d: str) -> DataFrame:
    """The share of distinct words as the score of the documents' folds."""
    x = doc_features(spark, d)
    return x.select(F.lit("text").alias("candidate"), F.col("doc_id").alias("id"), "fold",
                    F.col("y").alias("label"), F.col("s").cast("double").alias("score"))


@query("confusion", sql=f"""
WITH {SQL_SCORED}
SELECT 'text' AS candidate, CASE label WHEN 0 THEN 'Accompagnement' ELSE 'Surendettement' END AS real,
       CASE WHEN score > 0.5 THEN 'Surendettement' ELSE 'Accompagnement' END AS predicted, COUNT(*) AS n
FROM x GROUP BY ALL
""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """Real x predicted (names)."""
    return EV.confusion(_text_scores(spark, d))


@query("fold_accuracy", sql=f"""
WITH {SQL_SCORED}
SELECT 'text' AS candidate, CAST(fold AS INTEGER) AS fold, ROUND(avg(CAST((score > 0.5) = (label = 1) AS INTEGER)), 9) AS accuracy,
       COUNT(*) AS n FROM x GROUP BY GROUPING SETS ((fold), ())
""")
def fold_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by fold and pooled."""
    a = EV.fold_accuracy(_text_scores(spark, d))
    return a.select("candidate", "fold", F.round("accuracy", 9).alias("accuracy"), "n")


@query("oof_roc_curve", sql=f"""
WITH {SQL_SCORED},
g AS (SELECT score, SUM(label) AS p, SUM(1 - label) AS q FROM x GROUP BY score),
t AS (SELECT SUM(p) AS tp, SUM(q) AS tq FROM g),
c AS (SELECT score, SUM(p) OVER (ORDER BY score DESC) AS tp, SUM(q) OVER (ORDER BY score DESC) AS fp FROM g
      UNION ALL SELECT NULL, 0, 0)
SELECT ROUND(score, 9) AS threshold, CAST(c.tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       ROUND(c.tp / t.tp, 9) AS tpr, ROUND(fp / t.tq, 9) AS fpr FROM c, t
""")
def oof_roc_curve(spark: SparkSession, d: str) -> DataFrame:
    """ROC points."""
    r = T.roc_curve(_text_scores(spark, d), score="score", label="label", positive=1)
    return r.select(dbl("threshold", 9).alias("threshold"), "tp", "fp", dbl("tpr", 9).alias("tpr"),
                    dbl("fpr", 9).alias("fpr"))
