"""Threshold-rule and score-metric queries.

Stand-in: documents joined to labels; the score is distinct words / words
over the whole text, the class is 2 for quality 1 and 4 for quality 0 (so
"score >= t -> 2 else 4" is the rule), the adviser is the source, the
three-class ratio is 1 / distinct words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import evaluate as EV
from hearth.operators import relational as R
from hearth.operators import threshold as T
from hearth.plans.registry import query
from hearth.plans.tables import lng, table
from hearth.session import cut_lineage

BAND = (1 / 23, 1 / 17)
SOURCE_FLOOR = 20


def doc_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    words = F.split(F.col("text"), " ")
    j = docs.join(labels, "doc_id", "inner")
    return j.select(
        "doc_id", "lang", "source",
        (F.size(F.array_distinct(words)) * F.lit(1.0) / F.size(words)).alias("s"),
        (F.lit(1.0) / F.size(F.array_distinct(words))).alias("ratio"),
        F.when(F.col("quality") == 1, F.lit(2)).otherwise(F.lit(4)).alias("y"))


SQL_D = """
d AS (SELECT doc_id, lang, source,
             len(list_distinct(string_split(text, ' '))) * 1.0::DOUBLE / len(string_split(text, ' ')) AS s,
             1.0::DOUBLE / len(list_distinct(string_split(text, ' '))) AS ratio,
             CASE WHEN quality = 1 THEN 2 ELSE 4 END AS y
      FROM documents JOIN labels USING (doc_id))"""


def sql_fit(src: str, grp: str | None) -> str:
    """SQL for the exact sweep over ``src`` (columns s, y[, grp])."""
    if grp is None:
        return f"""
g AS (SELECT s, COUNT(*) n, SUM(CASE WHEN y = 2 THEN 1 ELSE 0 END) na,
             SUM(CASE WHEN y = 4 THEN 1 ELSE 0 END) nb FROM {src} GROUP BY s),
c AS (SELECT s AS t, SUM(n - na) OVER (ORDER BY s DESC)
             + COALESCE(SUM(n - nb) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e,
             0 AS last FROM g
      UNION ALL SELECT NULL, (SELECT SUM(n - nb) FROM g), 1),
fit AS (SELECT t, e, (SELECT COUNT(*) FROM {src}) AS n FROM c ORDER BY e, last, t LIMIT 1)"""
    return f"""
g AS (SELECT {grp}, s, COUNT(*) n, SUM(CASE WHEN y = 2 THEN 1 ELSE 0 END) na,
             SUM(CASE WHEN y = 4 THEN 1 ELSE 0 END) nb FROM {src} GROUP BY {grp}, s),
c AS (SELECT {grp}, s AS t, SUM(n - na) OVER (PARTITION BY {grp} ORDER BY s DESC)
             + COALESCE(SUM(n - nb) OVER (PARTITION BY {grp} ORDER BY s
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e,
             0 AS last FROM g
      UNION ALL SELECT {grp}, NULL, SUM(n - nb), 1 FROM g GROUP BY {grp}),
nn AS (SELECT {grp}, COUNT(*) n FROM {src} GROUP BY {grp}),
fit AS (SELECT c.{grp}, t, e, nn.n FROM c JOIN nn ON c.{grp} = nn.{grp}
        QUALIFY row_number() OVER (PARTITION BY c.{grp} ORDER BY e, last, t) = 1)"""


@query("fit_threshold", sql=f"""
WITH {SQL_D}, {sql_fit('d', None)}
SELECT t AS threshold, CAST(e AS BIGINT) AS n_err, CAST(n AS BIGINT) AS n,
       CAST(e AS DOUBLE) / n AS error FROM fit
""")
def fit_threshold(spark: SparkSession, d: str) -> DataFrame:
    return T.fit_threshold(doc_scores(spark, d), score="s", label="y")


@query("fit_threshold_by_group", sql=f"""
WITH {SQL_D}, {sql_fit('d', 'lang')}
SELECT lang, t AS threshold, CAST(e AS BIGINT) AS n_err, CAST(n AS BIGINT) AS n,
       CAST(e AS DOUBLE) / n AS error FROM fit
""")
def fit_threshold_by_group(spark: SparkSession, d: str) -> DataFrame:
    return T.fit_threshold(doc_scores(spark, d), score="s", label="y", group_by=["lang"])


@query("threshold_predict", sql=f"""
WITH {SQL_D}, {sql_fit('d', None)}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(y AS BIGINT) AS y,
       CAST(CASE WHEN s >= (SELECT t FROM fit) THEN 2 ELSE 4 END AS BIGINT) AS pred
FROM d
""")
def threshold_predict(spark: SparkSession, d: str) -> DataFrame:
    x = doc_scores(spark, d)
    t = T.fit_threshold(x, score="s", label="y").first()["threshold"]
    return x.select(lng("doc_id").alias("doc_id"), lng("y").alias("y"),
                    lng(T.threshold_predict("s", t)).alias("pred"))


@query("threshold_error", sql=f"""
WITH {SQL_D}
SELECT 1 - AVG(CASE WHEN (CASE WHEN s >= 0.5 THEN 2 ELSE 4 END) = y THEN 1 ELSE 0 END) AS error,
       CAST(COUNT(*) AS BIGINT) AS n FROM d
""")
def threshold_error(spark: SparkSession, d: str) -> DataFrame:
    return T.threshold_error(doc_scores(spark, d), "s", "y", 0.5)


@query("threshold_accuracy", sql=f"""
WITH {SQL_D},
 cnt AS (SELECT source, COUNT(*) n FROM d GROUP BY source),
 dm AS (SELECT d.*, CASE WHEN cnt.n < {SOURCE_FLOOR} THEN 'merged' ELSE d.source END AS grp
        FROM d JOIN cnt ON d.source = cnt.source),
 {sql_fit('dm', 'grp')},
 p AS (SELECT dm.y, CASE WHEN dm.s >= fit.t THEN 2 ELSE 4 END AS pred FROM dm JOIN fit ON dm.grp = fit.grp)
SELECT AVG(CASE WHEN pred = y THEN 1 ELSE 0 END) AS accuracy, CAST(COUNT(*) AS BIGINT) AS n FROM p
""")
def threshold_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Advisers with few cases merged, one threshold per adviser, applied by a
    lookup join, accuracy of the whole (in-sample, as in the source)."""
    x = R.merge_rare(doc_scores(spark, d), "source", floor=SOURCE_FLOOR,
                     merged_value="merged", out="grp")
    fit = T.fit_threshold(x, score="s", label="y", group_by=["grp"])
    p = T.apply_thresholds(x, fit, score="s", group_by=["grp"])
    return T.accuracy(p, "pred", "y")


@query("crosstab", sql=f"""
WITH {SQL_D}, {sql_fit('d', None)},
 p AS (SELECT y, CASE WHEN s >= (SELECT t FROM fit) THEN 2 ELSE 4 END AS pred FROM d)
SELECT CAST(pred AS BIGINT) AS predicted, CAST(y AS BIGINT) AS actual, CAST(COUNT(*) AS BIGINT) AS n
FROM p GROUP BY pred, y
""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    x = doc_scores(spark, d)
    t = T.fit_threshold(x, score="s", label="y").first()["threshold"]
    c = T.crosstab_long(x.withColumn("pred", T.threshold_predict("s", t)), "pred", "y")
    return c.select(lng("predicted").alias("predicted"), lng("actual").alias("actual"), "n")


@query("band_rule", sql=f"""
WITH {SQL_D}, {sql_fit('d', None)}
SELECT CAST(doc_id AS BIGINT) AS doc_id,
       CAST(CASE WHEN ratio >= CAST('{BAND[0]!r}' AS DOUBLE) AND ratio <= CAST('{BAND[1]!r}' AS DOUBLE) THEN 3
                 WHEN s >= (SELECT t FROM fit) THEN 2 ELSE 4 END AS BIGINT) AS pred
FROM d
""")
def band_rule(spark: SparkSession, d: str) -> DataFrame:
    x = doc_scores(spark, d)
    t = T.fit_threshold(x, score="s", label="y").first()["threshold"]
    return x.select(lng("doc_id").alias("doc_id"),
                    lng(T.band_rule(T.threshold_predict("s", t), "ratio", band=BAND))
                    .alias("pred"))


@query("roc_auc", sql=f"""
WITH {SQL_D},
 g AS (SELECT s, SUM(CASE WHEN y = 2 THEN 1 ELSE 0 END) p, SUM(CASE WHEN y = 2 THEN 0 ELSE 1 END) q
       FROM d GROUP BY s),
 c AS (SELECT p, q, COALESCE(SUM(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT CAST(SUM(CAST(p AS HUGEINT) * (2 * nb + q)) AS DOUBLE) / (2 * CAST(SUM(p) AS DOUBLE) * CAST(SUM(q) AS DOUBLE)) AS auc,
       CAST(SUM(p) AS BIGINT) AS n_pos, CAST(SUM(q) AS BIGINT) AS n_neg FROM c
""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return T.roc_auc(doc_scores(spark, d), score="s", label="y", positive=2)


@query("roc_curve", sql=f"""
WITH {SQL_D},
 g AS (SELECT s, SUM(CASE WHEN y = 2 THEN 1 ELSE 0 END) p, SUM(CASE WHEN y = 2 THEN 0 ELSE 1 END) q
       FROM d GROUP BY s),
 tot AS (SELECT SUM(p) AS P, SUM(q) AS N FROM g),
 c AS (SELECT s AS threshold, SUM(p) OVER (ORDER BY s DESC) AS tp, SUM(q) OVER (ORDER BY s DESC) AS fp FROM g
       UNION ALL SELECT NULL, 0, 0)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(tp AS DOUBLE) / tot.P AS tpr, CAST(fp AS DOUBLE) / tot.N AS fpr
FROM c, tot
""")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return T.roc_curve(doc_scores(spark, d), score="s", label="y", positive=2)


@query("histogram", sql="""
WITH b AS (SELECT c_mktsegment,
                  LEAST(CAST(floor((c_acctbal - (-1000.0)::DOUBLE) / 100.0::DOUBLE) AS BIGINT) + 1, 30) AS bin
           FROM customer WHERE c_acctbal >= -1000 AND c_acctbal <= 2000),
 h AS (SELECT c_mktsegment, bin, COUNT(*) n FROM b GROUP BY 1, 2)
SELECT c_mktsegment, CAST(bin AS INTEGER) AS bin, -1000.0::DOUBLE + (bin - 1) * 100.0::DOUBLE AS lo,
       -1000.0::DOUBLE + bin * 100.0::DOUBLE AS hi, CAST(n AS BIGINT) AS n,
       n / (CAST(SUM(n) OVER (PARTITION BY c_mktsegment) AS DOUBLE) * 100.0::DOUBLE) AS density
FROM h
""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return T.histogram(c, "c_acctbal", bins=30, lo=-1000.0, hi=2000.0, group_by=["c_mktsegment"])





HELD_OUT_FOLDS = 5


@query("threshold_held_out", sql=f"""
WITH {SQL_D},
 f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(CAST(doc_id AS VARCHAR) || ':1'), doc_id) - 1) % {HELD_OUT_FOLDS} AS fold FROM d),
 k AS (SELECT DISTINCT a.lang, b.fold FROM f a, (SELECT DISTINCT fold FROM f) b),
 t AS (SELECT DISTINCT k.lang, k.fold, f.s AS t FROM k JOIN f ON f.lang = k.lang AND f.fold <> k.fold),
 c AS (SELECT t.lang, t.fold, t.t, 0 AS last, COUNT(*) FILTER (WHERE (CASE WHEN f.s >= t.t THEN 2 ELSE 4 END) <> f.y) AS e
       FROM t JOIN f ON f.lang = t.lang AND f.fold <> t.fold GROUP BY ALL
       UNION ALL SELECT k.lang, k.fold, NULL, 1, COUNT(*) FILTER (WHERE f.y <> 4 AND f.fold <> k.fold)
       FROM k JOIN f ON f.lang = k.lang GROUP BY ALL)
SELECT lang, CAST(fold AS INTEGER) AS fold, t AS threshold, e AS n_err FROM c
QUALIFY row_number() OVER (PARTITION BY lang, fold ORDER BY e, last, t) = 1
""")
def threshold_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Per language and fold, the threshold fitted on the other folds."""
    x = EV.stratified_folds(doc_scores(spark, d), id_col="doc_id", label="y", n_folds=HELD_OUT_FOLDS, seed=1)
    return T.fit_threshold_held_out(x, score="s", label="y", fold="fold", n_folds=HELD_OUT_FOLDS, group_by=["lang"])


@query("threshold_held_out_accuracy", sql=f"""
WITH {SQL_D},
 f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(CAST(doc_id AS VARCHAR) || ':1'), doc_id) - 1) % {HELD_OUT_FOLDS} AS fold FROM d),
 k AS (SELECT DISTINCT a.lang, b.fold FROM f a, (SELECT DISTINCT fold FROM f) b),
 t AS (SELECT DISTINCT k.lang, k.fold, f.s AS t FROM k JOIN f ON f.lang = k.lang AND f.fold <> k.fold),
 c AS (SELECT t.lang, t.fold, t.t, 0 AS last, COUNT(*) FILTER (WHERE (CASE WHEN f.s >= t.t THEN 2 ELSE 4 END) <> f.y) AS e
       FROM t JOIN f ON f.lang = t.lang AND f.fold <> t.fold GROUP BY ALL
       UNION ALL SELECT k.lang, k.fold, NULL, 1, COUNT(*) FILTER (WHERE f.y <> 4 AND f.fold <> k.fold)
       FROM k JOIN f ON f.lang = k.lang GROUP BY ALL),
 fit AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, fold ORDER BY e, last, t) = 1)
SELECT AVG(CAST((CASE WHEN f.s >= fit.t THEN 2 ELSE 4 END) = f.y AS INTEGER)) AS accuracy, COUNT(*) AS n
FROM f JOIN fit ON f.lang = fit.lang AND f.fold = fit.fold
""")
def threshold_held_out_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of every row under the threshold that its fold did not help to fit."""
    x = cut_lineage(EV.stratified_folds(doc_scores(spark, d), id_col="doc_id", label="y", n_folds=HELD_OUT_FOLDS, seed=1), "folds")
    fits = T.fit_threshold_held_out(x, score="s", label="y", fold="fold", n_folds=HELD_OUT_FOLDS, group_by=["lang"])
    return T.accuracy(T.apply_thresholds(x, fits, score="s", group_by=["lang", "fold"]), "pred", "y")
