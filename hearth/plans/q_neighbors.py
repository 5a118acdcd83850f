"""Nearest-neighbour queries: imputation of part sizes from price, brand and
type; out-of-fold neighbour vote on the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions import features as X
from hearth.operators import evaluate as EV
from hearth.operators import features as FE
from hearth.operators import neighbors as NB
from hearth.plans.registry import query
from hearth.plans.tables import dbl, lng, table
from hearth.session import cut_lineage

SIZE_MAX = 45  # sizes above are treated as implausible, nulled and re-imputed


def part_features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_brand", "p_type",
                                       "p_size")
    enc, _ = FE.encode_categories(p, ["p_brand", "p_type"])
    return enc.select("p_partkey", F.col("p_retailprice").cast("double").alias("f0"),
                      F.col("p_brand").cast("double").alias("f1"),
                      F.col("p_type").cast("double").alias("f2"),
                      X.null_outside("p_size", None, SIZE_MAX).alias("p_size"))


SQL_PART = """
b AS (SELECT p_brand AS lab, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)),
t AS (SELECT p_type AS lab, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)),
x AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) f0, CAST(b.code AS DOUBLE) f1, CAST(t.code AS DOUBLE) f2,
             CASE WHEN p_size <= 45 THEN p_size END AS y
      FROM part JOIN b ON p_brand = b.lab JOIN t ON p_type = t.lab)"""


@query("knn_impute", sql=f"""
WITH {SQL_PART},
 pairs AS (SELECT q.p_partkey qid, d.p_partkey did, d.y,
                  sqrt((q.f0 - d.f0) * (q.f0 - d.f0) + (q.f1 - d.f1) * (q.f1 - d.f1) + (q.f2 - d.f2) * (q.f2 - d.f2)) AS dist
           FROM x q JOIN x d ON q.y IS NULL AND d.y IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY q.p_partkey ORDER BY dist, d.p_partkey) <= 3),
 imp AS (SELECT qid, coalesce(avg(CASE WHEN dist = 0 THEN y END),
                              sum(CASE WHEN dist <> 0 THEN y / dist END) / sum(CASE WHEN dist <> 0 THEN 1.0 / dist END)) v
         FROM pairs GROUP BY qid)
SELECT CAST(x.p_partkey AS BIGINT) AS p_partkey, ROUND(coalesce(CAST(x.y AS DOUBLE), imp.v), 6) AS p_size
FROM x LEFT JOIN imp ON x.p_partkey = imp.qid
""")
def knn_impute(spark: SparkSession, d: str) -> DataFrame:
    x = part_features(spark, d)
    filled = NB.knn_impute(x, id_col="p_partkey", fill_cols=["p_size"],
                           feature_cols=["f0", "f1", "f2"], k=3)
    return filled.select(lng("p_partkey").alias("p_partkey"), dbl("p_size", 6).alias("p_size"))


PRICE_MAX = 1500  # prices above are nulled and re-imputed as well
_SPARSE = {"p_size": "y", "p_retailprice": "price"}


def _sql_lane(name: str, col: str) -> str:
    return f"""
 {name}_pairs AS (SELECT q.p_partkey qid, d.{col} AS y, d.p_partkey did,
                  sqrt((q.f1 - d.f1) * (q.f1 - d.f1) + (q.f2 - d.f2) * (q.f2 - d.f2)) AS dist
           FROM w q JOIN w d ON q.{col} IS NULL AND d.{col} IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY q.p_partkey ORDER BY dist, d.p_partkey) <= 3),
 {name}_imp AS (SELECT qid, coalesce(avg(CASE WHEN dist = 0 THEN y END),
                              sum(CASE WHEN dist <> 0 THEN y / dist END) / sum(CASE WHEN dist <> 0 THEN 1.0 / dist END)) v
         FROM {name}_pairs GROUP BY qid)"""


@query("knn_impute_columns", sql=f"""
WITH {SQL_PART},
 w AS (SELECT p_partkey, f1, f2, y, CASE WHEN f0 <= {PRICE_MAX} THEN f0 END AS price FROM x),
 {",".join(_sql_lane(n, c) for n, c in _SPARSE.items())}
SELECT CAST(w.p_partkey AS BIGINT) AS p_partkey, ROUND(coalesce(CAST(y AS DOUBLE), s.v), 6) AS p_size,
       ROUND(coalesce(price, r.v), 6) AS p_retailprice
FROM w LEFT JOIN p_size_imp s ON w.p_partkey = s.qid LEFT JOIN p_retailprice_imp r ON w.p_partkey = r.qid
""")
def knn_impute_columns(spark: SparkSession, d: str) -> DataFrame:
    """Two sparse columns filled by one search over brand and type."""
    x = part_features(spark, d).select("p_partkey", "f1", "f2", "p_size",
                                       F.when(F.col("f0") <= PRICE_MAX, F.col("f0")).alias("p_retailprice"))
    filled = NB.knn_impute(x, id_col="p_partkey", fill_cols=list(_SPARSE), feature_cols=["f1", "f2"], k=3)
    return filled.select(lng("p_partkey").alias("p_partkey"), *[dbl(c, 6).alias(c) for c in _SPARSE])


def _part_searches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The parts without a plausible size, and those with one."""
    x = cut_lineage(part_features(spark, d).select("p_partkey", NB.as_vector(["f0", "f1", "f2"]).alias("v"), "p_size"), "parts")
    return x.where(F.col("p_size").isNull()), x.where(F.col("p_size").isNotNull()).withColumnRenamed("p_partkey", "near")


@query("knn_join", sql=f"""
WITH {SQL_PART}
SELECT CAST(q.p_partkey AS BIGINT) AS p_partkey, CAST(d.p_partkey AS BIGINT) AS near,
       CAST(row_number() OVER (PARTITION BY q.p_partkey ORDER BY round(sqrt((q.f0 - d.f0) * (q.f0 - d.f0) + (q.f1 - d.f1) * (q.f1 - d.f1) + (q.f2 - d.f2) * (q.f2 - d.f2)), 9), d.p_partkey) AS INTEGER) AS rank,
       ROUND(sqrt((q.f0 - d.f0) * (q.f0 - d.f0) + (q.f1 - d.f1) * (q.f1 - d.f1) + (q.f2 - d.f2) * (q.f2 - d.f2)), 6) AS dist
FROM x q JOIN x d ON q.y IS NULL AND d.y IS NOT NULL
QUALIFY rank <= 10
""")
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest known parts of each unknown one, by pruned cells."""
    q, known = _part_searches(spark, d)
    nn = NB.nearest_neighbours(q, known, k=10, q_id="p_partkey", q_vec="v", d_id="near", d_vec="v", rank_digits=9)
    return nn.select("p_partkey", "near", "rank", dbl("dist", 6).alias("dist"))


@query("knn_lsh")
def knn_lsh(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest known parts by buckets of random projections, and
    whether each is one of the exact ten (the recall of the choice)."""
    q, known = _part_searches(spark, d)
    names = {"k": 10, "q_id": "p_partkey", "q_vec": "v", "d_id": "near", "d_vec": "v", "rank_digits": 9}
    near = NB.nearest_neighbours(q, known, **names, method="lsh")
    exact = NB.nearest_neighbours(q, known, **names).select("p_partkey", "near", F.lit(True).alias("exact"))
    return near.join(exact, ["p_partkey", "near"], "left").select(
        "p_partkey", "near", "rank", dbl("dist", 6).alias("dist"), F.coalesce("exact", F.lit(False)).alias("exact"))


def embedding_folds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"),
        (F.col("label") == 0).cast("int").alias("y"))
    return EV.stratified_folds(e, id_col="vec_id", label="y", n_folds=5, seed=1)


SQL_EMB = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v, CASE WHEN label = 0 THEN 1 ELSE 0 END y FROM embeddings),
f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(CAST(vec_id AS VARCHAR) || ':1'), vec_id) - 1) % 5 AS fold
      FROM e)"""


@query("stratified_folds_embeddings", sql=f"""
WITH {SQL_EMB}
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(y AS INTEGER) AS y, CAST(fold AS INTEGER) AS fold FROM f
""")
def stratified_folds_embeddings(spark: SparkSession, d: str) -> DataFrame:
    f = embedding_folds(spark, d)
    return f.select(lng("vec_id").alias("vec_id"), "y", "fold")


@query("knn_classify", sql=f"""
WITH {SQL_EMB},
 pairs AS (SELECT q.vec_id qid, q.fold, d.y, list_distance(q.v, d.v) AS dist
           FROM f q JOIN f d ON q.fold <> d.fold
           QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, d.v), 9), d.vec_id) <= 3)
SELECT CAST(qid AS BIGINT) AS vec_id, CAST(fold AS INTEGER) AS fold,
       ROUND(coalesce(avg(CASE WHEN dist = 0 THEN y END),
                      sum(CASE WHEN dist <> 0 THEN y / dist END) / sum(CASE WHEN dist <> 0 THEN 1.0 / dist END)), 6) AS score
FROM pairs GROUP BY qid, fold
""")
def knn_classify(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold 3-neighbour distance-weighted vote (label 0 vs the rest)."""
    f = cut_lineage(embedding_folds(spark, d), "embedding-folds")
    s = NB.knn_classify(f.select("vec_id", "v", "fold"), f, k=3, id_col="vec_id", vec="v", label="y",
                        positive=1, weights="distance", rank_digits=9, other_group="fold")
    return s.join(f.select("vec_id", "fold"), "vec_id").select(
        lng("vec_id").alias("vec_id"), "fold", dbl("score", 6).alias("score"))
