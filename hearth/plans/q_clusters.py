"""Clustering, PCA and cluster-description queries on the embeddings
(standardised coordinates), plus the v-test description of given groups
(lineitem by return flag) checked against SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth import config as C
from hearth.functions import features as X
from hearth.operators import clusters as CL
from hearth.operators import neighbors as NB
from hearth.operators import scaling as SC
from hearth.plans.registry import query
from hearth.plans.tables import dbl, lng, table
from hearth.session import cut_lineage

DIM = 64
MICRO_K = 50          # micro-clusters on the driver tables (1000 in the source's setting)
WARD_HEIGHT, WARD_LOOKED_AT = 9.0, 12.0  # cut heights for standardised 64-d embeddings
SEGMENT_HEIGHT, SEGMENT_FLOOR = 9.0, 3  # cut and least micro-centres of a segment


def scaled_embeddings(spark: SparkSession, d: str):
    e = table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    means, sds = SC.fit_array_scaler(e, "v", DIM)
    return e.select("vec_id", "label", SC.standardize_array("v", means, sds).alias("z")), means, sds


def _apart(vec: str, centre: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(vec, centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def _misplaced(points: DataFrame, assign: DataFrame, centres: DataFrame, *, id_col: str, vec: str,
               cluster: str, centre: str) -> DataFrame:
    """One row: the points, and those for which another centre is nearer than
    the centre of their cluster."""
    nearest = NB.nearest_centre(points, centres, point_id=id_col, vec=vec, centre_id=cluster,
                                centre_vec=centre, out="__near")
    own = assign.select(id_col, F.col(cluster).alias("__own")).join(points, id_col).join(
        centres.select(F.col(cluster).alias("__own"), centre), "__own")
    j = own.select(id_col, _apart(vec, centre).alias("__d")).join(nearest, id_col)
    return j.agg(F.count(F.lit(1)).alias("n_points"),
                 F.count_if(F.col("__d") > F.col("dist") + 1e-6).alias("n_misplaced"))


SQL_PLACED = "SELECT COUNT(*) AS n_points, 0 AS n_misplaced FROM embeddings"


@query("micro_cluster_placed", sql=SQL_PLACED)
def micro_cluster_placed(spark: SparkSession, d: str) -> DataFrame:
    """k-means micro-clusters of the standardised embeddings: every point lies
    in the cluster of its nearest centre."""
    z, _, _ = scaled_embeddings(spark, d)
    assign, centres = CL.micro_cluster(z, id_col="vec_id", vec="z", k=MICRO_K, seed=C.MICRO_SEED)
    return _misplaced(z.select("vec_id", "z"), assign, centres.select("micro_id", "centre"), id_col="vec_id",
                      vec="z", cluster="micro_id", centre="centre")


def _micro_centres(spark: SparkSession, d: str) -> DataFrame:
    z, _, _ = scaled_embeddings(spark, d)
    _, centres = CL.micro_cluster(z, id_col="vec_id", vec="z", k=MICRO_K, seed=C.MICRO_SEED)
    return cut_lineage(centres, "micro-centres")


@query("micro_cluster")
def micro_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Micro-clusters of the standardised embeddings: centre and size, the points
    that were placed against every centre (all of them, rows of equal or unknown
    id too), and for how many of these another centre is nearer (none)."""
    z, _, _ = scaled_embeddings(spark, d)
    assign, centres = CL.micro_cluster(z, id_col="vec_id", vec="z", k=MICRO_K, seed=C.MICRO_SEED, keep=["z"])
    centres = cut_lineage(centres, "micro-centres")
    near = NB.nearest_centre(assign.select(F.struct("micro_id", "z").alias("point"), "z"), centres, point_id="point", vec="z",
                             centre_id="micro_id", centre_vec="centre")
    own = near.select(F.col("point.micro_id").alias("micro_id"), F.col("point.z").alias("z"), "dist").join(centres, "micro_id")
    placed = own.groupBy("micro_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(
        _apart("z", "centre") > F.col("dist") + 1e-6).alias("n_misplaced"))
    return centres.join(placed, "micro_id").select("micro_id", "centre", "size", "n_points", "n_misplaced")


@query("ward_linkage")
def ward_linkage(spark: SparkSession, d: str) -> DataFrame:
    """All Ward merges of the micro-centres."""
    return CL.ward_linkage(_micro_centres(spark, d))


@query("ward_cut")
def ward_cut(spark: SparkSession, d: str) -> DataFrame:
    """Flat clusters of the micro-centres at two heights, from one linkage."""
    centres = _micro_centres(spark, d)
    linkage = cut_lineage(CL.ward_linkage(centres), "linkage")
    return CL.cut_linkage(centres, linkage, [WARD_HEIGHT, WARD_LOOKED_AT])


@query("ward_checks", sql=f"""
SELECT {MICRO_K} AS n_merges_and_clusters, 0 AS n_above_cut, 0 AS n_falling
""")
def ward_checks(spark: SparkSession, d: str) -> DataFrame:
    """Ward merges of the micro-centres below the cut: every merge takes one
    cluster away, none lies above the cut, and none below a merge it builds on."""
    member, linkage = CL.ward_cut(_micro_centres(spark, d), height=WARD_HEIGHT)
    linkage = cut_lineage(linkage, "linkage")
    clusters = member.agg(F.countDistinct("cluster").alias("k")).first()["k"]
    later = linkage.select(F.col("round").alias("r2"), F.col("height").alias("h2"),
                           F.array("left", "right").alias("of"))
    later = later.select("r2", "h2", F.explode("of").alias("left"))
    falling = linkage.join(later, "left").where("r2 > round and h2 < height - 1e-9").count()
    return linkage.agg((F.count(F.lit(1)) + F.lit(clusters)).cast("int").alias("n_merges_and_clusters"),
                       F.count_if(F.col("height") > WARD_HEIGHT).alias("n_above_cut"),
                       F.lit(falling).alias("n_falling"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Both stages on the standardised embeddings: micro-clusters, Ward cut,
    small clusters merged, Lloyd refinement of the cut's centres, and the
    micro-centres in original units with their final cluster."""
    z, means, sds = scaled_embeddings(spark, d)
    _, centres = CL.micro_cluster(z, id_col="vec_id", vec="z", k=MICRO_K, seed=C.MICRO_SEED)
    centres = cut_lineage(centres, "micro-centres")
    member, _ = CL.ward_cut(centres, height=SEGMENT_HEIGHT)
    labelled = CL.label_clusters(member, floor=SEGMENT_FLOOR, small_id=C.SMALL_CLUSTER_ID)
    points = centres.join(labelled, "micro_id")
    init = CL.cluster_centroids(points, cluster="cluster", vec="centre", dim=DIM)
    assign, _ = CL.refine_kmeans(points, init, id_col="micro_id", vec="centre")
    units = centres.join(assign, "micro_id").select(
        "micro_id", "cluster", "size", SC.inverse_array("centre", means, sds).alias("centre"))
    return cut_lineage(units, "segments")


@query("segment_export")
def segment_export(spark: SparkSession, d: str) -> DataFrame:
    """Every micro-centre in original units with the cluster that it ends in."""
    return _segments(spark, d)


@query("segment_sizes")
def segment_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Micro-centres and points of every cluster."""
    return _segments(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_points"))


@query("segment_description")
def segment_description(spark: SparkSession, d: str) -> DataFrame:
    """v-tests of the micro-centres' coordinates in every found cluster."""
    x = _segments(spark, d).select("cluster", *[F.col("centre")[i].alias(c) for i, c in enumerate(COORDS)])
    return CL.describe_clusters(x, cluster="cluster", cols=COORDS, limit=C.VTEST_LIMIT)


LABEL_FLOOR = 60  # nations with fewer customers merge into cluster 0 (sf0.01 has 60 on average)


@query("cluster_labels", sql=f"""
SELECT CAST(c_custkey AS BIGINT) AS c_custkey,
       CAST(CASE WHEN COUNT(*) OVER (PARTITION BY c_nationkey) < {LABEL_FLOOR} THEN 0
                 ELSE dense_rank() OVER (ORDER BY c_nationkey) END AS INTEGER) AS cluster
FROM customer
""")
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    """Flat clusters 1..K in id order, small ones 0, over given groups."""
    c = table(spark, d, "customer").select(lng("c_custkey").alias("c_custkey"),
                                           F.col("c_nationkey").alias("cluster"))
    out = CL.label_clusters(c, floor=LABEL_FLOOR, small_id=C.SMALL_CLUSTER_ID)
    return out.select("c_custkey", F.col("cluster").cast("int").alias("cluster"))


def _from_labels(spark: SparkSession, d: str, **how):
    """Lloyd iterations on the standardised embeddings from the centroids of
    their given labels: points, assignment and centres."""
    z, _, _ = scaled_embeddings(spark, d)
    init = CL.cluster_centroids(z, cluster="label", vec="z", dim=DIM)
    points = z.select("vec_id", "z")
    return points, *CL.refine_kmeans(points, init, id_col="vec_id", vec="z", centre_id="label", centre_vec="centre", **how)


@query("refine_kmeans")
def refine_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """The cluster in which every embedding ends."""
    return _from_labels(spark, d)[1].select(lng("vec_id").alias("vec_id"), F.col("label").alias("cluster"))


@query("refine_kmeans_placed", sql=SQL_PLACED)
def refine_kmeans_placed(spark: SparkSession, d: str) -> DataFrame:
    """Every point ends in the cluster of its nearest centre."""
    points, assign, final = _from_labels(spark, d)
    return _misplaced(points, assign, final, id_col="vec_id", vec="z", cluster="label", centre="centre")


@query("lloyd_two_steps", sql="""
WITH u AS (SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x
           FROM embeddings),
 t AS (SELECT dim, AVG(x) AS m, STDDEV_POP(x) AS s FROM u GROUP BY dim),
 z AS (SELECT vec_id, label, dim, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS x FROM u JOIN t USING (dim)),
 v AS (SELECT vec_id, list(x ORDER BY dim) AS v FROM z GROUP BY vec_id),
 c0 AS (SELECT label, list(x ORDER BY dim) AS c FROM (SELECT label, dim, AVG(x) AS x FROM z GROUP BY ALL) GROUP BY label),
 a1 AS (SELECT vec_id, arg_min(label, list_distance(v, c)) AS label FROM v, c0 GROUP BY vec_id),
 n1 AS (SELECT a1.label, dim, AVG(x) AS x FROM z JOIN a1 USING (vec_id) GROUP BY ALL),
 c1 AS (SELECT label, coalesce(m.c, c0.c) AS c FROM c0 LEFT JOIN (SELECT label, list(x ORDER BY dim) AS c FROM n1 GROUP BY label) m USING (label)),
 a2 AS (SELECT vec_id, arg_min(label, list_distance(v, c)) AS label FROM v, c1 GROUP BY vec_id),
 n2 AS (SELECT a2.label, dim, AVG(x) AS x FROM z JOIN a2 USING (vec_id) GROUP BY ALL),
 c2 AS (SELECT label, coalesce(m.c, c1.c) AS c FROM c1 LEFT JOIN (SELECT label, list(x ORDER BY dim) AS c FROM n2 GROUP BY label) m USING (label))
SELECT CAST(label AS BIGINT) AS cluster, CAST(unnest(generate_series(0, len(c) - 1)) AS BIGINT) AS dim, ROUND(unnest(c), 6) AS mean FROM c2
""")
def lloyd_two_steps(spark: SparkSession, d: str) -> DataFrame:
    """The centres after two Lloyd steps from the centroids of the labels."""
    final = _from_labels(spark, d, steps=2)[2].select("label", F.posexplode("centre").alias("dim", "mean"))
    return final.select(lng("label").alias("cluster"), lng("dim").alias("dim"), dbl("mean", 6).alias("mean"))


@query("cluster_export", sql="""
WITH u AS (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS dim,
                  unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
SELECT CAST(label AS BIGINT) AS cluster, CAST(dim AS BIGINT) AS dim, ROUND(AVG(x), 6) AS mean FROM u GROUP BY ALL
""")
def cluster_export(spark: SparkSession, d: str) -> DataFrame:
    """Centres of the given labels, found on the standardised scale and
    exported in original units."""
    z, means, sds = scaled_embeddings(spark, d)
    c = CL.cluster_centroids(z, cluster="label", vec="z", dim=DIM).select(
        "label", F.posexplode(SC.inverse_array("centre", means, sds)).alias("dim", "mean"))
    return c.select(lng("label").alias("cluster"), lng("dim").alias("dim"), dbl("mean", 6).alias("mean"))


@query("cluster_sizes", sql="SELECT CAST(label AS BIGINT) AS cluster, COUNT(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of each given cluster."""
    e = table(spark, d, "embeddings").select(lng("label").alias("cluster"))
    return CL.cluster_sizes(e, "cluster")


SQL_CENTROIDS = """
WITH u AS (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS dim,
                  unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
SELECT CAST(label AS BIGINT) AS label, CAST(dim AS BIGINT) AS dim, ROUND(AVG(x), 6) AS mean,
       CAST(COUNT(*) AS BIGINT) AS n
FROM u GROUP BY label, dim
"""


@query("cluster_centroids", sql=SQL_CENTROIDS)
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Mean embedding per given label, long form (label, dim, mean, n)."""
    e = table(spark, d, "embeddings").select(
        "label", F.col("embedding").cast("array<double>").alias("v"))
    c = CL.cluster_centroids(e, cluster="label", vec="v", dim=DIM)
    x = c.select("label", "n", F.posexplode("centre").alias("dim", "mean"))
    return x.select(lng("label").alias("label"), lng("dim").alias("dim"),
                    dbl("mean", 6).alias("mean"), lng("n").alias("n"))


VARS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sql_describe(source: str, cluster: str, exprs: dict[str, str], limit: float | None = None) -> str:
    per = ", ".join(f"AVG({e}) m{i}, STDDEV_POP({e}) s{i}" for i, e in enumerate(exprs.values()))
    tot = ", ".join(f"AVG({e}) ta{i}, STDDEV_POP({e}) tb{i}" for i, e in enumerate(exprs.values()))
    longs = " UNION ALL ".join(
        f"SELECT cluster, '{v}' AS variable, n_in, m{i} AS mean_in, s{i} AS sd_in, "
        f"ta{i} AS mean_all, tb{i} AS sd_all, n_all FROM per, tot" for i, v in enumerate(exprs))
    x = "(abs(v_test) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * {x}))"
    poly = (f"({t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * "
            f"(1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))))")
    pval = f"(2.0::DOUBLE * (0.5::DOUBLE * {poly} * exp(-{x} * {x})))"
    keep = f"WHERE abs(v_test) >= {limit}" if limit is not None else ""
    return f"""
WITH per AS (SELECT {cluster} AS cluster, COUNT(*) AS n_in, {per} FROM {source} GROUP BY 1),
 tot AS (SELECT COUNT(*) AS n_all, {tot} FROM {source}),
 lg AS ({longs}),
 v AS (SELECT *, (mean_in - mean_all) / sqrt(sd_all * sd_all / n_in * ((n_all - n_in) / (n_all - 1.0::DOUBLE))) AS v_test FROM lg),
 eta AS (SELECT variable, SUM(n_in * (mean_in - mean_all) * (mean_in - mean_all)) / FIRST(sd_all * sd_all * n_all) AS eta2
         FROM lg GROUP BY variable)
SELECT cluster, v.variable, CAST(n_in AS BIGINT) AS n_in, ROUND(mean_in, 6) AS mean_in,
       ROUND(mean_all, 6) AS mean_all, ROUND(sd_in, 6) AS sd_in, ROUND(sd_all, 6) AS sd_all,
       ROUND(v_test, 6) AS v_test, ROUND({pval}, 6) AS p_value, ROUND(eta2, 6) AS eta2
FROM v JOIN eta ON v.variable = eta.variable {keep}
"""


def _described(x: DataFrame) -> DataFrame:
    return x.select("cluster", "variable", "n_in",
                    *[dbl(c, 6).alias(c) for c in ("mean_in", "mean_all", "sd_in", "sd_all",
                                                   "v_test", "p_value", "eta2")])


@query("describe_clusters", sql=_sql_describe("lineitem", "l_returnflag", {v: v for v in VARS}))
def describe_clusters(spark: SparkSession, d: str) -> DataFrame:
    """v-tests of lineitem measures per return flag (the given groups)."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cluster"), *VARS)
    return _described(CL.describe_clusters(li, cluster="cluster", cols=VARS))


COORDS = [f"z{i:02d}" for i in range(DIM)]


@query("describe_micro_clusters", sql=_sql_describe(
    "(SELECT CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", "label",
    {c: f"e[{i + 1}]" for i, c in enumerate(COORDS)}, limit=C.VTEST_LIMIT))
def describe_micro_clusters(spark: SparkSession, d: str) -> DataFrame:
    """v-tests of all coordinates per given cluster of the embeddings."""
    e = table(spark, d, "embeddings").select(lng("label").alias("cluster"), *[
        F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COORDS)])
    return _described(CL.describe_clusters(e, cluster="cluster", cols=COORDS, limit=C.VTEST_LIMIT))


@query("pca_variance")
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    """Explained-variance ratio of every component of the standardised embeddings."""
    z, _, _ = scaled_embeddings(spark, d)
    return SC.pca_variance(z, vec="z", dim=DIM)


@query("pca_project")
def pca_project(spark: SparkSession, d: str) -> DataFrame:
    """Scores on components 1 and 2 (0-based, as the source plots)."""
    z, _, _ = scaled_embeddings(spark, d)
    p = SC.pca_project(z, k=3, vec="z", keep=["vec_id", "label"], out="pcs")
    return p.select(lng("vec_id").alias("vec_id"), lng("label").alias("label"), F.col("pcs")[1].alias("pc1"),
                    F.col("pcs")[2].alias("pc2"))


@query("pca_reduce")
def pca_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Scores on the components kept while the cumulative explained variance is below 2/3."""
    z, _, _ = scaled_embeddings(spark, d)
    p = SC.pca_reduce(z, threshold=C.PCA_VARIANCE_KEPT, vec="z", keep=["vec_id"], out="pcs")
    return p.select(lng("vec_id").alias("vec_id"), "pcs")


@query("pca_variance_checks", sql=f"""
SELECT {DIM} AS n_components, CAST(1 AS DOUBLE) AS total, 0 AS n_rising
""")
def pca_variance_checks(spark: SparkSession, d: str) -> DataFrame:
    """The ratios are as many as coordinates, fall, and sum to one."""
    z, _, _ = scaled_embeddings(spark, d)
    v = SC.pca_variance(z, vec="z", dim=DIM)
    nxt = v.select((F.col("component") - 1).alias("component"), F.col("ratio").alias("next"))
    return v.join(nxt, "component", "left").agg(
        F.count(F.lit(1)).cast("int").alias("n_components"), dbl(F.sum("ratio"), 6).alias("total"),
        F.count_if(F.col("next") > F.col("ratio")).cast("int").alias("n_rising"))


def _centred(scores: DataFrame, *cols) -> DataFrame:
    """Rows, and whether every score is centred."""
    small = None
    for c in cols:
        ok = F.abs(F.avg(c)) < 1e-6
        small = ok if small is None else small & ok
    return scores.agg(F.count(F.lit(1)).alias("n"), small.alias("centred"))


@query("pca_project_checks", sql="SELECT COUNT(*) AS n, TRUE AS centred FROM embeddings")
def pca_project_checks(spark: SparkSession, d: str) -> DataFrame:
    """Scores on components 1 and 2 are centred."""
    return _centred(pca_project(spark, d), F.col("pc1"), F.col("pc2"))


@query("pca_reduce_checks", sql="SELECT COUNT(*) AS n, TRUE AS centred FROM embeddings")
def pca_reduce_checks(spark: SparkSession, d: str) -> DataFrame:
    """Scores on the first kept component are centred."""
    return _centred(pca_reduce(spark, d), F.col("pcs")[0])


SQL_SCALED = """
WITH t AS (SELECT AVG(CAST(p_retailprice AS DOUBLE)) AS m, STDDEV_POP(CAST(p_retailprice AS DOUBLE)) AS s FROM part)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, {} AS p_retailprice FROM part, t
"""


def _scaled_parts(spark: SparkSession, d: str):
    p = table(spark, d, "part").select(lng("p_partkey").alias("p_partkey"), "p_retailprice")
    stats = SC.fit_scaler(p, ["p_retailprice"])
    return SC.standardize(p, stats), stats


@query("standardize", sql=SQL_SCALED.format("ROUND((CAST(p_retailprice AS DOUBLE) - m) / s, 6)"))
def standardize(spark: SparkSession, d: str) -> DataFrame:
    """Prices of mean 0 and population deviation 1."""
    z, _ = _scaled_parts(spark, d)
    return z.select("p_partkey", dbl("p_retailprice", 6).alias("p_retailprice"))


@query("inverse_scale", sql=SQL_SCALED.format("ROUND(CAST(p_retailprice AS DOUBLE), 6)"))
def inverse_scale(spark: SparkSession, d: str) -> DataFrame:
    """Scaled prices back in units."""
    z, stats = _scaled_parts(spark, d)
    return SC.inverse_scale(z, stats).select("p_partkey", dbl("p_retailprice", 6).alias("p_retailprice"))


@query("round_score", sql="""
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS rounded FROM lineitem
""")
def round_score(spark: SparkSession, d: str) -> DataFrame:
    """Half-even rounding of half quantities (all ties and whole numbers)."""
    li = table(spark, d, "lineitem")
    return li.select(lng("l_orderkey").alias("l_orderkey"), lng("l_linenumber").alias("l_linenumber"),
                     X.round_half_even(F.col("l_quantity") / 2).alias("rounded"))
