"""Two-stage clustering and cluster description.

1. ``micro_cluster``: Spark ML k-means into many small groups.
2. ``ward_linkage``: Ward agglomeration of the micro-centres by rounds of
   reciprocal-nearest-neighbour merges. Ward's linkage is reducible: merging
   all reciprocal pairs of a round gives the merges of the greedy algorithm
   (Murtagh 1983), and a cluster's nearest partner stays the nearest until it
   is merged itself, so partners are kept and only merged clusters and those
   that pointed at them are searched again.
3. ``cut_linkage``: flat clusters of a stored linkage at any heights, the merge
   forest resolved by pointer jumping.
4. ``refine_kmeans``: Lloyd iterations started from given centres, summed in
   the tasks that hold the points.
5. ``describe_clusters``: per cluster and variable, the v-test of the
   cluster mean against the overall mean (Lebart, Morineau & Piron), with
   wide partial aggregates (clusters x variables values) rather than a long
   unpivot of the rows.

Centres are a model: their number is a parameter (``MAX_CENTRES`` at most), and
they travel with the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.operators import neighbors as NB
from hearth.operators.partials import array_sums
from hearth.operators.prefix import dense_codes
from hearth.operators.relational import merge_rare
from hearth.session import cut_lineage, delete_path, shared_path

#: Most centres of one clustering: what the driver and every task can hold.
MAX_CENTRES = 100_000
#: Share of points computed anew at which Lloyd's bounds are taken again.
LLOYD_REFRESH = 0.3
#: Centres whose sums travel as one array.
CENTRES_PER_BLOCK = 1024
#: Coordinates in a block of Lloyd's points (2 MB), and in a file of blocks (8 MB), which one task reads.
BLOCK_VALUES, TASK_VALUES = 1 << 18, 1 << 20


def array_mean(vec: str, dim: int, weight: str | None = None) -> Column:
    """Aggregate: coordinate-wise (weighted) mean of an ARRAY<DOUBLE>."""
    v = F.col(vec)
    if weight is None:
        return F.array(*[F.avg(v[i]) for i in range(dim)])
    w = F.col(weight)
    return F.array(*[F.sum(v[i] * w) / F.sum(w) for i in range(dim)])


def vector_dim(df: DataFrame, vec: str) -> int:
    return int(df.select(F.size(vec).alias("n")).agg(F.max("n")).first()[0])


# --- C1 ----------------------------------------------------------------------------------------

def micro_cluster(df: DataFrame, *, id_col: str, vec: str, k: int, seed: int = 0, max_iter: int = 300,
                  tol: float = 1e-4, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """k-means into ``k`` groups. Returns (assignment ``(id, *keep, micro_id)``,
    centres ``(micro_id, centre ARRAY<DOUBLE>, size)``)."""
    x = df.select(id_col, *keep, array_to_vector(F.col(vec).cast("array<double>")).alias("__f"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="__f",
                   predictionCol="micro_id").fit(x)
    assign = model.transform(x).select(id_col, *keep, F.col("micro_id").cast("long"))
    sizes = assign.groupBy("micro_id").agg(F.count(F.lit(1)).alias("size"))
    centres = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    cdf = df.sparkSession.createDataFrame(centres, "micro_id long, centre array<double>")
    # k centres (a parameter) come from the fitted model; keep non-empty ones
    return assign, cdf.join(sizes, "micro_id", "inner")


# --- C2 C3 ---------------------------------------------------------------------------------------

def _read_centres(df: DataFrame, id_col: str, vec: str, *more: Column) -> list:
    """A bounded table of centres, in id order."""
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), *more)
            .limit(MAX_CENTRES + 1).collect())
    if len(rows) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres; group the points into micro-clusters first")
    return sorted(rows, key=lambda r: r["id"])


def _ward_partners(x: np.ndarray, w: np.ndarray, of: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Ward-nearest cluster of each of ``of`` (ties: the first) and the height."""
    part = 2.0 * w[of][:, None] * w[among] / (w[of][:, None] + w[among])
    apart = np.sqrt(part) * NB._pairwise(x[of], x[among], "euclidean", 2.0)
    apart[of[:, None] == among] = np.inf
    best = apart.argmin(axis=1)
    return among[best], apart[np.arange(len(of)), best]


def ward_linkage(centres: DataFrame, *, id_col: str = "micro_id", vec: str = "centre", weight: str | None = None,
                 height: float | None = None) -> DataFrame:
    """Ward agglomeration of weighted points: ``round, left, right, height,
    size``, a row for each merge, ``left < right`` being the smallest member
    ids of the merged clusters; the merged cluster goes on as ``left``. Weights
    default to 1 per point (the micro-centres' sizes are not used, as in the
    source; pass ``weight`` to use them). With ``height``, merges above it are
    left out.

    A round is one job over the clusters whose partner is gone."""
    spark = centres.sparkSession
    rows = _read_centres(centres, id_col, vec, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    schema = "round int, left long, right long, height double, size double"
    if len(rows) < 2:
        return spark.createDataFrame([], schema)
    ids = np.array([r["id"] for r in rows], np.int64)
    x, w = np.array([r["v"] for r in rows], np.float64), np.array([r["w"] for r in rows], np.float64)
    alive, partner, apart = np.ones(len(ids), bool), np.full(len(ids), -1), np.full(len(ids), np.inf)
    stale, links, round_ = np.arange(len(ids)), [], 0
    while True:
        for at, near, far in _search_partners(spark, x, w, stale, np.flatnonzero(alive)):
            partner[at], apart[at] = near, far
        own = np.flatnonzero(alive)
        left = own[(partner[partner[own]] == own) & (own < partner[own])]
        if height is not None:
            left = left[apart[left] <= height]
        if not len(left):
            break
        right = partner[left]
        size = w[left] + w[right]
        x[left] = (x[left] * w[left][:, None] + x[right] * w[right][:, None]) / size[:, None]
        w[left], alive[right] = size, False
        links += zip([round_] * len(left), ids[left].tolist(), ids[right].tolist(), apart[left].tolist(), size.tolist())
        if alive.sum() < 2:
            break
        own = np.flatnonzero(alive)
        stale = own[np.isin(own, left) | np.isin(partner[own], np.concatenate((left, right)))]
        round_ += 1
    return spark.createDataFrame([(int(r), *rest) for r, *rest in links], schema)


def _search_partners(spark, x: np.ndarray, w: np.ndarray, of: np.ndarray, among: np.ndarray) -> list:
    """Partners of the clusters ``of``, in as many tasks as their distances fill."""
    tasks = int(min(len(of), max(1, len(of) * len(among) * x.shape[1] // 20_000_000 + 1)))
    held = spark.sparkContext.broadcast((x, w, among))

    def search(frames):
        for frame in frames:
            at = frame["id"].to_numpy()
            points, weights, others = held.value
            for a in range(0, len(at), 256):
                near, far = _ward_partners(points, weights, at[a:a + 256], others)
                yield pd.DataFrame({"at": at[a:a + 256], "near": near, "far": far})
    todo = spark.createDataFrame(pd.DataFrame({"id": of.astype(np.int64)})).repartition(tasks) if tasks > 1 else (
        spark.createDataFrame(pd.DataFrame({"id": of.astype(np.int64)})).coalesce(1))
    found = [tuple(r) for r in todo.mapInPandas(search, "at long, near long, far double").collect()]
    held.destroy()
    return found


def cut_linkage(points: DataFrame, linkage: DataFrame, heights: Sequence[float], *, id_col: str = "micro_id") -> DataFrame:
    """Flat clusters at each of ``heights`` from one linkage: ``(height,
    id_col, cluster)``, cluster being the smallest member id. Every ``right``
    of a merge points at its ``left``; pointers above a height are left out and
    the rest are doubled until they end, all heights at once."""
    level = F.explode(F.array(*[F.lit(float(h)) for h in heights]))
    merges = linkage.select(F.col("right").alias(id_col), F.col("left").alias("__to"), F.col("height").alias("__h"))
    now = (points.select(F.col(id_col).cast("long").alias(id_col)).withColumn("height", level)
           .join(merges, id_col, "left")
           .select("height", id_col, F.when(F.col("__h") <= F.col("height"), F.col("__to")).otherwise(F.col(id_col)).alias("cluster")))
    while True:
        now = cut_lineage(now, "ward-pointers")
        ends = now.select(F.col("height").alias("__height"), F.col(id_col).alias("__at"), F.col("cluster").alias("__end"))
        hop = now.join(ends, (F.col("height") == F.col("__height")) & (F.col("cluster") == F.col("__at")))
        if not hop.where(F.col("__end") != F.col("cluster")).limit(1).count():
            return now
        now = hop.select("height", id_col, F.col("__end").alias("cluster"))


def ward_cut(centres: DataFrame, *, id_col: str = "micro_id", vec: str = "centre",
             height: float | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Ward agglomeration cut at ``height`` (None: merged to one cluster):
    membership ``(id_col, cluster)`` where cluster is the smallest member id,
    and the linkage of :func:`ward_linkage`."""
    linkage = ward_linkage(centres, id_col=id_col, vec=vec, weight=weight, height=height)
    member = cut_linkage(centres, linkage, [math.inf if height is None else height], id_col=id_col)
    return member.select(id_col, "cluster"), linkage


def label_clusters(member: DataFrame, *, cluster: str = "cluster", floor: int | None = None,
                   small_id: int = 0) -> DataFrame:
    """Relabel clusters 1..K (ascending cluster id) and merge those with
    fewer than ``floor`` members into ``small_id``."""
    codes = dense_codes(member, cluster, out="__lab").withColumnRenamed(cluster, "__c")
    out = member.join(codes, member[cluster] == codes["__c"], "inner").select(
        *[c for c in member.columns if c != cluster], (F.col("__lab") + 1).alias(cluster))
    if floor is not None:
        out = merge_rare(out, cluster, floor=floor, merged_value=small_id)
    return out


# --- C5 C6 C7 --------------------------------------------------------------------------------------

def cluster_centroids(df: DataFrame, *, cluster: str, vec: str, dim: int | None = None,
                      weight: str | None = None) -> DataFrame:
    """Mean vector per cluster: ``(cluster, centre, n)``."""
    dim = dim or vector_dim(df, vec)
    return df.groupBy(cluster).agg(array_mean(vec, dim, weight).alias("centre"),
                                   F.count(F.lit(1)).alias("n"))


class _Lloyd:
    """One pass over points: each goes to its nearest centre (ties: the first)
    and the vectors of each centre are summed. A point carries its centre at an
    earlier pass with bounds of its distance to that one (``upper``) and to any
    other (``lower``); while the centres' moves since then leave the first
    below the second, nothing is computed for it. Points travel as blocks, a row
    with the bytes of a matrix, as every pass reads them all again."""

    def __init__(self, centres: np.ndarray, reference: np.ndarray):
        self.centres = centres
        self.moved = np.sqrt(((centres - reference) ** 2).sum(axis=1))

    def nearest_two(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
        for a, b in NB._chunks(len(x), len(self.centres)):
            d = NB._pairwise(x[a:b], self.centres, "euclidean", 2.0)
            at[a:b] = d.argmin(axis=1)
            row = np.arange(b - a)
            upper[a:b] = d[row, at[a:b]]
            d[row, at[a:b]] = np.inf
            lower[a:b] = d.min(axis=1)
        return at, upper, lower

    def place(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
        # rounding is far below this
        anew = upper + self.moved[at] + 1e-9 >= lower - self.moved.max()
        if anew.any():
            at = at.copy()
            at[anew] = self.nearest_two(x[anew])[0]
        return at, int(anew.sum())

    def sums(self, frame: pd.DataFrame):
        """By block of centres: points, computed points and vector sums."""
        for v, at, upper, lower in zip(frame["__v"], frame["__at"], frame["__upper"], frame["__lower"]):
            at = np.frombuffer(at, np.int64)
            x = np.frombuffer(v).reshape(len(at), -1)
            at, computed = self.place(x, at, np.frombuffer(upper), np.frombuffer(lower))
            order = np.argsort(at, kind="stable")
            used, first = np.unique(at[order], return_index=True)
            vectors = np.add.reduceat(x[order], first, axis=0)
            counts = np.diff(first, append=len(at))
            for part in np.unique(used // CENTRES_PER_BLOCK):
                here, start = used // CENTRES_PER_BLOCK == part, part * CENTRES_PER_BLOCK
                total = np.zeros((min(CENTRES_PER_BLOCK, len(self.centres) - start), x.shape[1] + 1))
                total[used[here] - start, 0], total[used[here] - start, 1:] = counts[here], vectors[here]
                yield int(part), total.ravel()
            yield -1, np.array([float(computed)])

    def bounds(self, frames):
        for frame in frames:
            for n, v in zip(frame["__n"], frame["__v"]):
                at, upper, lower = self.nearest_two(np.frombuffer(v).reshape(n, -1))
                yield pd.DataFrame({"__n": [n], "__v": [v], "__at": [at.tobytes()], "__upper": [upper.tobytes()],
                                    "__lower": [lower.tobytes()]})


def _blocks(dim: int):
    """Rows to blocks of at most ``BLOCK_VALUES`` coordinates (one point at least)."""
    step = max(1, BLOCK_VALUES // max(dim, 1))

    def pack(frames):
        for frame in frames:
            for a in range(0, len(frame), step):
                x = NB._matrix(frame["__v"].iloc[a:a + step])
                yield pd.DataFrame({"__n": [len(x)], "__v": [x.tobytes()]})
    return pack


def refine_kmeans(points: DataFrame, init: DataFrame, *, id_col: str, vec: str,
                  centre_id: str = "cluster", centre_vec: str = "centre",
                  max_iter: int = 300, tol: float = 1e-4, steps: int | None = None,
                  report: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Lloyd iterations from the given centres (an empty cluster keeps its
    centre). Stops when the total squared shift is at most ``tol`` times
    the mean per-coordinate variance, or after exactly ``steps`` rounds if
    given; raises after ``max_iter`` rounds. Returns (assignment ``(id,
    centre_id)``, centres).

    A round sums the vectors of each centre in the tasks that hold the points
    and shuffles at most centres x tasks sums; points whose distance bounds
    still decide are not computed. ``report`` receives the number of points
    computed in each round."""
    spark = points.sparkSession
    rows = _read_centres(init, centre_id, centre_vec)
    names, centres = np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)
    dim = vector_dim(points, vec)
    spread = points.agg(F.count(F.lit(1)), *[F.var_pop(F.col(vec)[i]) for i in range(dim)]).first()
    n_points, tol_abs = spread[0], tol * sum(x or 0.0 for x in spread[1:]) / max(dim, 1)
    held = "__n int, __v binary, __at binary, __upper binary, __lower binary"
    sums_bytes = 8 * len(names) * (dim + 1)
    paths: list[str] = []

    def bounded(at: np.ndarray) -> tuple[DataFrame, int]:
        # one pass at the centres that later passes measure their moves from
        path = shared_path(spark, "lloyd-bounds")
        blocks.mapInPandas(_Lloyd(at, at).bounds, held).write.parquet(path)
        if paths:
            delete_path(spark, paths.pop())
        paths.append(path)
        now = spark.read.schema(held).parquet(path)
        return now, now.rdd.getNumPartitions()
    pts = cut_lineage(points.select(F.col(id_col).cast("long").alias("__pid"),
                                    F.col(vec).cast("array<double>").alias("__v")), "lloyd-points")
    tasks = max(1, math.ceil(n_points * dim / TASK_VALUES))
    blocks = cut_lineage(pts.repartition(tasks, "__pid").select("__v").mapInPandas(_blocks(dim), "__n int, __v binary"),
                         "lloyd-blocks")
    reference, (state, parts) = centres, bounded(centres)
    for done in range(steps if steps is not None else max_iter + 1):
        if steps is None and done == max_iter:
            raise RuntimeError(f"centres still move after {max_iter} iterations")
        found = array_sums(state, _Lloyd(centres, reference).sums, partitions=parts, sums_bytes=sums_bytes)
        anew, before, centres = int(found.pop(-1, np.zeros(1))[0]), centres, centres.copy()
        for block, total in found.items():
            total = total.reshape(-1, dim + 1)
            used = np.flatnonzero(total[:, 0])
            centres[block * CENTRES_PER_BLOCK + used] = total[used, 1:] / total[used, :1]
        if report is not None:
            report.append(anew)
        if steps is None and ((centres - before) ** 2).sum() <= tol_abs:
            break
        if anew > LLOYD_REFRESH * n_points and not np.array_equal(before, reference):
            reference, (state, parts) = centres, bounded(centres)
    delete_path(spark, paths.pop())
    final = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(names, centres)],
                                  f"{centre_id} long, {centre_vec} array<double>")
    assign = NB.nearest_centre(pts, final, point_id="__pid", vec="__v", centre_id=centre_id, centre_vec=centre_vec,
                               out=centre_id)
    return assign.select(F.col("__pid").alias(id_col), centre_id), final


# --- C8 ----------------------------------------------------------------------------------------------

def _norm_sf(z: Column) -> Column:
    """Upper tail of the standard normal, 1 - Phi(z) for z >= 0, from the
    Abramowitz & Stegun 7.1.26 erfc approximation (|error| < 1.5e-7)."""
    x = z / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741
                                                       + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * poly * F.exp(-x * x)


def describe_clusters(df: DataFrame, *, cluster: str, cols: Sequence[str],
                      limit: float | None = None) -> DataFrame:
    """Per cluster and numeric variable: mean and population deviation in the
    cluster and overall, the v-test
    v = (m_c - m) / sqrt(s^2 / n_c * (N - n_c) / (N - 1)),
    its two-sided p-value, and the variable's eta^2 (between / total sum of
    squares). ``limit`` keeps |v| >= limit (1.96 in the source's tool)."""
    cols = list(cols)
    per = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_in"),
        *[F.avg(F.col(c).cast("double")).alias(f"__m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"__s_{i}") for i, c in enumerate(cols)])
    tot = df.agg(
        F.count(F.lit(1)).alias("n_all"),
        *[F.avg(F.col(c).cast("double")).alias(f"__M_{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"__S_{i}") for i, c in enumerate(cols)])
    # one row per variable: unpivot the one-row totals and the per-cluster rows
    tl = tot.select("n_all", F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"__M_{i}").alias("mean_all"),
                 F.col(f"__S_{i}").alias("sd_all")) for i, c in enumerate(cols)])).alias("t")
    ).select("n_all", "t.*")
    pl = per.select(cluster, "n_in", F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"__m_{i}").alias("mean_in"),
                 F.col(f"__s_{i}").alias("sd_in")) for i, c in enumerate(cols)])).alias("p")
    ).select(cluster, "n_in", "p.*")
    j = pl.join(tl, "variable", "inner")
    n_in, n_all = F.col("n_in").cast("double"), F.col("n_all").cast("double")
    sd = F.sqrt(F.col("sd_all") * F.col("sd_all") / n_in * ((n_all - n_in) / (n_all - 1)))
    v = F.try_divide(F.col("mean_in") - F.col("mean_all"), sd)
    out = j.select(cluster, "variable", F.col("n_in").cast("long").alias("n_in"), "mean_in",
                   "mean_all", "sd_in", "sd_all", v.alias("v_test"))
    out = out.withColumn("p_value", 2.0 * _norm_sf(F.abs(F.col("v_test"))))
    between = (F.col("n_in") * (F.col("mean_in") - F.col("mean_all"))
               * (F.col("mean_in") - F.col("mean_all")))
    eta = (j.groupBy("variable").agg(F.sum(between).alias("__b"),
                                     F.first(F.col("sd_all") * F.col("sd_all") * n_all)
                                     .alias("__t"))
           .select("variable", F.try_divide(F.col("__b"), F.col("__t")).alias("eta2")))
    out = out.join(eta, "variable", "inner")
    if limit is not None:
        out = out.where(F.abs(F.col("v_test")) >= limit)
    return out


def cluster_sizes(assign: DataFrame, cluster: str = "cluster") -> DataFrame:
    return assign.groupBy(cluster).agg(F.count(F.lit(1)).cast("long").alias("n"))

