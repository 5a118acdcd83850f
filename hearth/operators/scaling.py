"""Standardisation (population deviation), its inverse, and PCA.

Statistics are one aggregation pass; the single row of per-column means and
deviations (bounded by the number of columns) is read on the driver and
applied as column arithmetic, so scaling stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stats = dict[str, tuple[float, float]]


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Stats:
    """Mean and population standard deviation per column (a zero or
    undefined deviation becomes 1, so constant columns scale to 0)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    out: Stats = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = (m, s if s not in (None, 0.0) else 1.0)
    return out


def standardize(df: DataFrame, stats: Mapping[str, tuple[float, float]],
                suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                           for c, (m, s) in stats.items()})


def inverse_scale(df: DataFrame, stats: Mapping[str, tuple[float, float]],
                  suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.col(c) * F.lit(s) + F.lit(m)
                           for c, (m, s) in stats.items()})


# --- array features ----------------------------------------------------------------------

def fit_array_scaler(df: DataFrame, vec: str, dim: int) -> tuple[list[float], list[float]]:
    """Per-coordinate mean and population deviation of an ARRAY<DOUBLE>."""
    v = F.col(vec)
    aggs = []
    for i in range(dim):
        aggs += [F.avg(v[i].cast("double")).alias(f"m{i}"),
                 F.stddev_pop(v[i].cast("double")).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    means = [row[f"m{i}"] for i in range(dim)]
    sds = [row[f"s{i}"] if row[f"s{i}"] not in (None, 0.0) else 1.0 for i in range(dim)]
    return means, sds


def standardize_array(vec: str | Column, means: Sequence[float], sds: Sequence[float]) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    m = F.array(*[F.lit(float(x)) for x in means])
    s = F.array(*[F.lit(float(x)) for x in sds])
    return F.transform(v, lambda x, i: (x.cast("double") - m[i]) / s[i])


def inverse_array(vec: str | Column, means: Sequence[float], sds: Sequence[float]) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    m = F.array(*[F.lit(float(x)) for x in means])
    s = F.array(*[F.lit(float(x)) for x in sds])
    return F.transform(v, lambda x, i: x * s[i] + m[i])


# --- PCA (E4 E5 E6) ---------------------------------------------------------------------------

def _features(df: DataFrame, cols: Sequence[str] | None, vec: str | None) -> DataFrame:
    if vec is not None:
        return df.withColumn("__features", array_to_vector(F.col(vec).cast("array<double>")))
    return VectorAssembler(inputCols=list(cols), outputCol="__features").transform(df)


def pca_variance(df: DataFrame, *, cols: Sequence[str] | None = None, vec: str | None = None,
                 dim: int | None = None) -> DataFrame:
    """Explained-variance ratio per component and its running total, from a
    PCA of the (already standardised) features. The d x d covariance is the
    only thing gathered on the driver (Spark ML's own plan)."""
    x = _features(df, cols, vec)
    d = dim or (len(cols) if cols is not None else len(x.first()["__features"]))
    model = PCA(k=d, inputCol="__features", outputCol="__pc").fit(x)
    ratios = [float(r) for r in model.explainedVariance.toArray()]
    rows, run = [], 0.0
    for i, r in enumerate(ratios):
        run += r
        rows.append((i, r, run))
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


def pca_components_kept(ratios: Sequence[float], threshold: float) -> int:
    """Components whose running total is below ``threshold`` (at least 1)."""
    run, k = 0.0, 0
    for r in ratios:
        run += r
        if run < threshold:
            k += 1
    return max(k, 1)


def pca_project(df: DataFrame, *, k: int, cols: Sequence[str] | None = None,
                vec: str | None = None, keep: Sequence[str] = (), out: str = "pcs",
                centre: bool = True) -> DataFrame:
    """Scores on the first ``k`` components, as ARRAY<DOUBLE> ``out``.
    Input is centred first (Spark's PCA transform does not centre)."""
    x = _features(df, cols, vec)
    if centre:
        from pyspark.ml.feature import StandardScaler
        x = (StandardScaler(withMean=True, withStd=False, inputCol="__features",
                            outputCol="__centred").fit(x).transform(x)
             .drop("__features").withColumnRenamed("__centred", "__features"))
    model = PCA(k=k, inputCol="__features", outputCol="__pc").fit(x)
    return model.transform(x).select(*keep, vector_to_array("__pc").alias(out))


def pca_reduce(df: DataFrame, *, threshold: float, cols: Sequence[str] | None = None,
               vec: str | None = None, keep: Sequence[str] = (), out: str = "pcs") -> DataFrame:
    """Keep the components whose cumulative explained variance is below
    ``threshold`` (at least one)."""
    var = pca_variance(df, cols=cols, vec=vec)
    k = pca_components_kept([r["ratio"] for r in var.orderBy("component").collect()], threshold)
    return pca_project(df, k=k, cols=cols, vec=vec, keep=keep, out=out)
