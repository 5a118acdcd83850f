"""Threshold rule on a score, fitted exactly, plus score-based metrics
(exact AUC, ROC points, accuracy, cross tables, histograms).

The fit replaces a scalar minimiser (which finds a local optimum of a step
function) by a sweep over every distinct score: rows are first reduced to
one row per (group, score) by a partial aggregate, then the error of every
candidate is read off distributed running sums (:mod:`hearth.operators.prefix`),
and the best candidate per group is a partial ``min`` aggregate. Nothing is
collected and no group is pulled into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth import config as C
from hearth.operators.prefix import running_sum
from hearth.session import cut_lineage


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- H1 H2 H3 ------------------------------------------------------------------------------

def threshold_predict(score: str | Column, t: str | Column | float | None, *,
                      above=C.CLASS_ABOVE, below=C.CLASS_BELOW) -> Column:
    """``above`` if score >= t else ``below``; a NULL score or a NULL
    threshold ("above every score") gives ``below``."""
    if t is None:
        t = F.lit(None).cast("double")
    elif not isinstance(t, (str, Column)):
        t = F.lit(t)
    else:
        t = _c(t)
    return F.when(_c(score) >= t, F.lit(above)).otherwise(F.lit(below))


def band_rule(pred: str | Column, ratio: str | Column, band: tuple = C.RATIO_BAND,
              middle=C.CLASS_MIDDLE) -> Column:
    """Three-class form: ratio inside [lo, hi] gives ``middle``."""
    r = _c(ratio)
    return F.when((r >= band[0]) & (r <= band[1]), F.lit(middle)).otherwise(_c(pred))


def accuracy(df: DataFrame, pred: str | Column, label: str | Column,
             group_by: Sequence[str] = ()) -> DataFrame:
    """Mean of (pred == label) (NULL compares unequal), with the row count."""
    eq = F.coalesce(_c(pred) == _c(label), F.lit(False)).cast("int")
    return df.groupBy(*group_by).agg(F.avg(eq).alias("accuracy"),
                                     F.count(F.lit(1)).cast("long").alias("n"))


def threshold_error(df: DataFrame, score: str, label: str, t, *, above=C.CLASS_ABOVE,
                    below=C.CLASS_BELOW) -> DataFrame:
    """1 - accuracy of the rule at threshold ``t`` (one row)."""
    p = threshold_predict(score, t, above=above, below=below)
    return accuracy(df, p, label).select((1 - F.col("accuracy")).alias("error"), "n")


# --- H4 H5 ----------------------------------------------------------------------------------

def fit_threshold(df: DataFrame, *, score: str, label: str, above=C.CLASS_ABOVE,
                  below=C.CLASS_BELOW, group_by: Sequence[str] = ()) -> DataFrame:
    """Threshold minimising the rule's errors, per group.

    Candidates are every distinct non-NULL score plus "above all scores"
    (everything predicted ``below``), reported as a NULL threshold. Ties go
    to the smallest threshold, "above all" last. Output: group columns,
    ``threshold``, ``n_err``, ``n``, ``error``.
    """
    groups = list(group_by)
    lab = F.col(label)
    g = df.groupBy(*groups, F.col(score).alias("__s")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(F.coalesce(lab == above, F.lit(False))).alias("__na"),
        F.count_if(F.coalesce(lab == below, F.lit(False))).alias("__nb"))
    g = g.select(*groups, "__s", "__n", (F.col("__n") - F.col("__na")).alias("__not_a"),
                 (F.col("__n") - F.col("__nb")).alias("__not_b"))
    tot_aggs = [
        F.sum("__n").alias("__N"),
        F.coalesce(F.sum(F.when(F.col("__s").isNotNull(), F.col("__not_a"))), F.lit(0))
        .alias("__tot_not_a"),
        F.coalesce(F.sum(F.when(F.col("__s").isNotNull(), F.col("__not_b"))), F.lit(0))
        .alias("__tot_not_b"),
        F.coalesce(F.sum(F.when(F.col("__s").isNull(), F.col("__not_b"))), F.lit(0))
        .alias("__null_err")]
    g = cut_lineage(g, "score-counts")
    scored = running_sum(g.where(F.col("__s").isNotNull()), order_by=["__s"],
                         sums=["__not_a", "__not_b"], partition_by=groups, inclusive=False,
                         prefix="__lt")
    if groups:
        tot = g.groupBy(*groups).agg(*tot_aggs)
        tot_j = tot.select(*[F.col(c).alias(f"__g_{c}") for c in groups], "__N",
                           "__tot_not_a", "__tot_not_b", "__null_err")
        cond = [scored[c].eqNullSafe(tot_j[f"__g_{c}"]) for c in groups]
        j = scored.join(tot_j, cond, "inner")
        tcols = {c: F.col(c) for c in ("__N", "__tot_not_a", "__tot_not_b", "__null_err")}
    else:
        # ungrouped: the four totals are one row, read as literals
        row = g.agg(*tot_aggs).first()
        if row["__N"] is None:
            return df.sparkSession.createDataFrame(
                [], f"threshold {g.schema['__s'].dataType.simpleString()}, n_err long, "
                    "n long, error double")
        j = scored
        tcols = {c: F.lit(row[c]) for c in ("__N", "__tot_not_a", "__tot_not_b", "__null_err")}
        tot = None
    cand = j.select(
        *groups,
        (tcols["__tot_not_a"] - F.col("__lt__not_a") + F.col("__lt__not_b")
         + tcols["__null_err"]).alias("__e"),
        F.lit(0).alias("__last"), F.col("__s").alias("__t"))
    if groups:
        above_all = tot.select(*groups, (F.col("__tot_not_b") + F.col("__null_err")).alias("__e"),
                               F.lit(1).alias("__last"),
                               F.lit(None).cast(g.schema["__s"].dataType).alias("__t"))
        best = cand.unionByName(above_all).groupBy(*groups).agg(
            F.min(F.struct("__e", "__last", "__t")).alias("__b"))
        out = best.join(tot.select(*groups, "__N"), groups, "inner")
        n_col = F.col("__N")
    else:
        e_all = int(row["__tot_not_b"]) + int(row["__null_err"])
        above_all = df.sparkSession.createDataFrame(
            [(e_all, 1, None)], f"__e long, __last int, __t {g.schema['__s'].dataType.simpleString()}")
        out = cand.select("__e", "__last", "__t").unionByName(above_all).agg(
            F.min(F.struct("__e", "__last", "__t")).alias("__b"))
        n_col = F.lit(row["__N"])
    return out.select(*groups, F.col("__b.__t").alias("threshold"),
                      F.col("__b.__e").cast("long").alias("n_err"),
                      n_col.cast("long").alias("n"),
                      (F.col("__b.__e") / n_col).alias("error"))


def apply_thresholds(df: DataFrame, fitted: DataFrame, *, score: str, group_by: Sequence[str],
                     out: str = "pred", above=C.CLASS_ABOVE, below=C.CLASS_BELOW) -> DataFrame:
    """Lookup join of the per-group thresholds (one row per group), then the
    rule. Groups without a fitted threshold are predicted ``below``. For a
    single global threshold use :func:`threshold_predict` with its value."""
    t = fitted.select(*[F.col(c).alias(f"__g_{c}") for c in group_by],
                      F.col("threshold").alias("__t"))
    cond = [df[c].eqNullSafe(t[f"__g_{c}"]) for c in group_by]
    j = df.join(t, cond, "left")
    return j.withColumn(out, threshold_predict(score, "__t", above=above, below=below)).drop(
        "__t", *[f"__g_{c}" for c in group_by])


def fit_threshold_held_out(df: DataFrame, *, score: str, label: str, fold: str, n_folds: int, above=C.CLASS_ABOVE,
                           below=C.CLASS_BELOW, group_by: Sequence[str] = ()) -> DataFrame:
    """For each group and each fold the threshold fitted on the group's other
    folds: group columns, ``fold``, ``threshold``, ``n_err`` (on those other
    folds), by the rules of :func:`fit_threshold`.

    One sweep serves all folds: the running errors are kept by fold, and those
    of all folds but one are the sum of all less that one's."""
    groups, lab, held = list(group_by), F.col(label), range(n_folds)
    keys = groups or ["__all"]
    wrong = lambda c, f: F.count_if((F.col(fold) == f) & ~F.coalesce(lab == c, F.lit(False)))
    counts = (df if groups else df.withColumn("__all", F.lit(0))).where(F.col(fold).isNotNull()).groupBy(
        *keys, F.col(score).alias("__s")).agg(
        *[F.count_if(F.col(fold) == f).alias(f"__n{f}") for f in held],
        *[wrong(above, f).alias(f"__a{f}") for f in held], *[wrong(below, f).alias(f"__b{f}") for f in held])
    counts = cut_lineage(counts, "score-counts")
    scored = running_sum(counts.where(F.col("__s").isNotNull()), order_by=["__s"], partition_by=keys, inclusive=False,
                         sums=[f"__{c}{f}" for c in "ab" for f in held], prefix="__lt")
    known = F.col("__s").isNotNull()
    at_or = lambda c, f, here: F.coalesce(F.sum(F.when(here, F.col(f"__{c}{f}"))), F.lit(0))
    totals = counts.groupBy(*keys).agg(
        *[at_or("a", f, known).alias(f"__ta{f}") for f in held], *[at_or("b", f, known).alias(f"__tb{f}") for f in held],
        *[at_or("b", f, ~known).alias(f"__null{f}") for f in held])
    own = totals.select(*[F.col(k).alias(f"__t_{k}") for k in keys], *[c for c in totals.columns if c not in keys])
    joined = scored.join(own, [F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in keys])

    def but(column, f):
        """The sum over all folds but ``f``."""
        return sum(column(j) for j in held) - column(f)
    error = lambda j: F.col(f"__ta{j}") - F.col(f"__lt__a{j}") + F.col(f"__lt__b{j}") + F.col(f"__null{j}")
    none = lambda j: F.col(f"__tb{j}") + F.col(f"__null{j}")
    choice = lambda f, e, last, t: F.struct(F.lit(f).alias("f"), e.cast("long").alias("e"), F.lit(last).alias("last"),
                                            t.cast(counts.schema["__s"].dataType).alias("t"))
    of = [F.when(but(lambda j: F.col(f"__n{j}"), f) > 0, choice(f, but(error, f), 0, F.col("__s"))) for f in held]
    every = joined.select(*keys, F.explode(F.array(*of)).alias("c")).where(F.col("c").isNotNull()).unionByName(
        totals.select(*keys, F.explode(F.array(*[choice(f, but(none, f), 1, F.lit(None)) for f in held])).alias("c")))
    best = every.groupBy(*keys, F.col("c.f").alias(fold)).agg(F.min(F.struct("c.e", "c.last", "c.t")).alias("b"))
    return best.select(*groups, fold, F.col("b.t").alias("threshold"), F.col("b.e").alias("n_err"))


# --- V9 V10 ---------------------------------------------------------------------------------

def _score_counts(df: DataFrame, score: str, label: str, positive, group_by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives of each distinct score (of each group),
    materialised: the input is scanned once, whatever reads the counts."""
    pos = F.coalesce(F.col(label) == positive, F.lit(False)).cast("long")
    counts = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(*group_by, F.col(score).alias("__s"))
              .agg(F.sum(pos).alias("__p"), F.sum(1 - pos).alias("__q")))
    return cut_lineage(counts, "score-counts")


def roc_auc(df: DataFrame, *, score: str, label: str, positive=1, group_by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve (ties count one half), one row (or one
    for each group, all in one job) ``auc`` (NULL when a class is missing),
    ``n_pos``, ``n_neg``.

    AUC = sum over distinct scores of p * (negatives below + q / 2) / (P * N),
    summed as exact DECIMAL(38,0) integers (2x the numerator), so the result
    does not depend on the summation order.
    """
    groups = list(group_by)
    g = _score_counts(df, score, label, positive, groups)
    r = running_sum(g, order_by=["__s"], sums=["__q"], partition_by=groups, inclusive=False, prefix="__lt")
    num = F.col("__p").cast("decimal(38,0)") * (2 * F.col("__lt__q") + F.col("__q"))
    a = r.groupBy(*groups).agg(F.sum(num).alias("__num"), F.sum("__p").alias("n_pos"), F.sum("__q").alias("n_neg"))
    den = (2 * F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))
    return a.select(
        *groups, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("__num").cast("double") / den)
        .alias("auc"),
        F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


def roc_curve(df: DataFrame, *, score: str, label: str, positive=1) -> DataFrame:
    """ROC points, one per distinct score (descending), plus the origin with a
    NULL threshold: ``threshold, tp, fp, tpr, fpr``."""
    g = _score_counts(df, score, label, positive)
    r = running_sum(g, order_by=["__s"], descending=True, sums=["__p", "__q"], inclusive=True,
                    prefix="__ge")
    tot = g.agg(F.sum("__p").alias("P"), F.sum("__q").alias("N")).first()
    pts = r.select(F.col("__s").alias("threshold"), F.col("__ge__p").alias("tp"),
                   F.col("__ge__q").alias("fp"))
    origin = df.sparkSession.createDataFrame(
        [(None, 0, 0)], f"threshold {g.schema['__s'].dataType.simpleString()}, tp long, fp long")
    pts = pts.unionByName(origin)
    big_p, big_n = F.lit(tot["P"]).cast("double"), F.lit(tot["N"]).cast("double")
    return pts.select("threshold", F.col("tp").cast("long").alias("tp"),
                      F.col("fp").cast("long").alias("fp"),
                      F.try_divide(F.col("tp").cast("double"), big_p).alias("tpr"),
                      F.try_divide(F.col("fp").cast("double"), big_n).alias("fpr"))


# --- A9 A13 ---------------------------------------------------------------------------------

def crosstab_long(df: DataFrame, row: str | Column, col: str | Column, *,
                  row_name: str = "predicted", col_name: str = "actual") -> DataFrame:
    """Cross table in long form: one row per observed (row, col) pair with its
    count (NULLs left out, as a crosstab does)."""
    r, c = _c(row).alias(row_name), _c(col).alias(col_name)
    x = df.select(r, c).where(F.col(row_name).isNotNull() & F.col(col_name).isNotNull())
    return x.groupBy(row_name, col_name).agg(F.count(F.lit(1)).cast("long").alias("n"))


def crosstab_wide(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Cross table with one column per listed ``col`` value (0 when absent)."""
    return df.groupBy(row).pivot(col, list(values)).count().na.fill(0)


def histogram(df: DataFrame, value: str, *, bins: int = C.HIST_BINS,
              lo: float = C.HIST_RANGE[0], hi: float = C.HIST_RANGE[1],
              group_by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram on [lo, hi]; the top edge falls in the last bin,
    values outside the range are left out. Density = n / (in-range n * width).
    Output: groups, ``bin`` (1-based), ``lo``, ``hi``, ``n``, ``density``."""
    width = (hi - lo) / bins
    group_by = list(group_by)
    v = F.col(value)
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins)).cast("int")
    x = df.where((v >= lo) & (v <= hi)).select(*group_by, b.alias("bin"))
    h = x.groupBy(*group_by, "bin").agg(F.count(F.lit(1)).cast("long").alias("n"))
    # at most ``bins`` rows per group: the window is bounded
    w = Window.partitionBy(*group_by) if group_by else Window.partitionBy(F.lit(0))
    return h.select(*group_by, "bin",
                    (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("hi"), "n",
                    (F.col("n") / (F.sum("n").over(w) * F.lit(width))).alias("density"))
