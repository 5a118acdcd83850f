"""Relational operators: joins, keyed reductions, dedup, audits.

All reductions are hash/sort aggregates with partial (map-side) aggregation,
so a key holding a large share of the rows is collapsed before the shuffle (the
credits of a case, a few rows, are moved as they are); joins are on keys that are unique on at least one side after those
reductions, and AQE's skew-join split covers the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows whose keys one task groups, where a group holds few rows.
TASK_ROWS = 500_000


def _cols(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# --- J1 P2 P3 --------------------------------------------------------------

def attach_age(cases: DataFrame, births: DataFrame, *, case_id: str = "id",
               birth_id: str = "id", open_date: str = "date_ouverture",
               birth_year: str = "annee_naissance", out: str = "age") -> DataFrame:
    """All case columns plus the birth year and the age at opening
    (opening year minus birth year; may be negative, nulled later).
    Inner equi-join: cases without a birth year drop out."""
    b = births.select(F.col(birth_id).alias("__bid"), F.col(birth_year))
    j = cases.join(b, cases[case_id] == b["__bid"], "inner").drop("__bid")
    return j.withColumn(out, F.year(F.col(open_date)) - F.col(birth_year))


# --- A1 A2 A3 P6 -------------------------------------------------------------

def dealt_by_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the rows of a key together, in partitions that grow with its
    rows. For groups of few rows: adding those up before the shuffle would hold
    nearly every row of a file split in one task's hash map."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / TASK_ROWS))
    return df.repartition(parts, key)


def credits_by_type(credits: DataFrame, *, key: str = "id_dossier",
                    type_col: str = "type_credit",
                    measures: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (case, credit type) with the measures aggregated.

    ``measures`` maps an output name to an aggregate expression; the default
    is the instalment sum, the mean number of instalments and the balance sum.
    A case has few credits, so its rows move once, by case; the aggregates by
    type and :func:`pivot_measures` need no other shuffle.
    """
    if measures is None:
        measures = {
            "sum_mensualite": F.sum("mensualite"),
            "moy_nb_mensualite": F.avg("nb_mensualite"),
            "sum_solde": F.sum("solde"),
        }
    return dealt_by_key(credits, key).groupBy(key, type_col).agg(*[e.alias(n) for n, e in measures.items()])


def pivot_measures(by_type: DataFrame, *, key: str = "id_dossier",
                   type_col: str = "type_credit", measures: Sequence[str] = (
                       "sum_mensualite", "moy_nb_mensualite", "sum_solde"),
                   types: Iterable[int] = range(6), count_col: str = "nombre_credits"
                   ) -> DataFrame:
    """Spread each measure over the listed types into ``{measure}_{type}``
    columns, one row per case, plus ``count_col`` = number of (case, type)
    rows, i.e. distinct types including the NULL type (types outside the
    list count but spread nowhere). Conditional aggregation: one hash
    aggregate with partial aggregation, no wide intermediate."""
    types = list(types)
    aggs = [F.count(key).alias(count_col)]
    for m in measures:
        for t in types:
            aggs.append(F.sum(F.when(F.col(type_col) == F.lit(t), F.col(m))).alias(f"{m}_{t}"))
    return by_type.groupBy(key).agg(*aggs)


# --- A4 J4 -------------------------------------------------------------------

def first_per_key(df: DataFrame, *, key: str | Sequence[str] = "id_dossier",
                  order_col: str = "id_action", keep: Sequence[str] | None = None
                  ) -> DataFrame:
    """The row with the smallest ``order_col`` per key (the NULL key is a
    group of its own, as in GROUP BY). Rows whose ``order_col`` is NULL are
    never first, as MIN skips them; a key without any other drops out.
    Partial aggregation of a min struct: a hot key costs one struct per map
    task."""
    keys = _cols(key)
    rest = [c for c in (keep if keep is not None else df.columns) if c not in keys and c != order_col]
    m = df.where(F.col(order_col).isNotNull()).groupBy(*keys).agg(F.min(F.struct(F.col(order_col), *[F.col(c) for c in rest])).alias("__r"))
    return m.select(*keys, "__r.*")


def semi_join_in(df: DataFrame, col: str, sub: DataFrame, sub_col: str) -> DataFrame:
    """``WHERE col IN (SELECT sub_col FROM sub)``: a left-semi join (NULLs
    never match). The uncorrelated form of the source: with a non-unique id
    it keeps every row carrying one of the selected ids."""
    s = sub.select(F.col(sub_col).alias("__in")).where(F.col("__in").isNotNull())
    return df.join(s, df[col] == s["__in"], "left_semi")


def min_ids_in(df: DataFrame, *, key: str, id_col: str, use_max: bool = False) -> DataFrame:
    """Literal J4/A4 form: rows whose id is the min (or max) id of some key."""
    agg = F.max if use_max else F.min
    ids = df.groupBy(key).agg(agg(id_col).alias("__id"))
    return semi_join_in(df, id_col, ids, "__id")


# --- A5 J5 P4 P5 ---------------------------------------------------------------

def exclude_like(df: DataFrame, col: str, pattern: str, *, ignore_case: bool = False,
                 collation: str | None = None) -> DataFrame:
    """``col NOT LIKE pattern``; NULL values are dropped like in SQL.
    ``ignore_case`` compares as a case-insensitive collation does;
    ``collation`` names a collation to compare by (``UNICODE_CI_AI``: neither
    case nor accents count), for patterns whose only wildcards are a ``%`` at
    either end."""
    if collation is None:
        return df.where(~(F.col(col).ilike(pattern) if ignore_case else F.col(col).like(pattern)))
    word = pattern.strip("%")
    if "%" in word or "_" in word or "\\" in word:
        raise ValueError(f"a collated pattern may hold % at its ends only: {pattern}")
    text, head, tail = F.collate(F.col(col), collation), pattern.startswith("%"), pattern.endswith("%")
    if not word and pattern:
        like = text == text
    elif head and tail:
        like = F.contains(text, F.lit(word))
    elif head:
        like = F.endswith(text, F.lit(word))
    elif tail:
        like = F.startswith(text, F.lit(word))
    else:
        like = text == F.lit(word)
    return df.where(~like)


def keep_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """``col IN (values)``."""
    return df.where(F.col(col).isin(list(values)))


def latest_rows(df: DataFrame, *, key: str = "id_dossier", date_col: str = "dat_budget"
                ) -> DataFrame:
    """Rows whose date equals the latest date of their key, ties kept; rows
    with a NULL date or NULL key never qualify (correlated ``= (SELECT MAX)``).
    The per-key max is a partial aggregate; the semi-join back is on
    (key, date) and AQE splits a skewed key."""
    mx = (df.where(F.col(key).isNotNull() & F.col(date_col).isNotNull())
          .groupBy(key).agg(F.max(date_col).alias("__mx")))
    cond = (df[key] == mx[key]) & (df[date_col] == mx["__mx"])
    return df.join(mx, cond, "left_semi")


def latest_per_key(df: DataFrame, *, key: str = "id_dossier", date_col: str = "dat_budget",
                   id_col: str = "id_budget") -> DataFrame:
    """One row per key: latest date, then largest id. NULL dates, NULL keys and
    NULL ids drop out. Single partial aggregate of a (date, id, row) max struct."""
    rest = [c for c in df.columns if c not in (key, date_col, id_col)]
    m = (df.where(F.col(key).isNotNull() & F.col(date_col).isNotNull() & F.col(id_col).isNotNull())
         .groupBy(key)
         .agg(F.max(F.struct(F.col(date_col), F.col(id_col), *[F.col(c) for c in rest])).alias("__r")))
    return m.select(key, "__r.*").select(*df.columns)


def latest_per_key_literal(df: DataFrame, *, key: str = "id_dossier",
                           date_col: str = "dat_budget", id_col: str = "id_budget") -> DataFrame:
    """The source's two-step form: latest-date rows (ties kept), then rows whose
    id is the max id of some key among them (uncorrelated IN)."""
    tied = latest_rows(df, key=key, date_col=date_col)
    return min_ids_in(tied, key=key, id_col=id_col, use_max=True)


# --- J2 J3 P1 ------------------------------------------------------------------

def inner_dimension(facts: DataFrame, dim: DataFrame, *, left_key: str, right_key: str,
                    dim_cols: Sequence[str]) -> DataFrame:
    """Inner join to a (filtered) dimension, taking ``dim_cols`` from it. The
    planner broadcasts the dimension if its measured size allows."""
    d = dim.select(F.col(right_key).alias("__dk"), *dim_cols)
    return facts.join(d, facts[left_key] == d["__dk"], "inner").drop("__dk")


def require_unique(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df``, after raising if a non-NULL ``key`` occurs twice: joined on it,
    such a side would multiply the other's rows."""
    twice = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
             .where("n > 1").limit(3).collect())
    if twice:
        raise ValueError(f"{name}.{key} is not unique: {[r[0] for r in twice]}")
    return df


def left_attach(base: DataFrame, base_key: str, side: DataFrame, side_key: str,
                cols: Sequence[str] | None = None) -> DataFrame:
    """Left outer join of a side table keyed by ``side_key`` (unique after
    the reductions above); missing sides give NULL columns."""
    cols = [c for c in (cols if cols is not None else side.columns) if c != side_key]
    s = side.select(F.col(side_key).alias("__sk"), *cols)
    return base.join(s, base[base_key] == s["__sk"], "left").drop("__sk")


# --- A6 A7 A11 A12 ---------------------------------------------------------------

def row_audit(tables: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """One row per named stage: row count and distinct non-NULL keys."""
    parts = []
    for name, (df, key) in tables.items():
        n_keys = F.countDistinct(key) if key else F.lit(None)
        parts.append(df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                            n_keys.cast("long").alias("n_keys"))
                     .select(F.lit(name).alias("stage"), "n_rows", "n_keys"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_counts(df: DataFrame, col: str, *, dropna: bool = True) -> DataFrame:
    """Rows per value (NULL left out by default, like ``value_counts``)."""
    d = df.where(F.col(col).isNotNull()) if dropna else df
    return d.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("n"))


def distinct_values(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    return df.select(*_cols(cols)).distinct()


def merge_rare(df: DataFrame, col: str, *, floor: int, merged_value, out: str | None = None
               ) -> DataFrame:
    """Values with fewer than ``floor`` non-NULL rows become ``merged_value``;
    NULL stays NULL. Counts come from a partial aggregate joined back on the
    value (AQE broadcasts the count table when small, splits it when skewed)."""
    out = out or col
    cnt = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    cnt = cnt.select(F.col(col).alias("__v"), "__n")
    j = df.join(cnt, df[col] == cnt["__v"], "left")
    merged = F.when(F.col("__n") < floor, F.lit(merged_value).cast(df.schema[col].dataType)
                    ).otherwise(F.col(col))
    return j.withColumn(out, merged).drop("__v", "__n")


# --- A14 ------------------------------------------------------------------------

def consistency_check(df: DataFrame, *, id_col: str, invariant_cols: Sequence[str],
                      order_col: str, strict: bool = False) -> DataFrame:
    """Drop rows where columns that must not vary per id do vary.

    Walking rows in ``order_col`` order, the first row of every distinct
    invariant tuple that is not the id's first tuple is dropped (only that
    row; ``strict`` drops every row of such tuples). NULLs compare equal, as
    in a duplicate test. ``order_col`` must be unique.

    Built from two partial aggregates and an anti-join on the unique order
    column: no window over an id, so a hot id is not pulled into one task.
    """
    tup = list(dict.fromkeys([id_col, *invariant_cols]))
    firsts = df.groupBy(*tup).agg(F.min(order_col).alias("__f"))
    id_first = firsts.groupBy(id_col).agg(F.min("__f").alias("__f0"))
    later = (firsts.join(id_first.withColumnRenamed(id_col, "__id"),
                         firsts[id_col].eqNullSafe(F.col("__id")), "inner")
             .where(F.col("__f") > F.col("__f0")))
    if not strict:
        bad = later.select(F.col("__f").alias("__o"))
        return df.join(bad, df[order_col] == bad["__o"], "left_anti")
    bad_t = later.select(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(tup)])
    cond = None
    for i, c in enumerate(tup):
        e = df[c].eqNullSafe(bad_t[f"__t{i}"])
        cond = e if cond is None else cond & e
    return df.join(bad_t, cond, "left_anti")
