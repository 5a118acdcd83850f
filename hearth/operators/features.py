"""Case-level feature operators: column groups, totals, label recodes,
plausibility filters, category encoding and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth import config as C
from hearth.functions import features as X
from hearth.operators.prefix import dense_codes


# --- P7 P8 P9 --------------------------------------------------------------------

def column_groups(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Named column groups, checked against the frame's columns."""
    missing = {g: [c for c in cols if c not in df.columns] for g, cols in groups.items()}
    missing = {g: m for g, m in missing.items() if m}
    if missing:
        raise ValueError(f"columns not in frame: {missing}")
    return {g: list(cols) for g, cols in groups.items()}


def default_groups() -> dict[str, list[str]]:
    return {"budget": C.BUDGET_COLUMNS, "other": C.OTHER_COLUMNS,
            "credit_totals": C.CREDIT_TOTALS, "credit_detail": C.CREDIT_DETAIL,
            "to_keep": C.OTHER_COLUMNS + C.CREDIT_DETAIL + C.CREDIT_TOTALS + C.BUDGET_COLUMNS}


def exclude_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


# --- P10 P11 P12 P13 -----------------------------------------------------------------

def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(cols))


def add_row_sum(df: DataFrame, out: str, cols: Sequence[str]) -> DataFrame:
    return df.withColumn(out, X.row_sum(cols))


def create_features(df: DataFrame, *, credit_detail: Sequence[str] = C.CREDIT_DETAIL,
                    income_cols: Sequence[str] = C.INCOME_COLUMNS,
                    charge_cols: Sequence[str] = C.CHARGE_COLUMNS,
                    orientation: str = "orientation", orientation_old: str = "orientation_old",
                    codes: Mapping[str, int] = C.ORIENTATION_CODES, adviser: str = "id_user",
                    missing_adviser: int = C.MISSING_ADVISER) -> DataFrame:
    """Credit detail NULL -> 0; instalment and balance totals; income and
    charge totals (null-skipping); old orientation label recoded and used when
    the new code is missing (<= 1); missing adviser -> 0."""
    detail = list(credit_detail)
    df = fill_zero(df, detail)
    inst = [c for c in detail if c.startswith("sum_mensualite_")]
    bal = [c for c in detail if c.startswith("sum_solde_")]
    old_code = X.map_values(orientation_old, codes, default=0)
    return df.withColumns({
        "sum_mensualite": X.row_sum(inst),
        "sum_solde": X.row_sum(bal),
        "revenus_tot": X.row_sum(income_cols),
        "charges": X.row_sum(charge_cols),
        orientation_old: old_code,
        orientation: X.backfill_label(orientation, old_code),
        adviser: F.coalesce(F.col(adviser), F.lit(missing_adviser)),
    })


# --- P14 P15 P16 P17 ---------------------------------------------------------------------

def filter_cases(df: DataFrame, *, orientation: str = "orientation", charges: str = "charges",
                 income: str = "revenus_tot", instalments: str = "sum_mensualite",
                 kept: tuple = C.ORIENTATION_KEPT, instalment_max: float = C.INSTALMENT_MAX
                 ) -> DataFrame:
    """Known orientation strictly inside ``kept``, positive charges, an
    income total, and 0 < instalments <= max."""
    o = F.col(orientation)
    return df.where((o > kept[0]) & (o < kept[1]) & (F.col(charges) > 0)
                    & F.col(income).isNotNull()
                    & (F.col(instalments) > 0) & (F.col(instalments) <= instalment_max))


def floor_filter(df: DataFrame, *, charges: str = "charges", income: str = "revenus_tot",
                 floor: float = C.FLOOR_AMOUNT) -> DataFrame:
    return df.where((F.col(charges) > floor) & (F.col(income) > floor))


def null_outliers(df: DataFrame, *, instalments: str = "sum_mensualite", age: str = "age",
                  dependants: str = "personne_charges", instalment_max=C.INSTALMENT_MAX,
                  age_range=C.AGE_RANGE, dependants_range=C.DEPENDANTS_RANGE) -> DataFrame:
    return df.withColumns({
        instalments: X.null_outside(instalments, 0, instalment_max, lo_open=True),
        age: X.null_outside(age, *age_range),
        dependants: X.null_outside(dependants, *dependants_range),
    })


def null_implausible(df: DataFrame, *, housing: str = "logement", tenant=C.TENANT_LABEL,
                     cols: Sequence[str] = C.TENANT_ZERO_COLUMNS) -> DataFrame:
    """For tenants, a zero amount in ``cols`` becomes NULL (to be imputed).
    ``tenant`` is compared on the housing label (before encoding)."""
    return df.withColumns({c: X.null_when((F.col(housing) == tenant) & (F.col(c) == 0), c)
                           for c in cols})


# --- E1 S8 --------------------------------------------------------------------------------

def encode_categories(df: DataFrame, cols: Sequence[str] | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """Each string column to codes 0..n-1 in code-point order of its labels
    (NULL, '0', 'nan' share the label 'None'). Returns the encoded frame and
    the mapping table (column, label, code).

    The codes are a distributed running count over the distinct labels; the
    frame is joined to its column's code table on the label (AQE broadcasts
    it when small, the usual case).
    """
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    cols = list(cols)
    if not cols:
        return df, df.sparkSession.createDataFrame([], "column string, label string, code int")
    labelled = df.withColumns({c: X.category_label(c) for c in cols})
    maps = []
    out = labelled
    for c in cols:
        codes = dense_codes(labelled, c, out="__code").select(
            F.col(c).alias("__lab"), "__code")
        out = (out.join(codes, out[c] == codes["__lab"], "left")
               .withColumn(c, F.col("__code")).drop("__lab", "__code"))
        maps.append(codes.select(F.lit(c).alias("column"), F.col("__lab").alias("label"),
                                 F.col("__code").alias("code")))
    mapping = maps[0]
    for m in maps[1:]:
        mapping = mapping.unionByName(m)
    return out.select(*df.columns), mapping


def apply_mapping(df: DataFrame, mapping: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Encode ``cols`` with a stored mapping table; unknown labels give NULL."""
    out = df
    for c in cols:
        m = mapping.where(F.col("column") == c).select(F.col("label").alias("__lab"),
                                                      F.col("code").alias("__code"))
        out = (out.withColumn(c, X.category_label(c))
               .join(m, F.col(c) == F.col("__lab"), "left")
               .withColumn(c, F.col("__code")).drop("__lab", "__code"))
    return out.select(*df.columns)


# --- I1 I2 I3 ------------------------------------------------------------------------------

def add_indicators(df: DataFrame, *, situation: str = "situation",
                   dependants: str = "personne_charges", income: str = "revenus_tot",
                   charges: str = "charges", instalments: str = "sum_mensualite",
                   balance: str = "sum_solde", couples: Sequence[str] = C.COUPLE_SITUATIONS,
                   couple: Column | None = None) -> DataFrame:
    """Consumption units ``u_c``, disposable income per unit ``rav`` and the
    income-to-balance ratio ``imc``. ``couple`` says which rows are couples
    where ``situation`` is encoded already."""
    if couple is not None:
        df = df.withColumn("u_c", X.units_of(couple, dependants))
    else:
        df = df.withColumn("u_c", X.consumption_units(situation, dependants, couples=couples))
    return df.withColumns({
        "rav": X.disposable_per_unit(income, charges, instalments, "u_c"),
        "imc": X.income_ratio(income, balance),
    })


# --- A8 -------------------------------------------------------------------------------------

def quality_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule: rows breaking it and their share (%) of all rows.
    A single aggregation pass, unpivoted with ``stack``."""
    names = list(rules)
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.coalesce(r, F.lit(False))).alias(f"__r{i}")
                   for i, r in enumerate(rules.values())])
    pairs = ", ".join(f"'{n}', __r{i}" for i, n in enumerate(names))
    return agg.select(F.expr(f"stack({len(names)}, {pairs}) AS (rule, n_rows)"), "__n").select(
        "rule", F.col("n_rows").cast("long").alias("n_rows"),
        F.round(F.try_divide(F.col("n_rows") * 100.0, F.col("__n")), 6).alias("pct"))
