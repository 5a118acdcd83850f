"""Column expressions for case features. All are built-in Spark
expressions (whole-stage codegen), no Python UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearth import config as C


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Null-skipping sum across columns; NULL when every input is NULL."""
    arr = F.array(*[_c(c).cast("double") for c in cols])
    return F.aggregate(F.filter(arr, lambda x: x.isNotNull()), F.lit(None).cast("double"),
                       lambda acc, x: F.coalesce(acc, F.lit(0.0)) + x)


def map_values(col: str | Column, mapping: Mapping, default=0) -> Column:
    """Dictionary recode with a default for unknown and NULL keys."""
    if not mapping:
        return F.lit(default)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(col)), F.lit(default))


def backfill_label(new: str | Column, old_code: str | Column) -> Column:
    """Take the old code when the new one is at most 1 and the old one above 1."""
    new, old = _c(new), _c(old_code)
    return F.when((old > 1) & (new <= 1), old).otherwise(new)


def null_outside(col: str | Column, lo=None, hi=None, *, lo_open: bool = False,
                 hi_open: bool = False) -> Column:
    """Keep the value inside the range, NULL outside (NULL stays NULL)."""
    c = _c(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((c > lo) if lo_open else (c >= lo))
    if hi is not None:
        cond = cond & ((c < hi) if hi_open else (c <= hi))
    return F.when(cond, c)


def null_when(rule: Column, col: str | Column) -> Column:
    """NULL where ``rule`` is true, the value otherwise (also when the rule
    is NULL, e.g. missing housing: the positive form keeps the value)."""
    return F.when(rule, F.lit(None)).otherwise(_c(col))


def collapse_label(col: str | Column, src=C.CLASS_MIDDLE, dst=C.CLASS_ABOVE) -> Column:
    c = _c(col)
    return F.when(c == src, F.lit(dst)).otherwise(c)


def binary_label(col: str | Column, base=C.CLASS_ABOVE, step=2) -> Column:
    """(code - 2) / 2 truncated: 2 -> 0, 3 -> 0, 4 -> 1."""
    return ((_c(col) - base) / step).cast("int")


def label_name(col: str | Column, names: Mapping = C.ORIENTATION_NAMES) -> Column:
    return map_values(col, names, default=None)


def round_half_even(col: str | Column) -> Column:
    """Score to class with half-to-even rounding (0.5 -> 0, 1.5 -> 2)."""
    return F.bround(_c(col).cast("double"), 0).cast("int")


def consumption_units(situation: str | Column, dependants: str | Column, *,
                      couples: Sequence[str] = C.COUPLE_SITUATIONS,
                      single: float = C.UNITS_SINGLE, couple: float = C.UNITS_COUPLE,
                      per_dependant: float = C.UNITS_PER_DEPENDANT) -> Column:
    """1 (1.5 for couples) + 0.3 per dependant, on the situation label."""
    return units_of(_c(situation).isin(list(couples)), dependants, single=single, couple=couple,
                    per_dependant=per_dependant)


def units_of(is_couple: Column, dependants: str | Column, *, single: float = C.UNITS_SINGLE,
             couple: float = C.UNITS_COUPLE, per_dependant: float = C.UNITS_PER_DEPENDANT) -> Column:
    """Consumption units where it is known which rows are couples."""
    base = F.when(is_couple, F.lit(couple)).otherwise(F.lit(single))
    return base + F.lit(per_dependant) * _c(dependants)


def disposable_per_unit(income: str | Column, charges: str | Column,
                        instalments: str | Column, units: str | Column) -> Column:
    """(income - charges - instalments) / consumption units."""
    return F.try_divide(_c(income) - _c(charges) - _c(instalments), _c(units))


def income_ratio(income: str | Column, balance: str | Column) -> Column:
    """income / balance; x/0 with x > 0 (+inf) gives 0; 0/0 and x/0 with
    x < 0 give NULL."""
    i, b = _c(income).cast("double"), _c(balance).cast("double")
    return (F.when((b == 0) & (i > 0), F.lit(0.0))
            .when(b == 0, F.lit(None).cast("double"))
            .otherwise(i / b))


def category_label(col: str | Column, none_labels: Sequence[str] = C.NONE_LABELS) -> Column:
    """String label of a category: NULL, '0' and 'nan' become 'None'."""
    s = _c(col).cast("string")
    return F.when(s.isNull() | s.isin(list(none_labels)), F.lit("None")).otherwise(s)


def in_band(col: str | Column, lo: float, hi: float) -> Column:
    c = _c(col)
    return (c >= lo) & (c <= hi)
