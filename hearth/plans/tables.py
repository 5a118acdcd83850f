"""Loading the driver's parquet tables, and output-column normalisation
shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def day(c: str | Column) -> Column:
    """Timestamp/date to a 'yyyy-MM-dd' string (engine-neutral output)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd")


def dbl(c: str | Column, digits: int | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.round(c, digits) if digits is not None else c


def lng(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long")


def money(c: str | Column) -> Column:
    """Exact cents: aggregate money as DECIMAL(18,2) so sums do not depend
    on row order."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,2)")
