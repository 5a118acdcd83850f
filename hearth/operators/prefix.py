"""Distributed running sums (prefix sums) in a total order.

A window with no ``partitionBy`` (or partitioned by a key that may hold a
third of all rows) sends every row of the partition to one task. Here rows
are put into buckets of the order instead. The bucket is a column, a pure
function of the row's own values: every branch of the plan, every job and
every retry computes the same one. Each (group, bucket) is summed alone, and
the totals of the buckets before it are the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.session import cut_lineage

#: Rows drawn for each bucket to place the bounds between buckets.
SAMPLES_PER_BUCKET = 40


def bucket_bounds(df: DataFrame, cols: Sequence[str], buckets: int) -> list[tuple]:
    """Up to ``buckets - 1`` ascending tuples of ``cols`` that cut the rows
    into parts of about equal size. Taken from the rows with the smallest
    hashes, so equal tables give equal bounds; the driver gets
    ``SAMPLES_PER_BUCKET * buckets`` distinct tuples at most."""
    if buckets < 2:
        return []
    draw = (df.select(*cols, F.xxhash64(*cols).alias("__draw")).distinct()
            .orderBy("__draw", *cols).limit(SAMPLES_PER_BUCKET * buckets).drop("__draw"))
    rows = [tuple(r) for r in draw.orderBy(*cols).collect()]
    step = len(rows) / buckets
    return list(dict.fromkeys(rows[int(step * k)] for k in range(1, buckets))) if rows else []


def bucket_of(df: DataFrame, cols: Sequence[str], bounds: Sequence[tuple]) -> Column:
    """How many of the ascending ``bounds`` a row's tuple of ``cols`` has
    reached, by binary search: a step for each power of two below their number."""
    if not bounds:
        return F.lit(0)
    types = [df.schema[c].dataType for c in cols]
    lits = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(b, types, cols)])
                     for b in bounds])
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    row = F.struct(*cols)
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(lits, at + half - 1) <= row, at + half).otherwise(at))


def running_sum(df: DataFrame, *, order_by: Sequence[str], sums: Sequence[str],
                partition_by: Sequence[str] = (), inclusive: bool = True,
                descending: bool = False, bucket: Column | None = None,
                num_partitions: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``{prefix}{c}`` = running sum of ``c`` within ``partition_by``
    following the columns ``order_by`` (``descending``: all of them turned
    round). ``inclusive`` includes the current row; otherwise the sum of the
    strictly earlier rows. Ties in ``order_by`` are summed in an arbitrary
    order, so use a unique order (e.g. after grouping by the order key).

    ``bucket`` is an integer expression that never falls while ``order_by``
    rises, for orders that are uniform by nature (a hash prefix); without it
    bounds are placed by :func:`bucket_bounds`.

    Shuffles: one exchange of the rows on (group, bucket). Bucket totals are
    combined before theirs, and travel with the rows as one more row at the
    head of each bucket. ``df`` is read twice (three times without
    ``bucket``); materialise it when that is dear.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, order = list(partition_by), list(order_by)
    if bucket is None:
        keys = [*parts, *order]
        bucket = bucket_of(df, keys, bucket_bounds(df, keys, n))
    marked = df.withColumn("__bucket", bucket)
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = marked.groupBy(*parts, "__bucket").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = (Window.partitionBy(*(parts or [F.lit(0)])).orderBy(turn("__bucket"))
               .rowsBetween(Window.unboundedPreceding, -1))
    heads = totals.select(*parts, "__bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums],
                          F.lit(True).alias("__head"))
    rows = marked.withColumn("__head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    upto = (Window.partitionBy(*parts, "__bucket").orderBy(F.col("__head").desc(), *map(turn, order))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
    out = rows.select("*", *[F.sum(c).over(upto).alias(f"{prefix}{c}") for c in sums])
    return out.where(~F.col("__head")).select(*df.columns, *[f"{prefix}{c}" for c in sums])


def dense_codes(df: DataFrame, col: str, *, out: str = "code", partition_by: Sequence[str] = ()
                ) -> DataFrame:
    """Distinct values of ``col`` (per ``partition_by``) with their 0-based
    rank in ascending (code-point) order, computed as a distributed running
    count over the distinct values."""
    parts = list(partition_by)
    d = cut_lineage(df.select(*parts, col).distinct(), "distinct").withColumn("__one", F.lit(1))
    r = running_sum(d, order_by=[col], sums=["__one"], partition_by=parts, inclusive=False,
                    prefix="__rk")
    return r.select(*parts, col, F.col("__rk__one").cast("int").alias(out))
