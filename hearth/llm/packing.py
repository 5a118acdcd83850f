"""Padding-optimal length buckets and token-budget batches.

The global histogram of lengths goes to the driver; dynamic programming over
it chooses the bucket boundaries whose padding is least; rows then form
batches of a fixed token budget inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import fresh, global_rank, row_key
from hearth.plans.tables import table

BUCKETS, TOKEN_BUDGET = 16, 32_768
#: Lengths up to this are told apart one by one; above it in steps of 1/256 of their power of two, which bounds the histogram.
EXACT_LENGTHS = 65_536


def n_tokens(text: Column) -> Column:
    """Words and the end token; a null text has the end token only."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")) + 1).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The ``buckets`` (or fewer, if there are fewer lengths) bucket limits
    that minimise the sum of padded lengths; ``lengths`` ascend. Exact: the
    cost of a bucket is its limit times its count, whose optima are monotone,
    so each layer is solved by dividing at the middle."""
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    upto = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    limit = lengths.astype(np.float64)
    best = limit * upto[1:]  # one bucket for the first j + 1 lengths
    back = np.zeros((buckets, n), np.int64)
    for layer in range(1, buckets):
        new = np.full(n, np.inf)
        todo = [(layer, n - 1, layer, n - 1)]
        while todo:
            low, high, left, right = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(left, min(j, right) + 1)  # the last bucket holds lengths i to j
            cost = best[i - 1] + limit[j] * (upto[j + 1] - upto[i])
            at = int(cost.argmin())
            new[j], back[layer, j] = cost[at], i[at]
            todo += [(low, j - 1, left, int(i[at])), (j + 1, high, int(i[at]), right)]
        best = new
    out, j = [], n - 1
    for layer in range(buckets - 1, -1, -1):
        out.append(int(lengths[j]))
        j = back[layer, j] - 1
    return out[::-1]


def _binned(length: Column) -> Column:
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - 8))
    return F.when(length <= EXACT_LENGTHS, length).otherwise(
        (F.ceil(length / step) * step).cast("long")).cast("long")


def pack(df: DataFrame, length: str, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """``df`` with ``bucket`` (from 0), ``padded_length`` (the bucket's limit),
    ``batch`` (from 0 in its bucket), ``slot`` (from 0 in its batch) and
    ``padding``, under names that ``df`` does not use.

    A batch holds as many rows as the budget has padded lengths, one at least:
    a row longer than the budget is alone in its batch. Null or negative
    lengths count as 0. Repeated rows are packed one by one; rows that are
    equal in all columns are interchangeable. An empty table gives an empty
    result. The driver gets the histogram of lengths only, which
    ``EXACT_LENGTHS`` bounds whatever the number of rows."""
    bucket, padded, batch, slot, padding, rank, n, key = fresh(
        df, "bucket", "padded_length", "batch", "slot", "padding", "__rank", "__n", "__key")
    sized = df.withColumn(n, F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)))
    bins = _binned(F.col(n))
    found = sized.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("c")).orderBy("bin").collect()
    limits = optimal_boundaries(np.array([r[0] for r in found], np.int64),
                                np.array([r[1] for r in found], np.int64), buckets) or [0]
    bounds = F.array(*[F.lit(x).cast("long") for x in limits])
    placed = (sized.withColumn(bucket, F.size(F.filter(bounds, lambda b: b < bins)).cast("int"))
              .withColumn(padded, F.element_at(bounds, F.col(bucket) + 1))
              .withColumn(key, row_key(df)))
    ranked = global_rank(placed, [bucket], [F.xxhash64(key), F.col(key)], rank)
    room = F.greatest(F.floor(F.lit(token_budget) / F.greatest(F.col(padded), F.lit(1))), F.lit(1)).cast("long")
    return (ranked.withColumn(batch, F.floor(F.col(rank) / room).cast("long"))
            .withColumn(slot, F.pmod(F.col(rank), room).cast("int"))
            .withColumn(padding, F.col(padded) - F.col(n)).drop(rank, n, key))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", n_tokens(F.col("text")).alias("n_tokens")), "n_tokens")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
