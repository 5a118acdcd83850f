"""A uniform shuffle into shards of exact sizes.

Rows are dealt into source parts by a content hash. The communication matrix,
how many rows of each part go to each shard, is drawn exactly from the
multivariate hypergeometric law that a uniform shuffle of all rows would give
it. Each part is permuted locally, its permutation is cut by its row of the
matrix, rows go to their shards, and each shard is permuted again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import fresh, global_rank, row_key
from hearth.plans.tables import table

SEED = 7
ROWS_PER_PART = 250_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement are good: inversion on
    the probabilities around the mode, which follow from one another by exact
    ratios. Populations may have any size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    share = good / total
    spread = (draws * share * (1 - share) * max(total - draws, 1) / max(total - 1, 1)) ** 0.5
    reach = int(14 * spread) + 40
    left, right = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(left, right, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    log_p = np.concatenate(([0.0], np.cumsum(step)))
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return left + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def communication_matrix(parts: list[int], shards: list[int], seed: int = SEED) -> np.ndarray:
    """Exact counts with the row sums ``parts`` and the column sums ``shards``."""
    if sum(parts) != sum(shards):
        raise ValueError("rows and shard sizes differ")
    rng = np.random.default_rng(seed)
    left, out = list(shards), np.zeros((len(parts), len(shards)), np.int64)
    for i, n in enumerate(parts):
        room = sum(left)
        for j, c in enumerate(left):
            x = hypergeometric(rng, c, room - c, n)
            out[i, j] = x
            room -= c
            n -= x
        left = [c - x for c, x in zip(left, out[i].tolist())]
    return out


def deal(df: DataFrame, n_shards: int, seed: int = SEED, shard: str = "shard",
         slot: str = "slot", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``df`` with its shard (0 to ``n_shards`` - 1) and its slot in it
    (gapless from 0). Shard counts differ by one at most. The result depends
    on the rows and the seed alone, not on partitions or retries.

    What reaches the driver is the row count of each part and the matrix:
    one number for each part and shard, with ``rows_per_part`` rows a part.
    Fully repeated rows are interchangeable: which of them goes where is not
    told apart. Nulls are values like any other; an empty table gives an
    empty result."""
    spark = df.sparkSession
    key, part, local, cuts, k = fresh(df, "__key", "__part", "__local", "__cuts", "__k")
    keyed = df.withColumn(key, row_key(df))
    total = keyed.count()
    n_parts = max(1, -(-total // rows_per_part))
    keyed = keyed.withColumn(part, F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n_parts)).cast("int"))
    counts = {r[0]: r[1] for r in keyed.groupBy(part).count().collect()}
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([counts.get(i, 0) for i in range(n_parts)], sizes, seed)
    ends = spark.createDataFrame(
        [(i, row) for i, row in enumerate(np.cumsum(matrix, axis=1).tolist())],
        f"`{part}` int, `{cuts}` array<long>")
    # permute locally
    permuted = global_rank(keyed, [part], [F.xxhash64(key, F.lit(seed + 1))], local,
                           rows_per_part=4 * rows_per_part)
    # cut by the part's row of the matrix: the first shard whose end lies beyond the rank
    sent = permuted.join(ends, part).withColumn(
        shard, F.size(F.filter(cuts, lambda c: c <= F.col(local))).cast("int"))
    # exchange, and permute again
    out = global_rank(sent.drop(cuts), [shard], [F.xxhash64(key, F.lit(seed + 2)), F.col(key), F.col(part), F.col(local)],
                      slot, rows_per_part)
    return out.drop(key, part, local)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return deal(docs, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                                 "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLE_SQL: dict[str, str] = {}
