"""Hard-negative mining by threshold joins with suffix-norm bounds.

Every window (an anchor's nearest rows of its own label; the rows of other
labels that score close below one of them) is a threshold join of a stated
query set against all rows. A shard indexes its rows by groups of dimensions,
strongest first, and leaves out the trailing dimensions of a row whose norm
times the longest query stays below the threshold. Partial scores are summed
group by group, rows are dropped as soon as their score and the norms that
remain can't reach the threshold, and what the index left out is added for the
rows still in. A window that stays short lowers its threshold, to its own
lower end at last, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.llm.common import stored
from hearth.plans.tables import table

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100  # LOW and HIGH in hundredths of the positive's score
CELLS_PER_SHARD, QUERIES_PER_BLOCK = 1 << 19, 8192
QUERIES_AT_ONCE, GROUPS = 128, 4
#: How far, between its upper and lower end, a window's threshold is lowered each time.
LEVELS = (0.25, 0.375, 0.5, 1.0)
WIDE = 1 << 62


class SuffixIndex:
    """Rows of ``x`` for queries of norm up to ``reach`` and thresholds of at
    least ``floor``."""

    def __init__(self, x: np.ndarray, floor: float, reach: float, groups: int = GROUPS):
        d = x.shape[1]
        self.order = np.argsort(-np.einsum("ij,ij->j", x, x), kind="stable")
        x = x[:, self.order]
        self.edges = np.unique(np.linspace(0, d, groups + 1).astype(int))
        tail = np.sqrt(np.stack([(x[:, e:] ** 2).sum(axis=1) for e in self.edges], axis=1))
        under = tail * reach * (1 + 1e-9) < floor
        kept = np.where(under.any(axis=1), under.argmax(axis=1), len(self.edges) - 1)
        self.rows = np.argsort(-kept, kind="stable")  # so the postings of a group are the first rows
        self.x, self.tail, self.kept = x[self.rows], tail[self.rows], kept[self.rows]
        self.touched = 0

    def at_least(self, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, row, score)`` of all pairs that score ``t`` or more."""
        q = q[:, self.order]
        q_tail = np.sqrt(np.stack([(q[:, e:] ** 2).sum(axis=1) for e in self.edges], axis=1))
        at = np.arange(np.searchsorted(-self.kept, 0, side="left"))
        score, ok = np.zeros((len(at), len(q))), np.ones((len(at), len(q)), bool)
        for g, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            kept = self.kept[at]
            n = np.searchsorted(-kept, -g, side="left")
            score[:n] += self.x[at[:n], a:b] @ q[:, a:b].T
            self.touched += n * (b - a)
            done = np.minimum(kept, g + 1)
            rest = self.tail[at, done][:, None] * q_tail.T[done]
            ok = score + rest * (1 + 1e-9) + 0.5 >= t
            some = ok.any(axis=1)
            at, score, ok = at[some], score[some], ok[some]
        left_out = np.arange(self.x.shape[1]) >= self.edges[self.kept[at]][:, None]
        score += (self.x[at] * left_out) @ q.T
        row, query = np.nonzero(ok & (score >= t))
        return query, self.rows[at[row]], score[row, query]


def fill_windows(x, ids, labels, q, q_ids, q_labels, low, high, sure, k: int, same: bool):
    """``(query, row, score)``: the ``k`` best rows of each query within
    ``low <= score <= high`` whose label is the query's (``same``) or another,
    best first, ties by smaller id; a query's own id is no row. Thresholds
    start near ``high`` and are lowered until ``k`` rows are found or ``low``
    is reached; where ``sure``, ``low`` is known to be near and taken at once."""
    if len(x) and max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) ** 2 * x.shape[1] >= 2 ** 53:
        raise ValueError("components too large for exact scores in double precision")
    norm = np.sqrt((q ** 2).sum(axis=1))
    longest = np.sqrt((x ** 2).sum(axis=1).max(initial=0.0))
    top = np.minimum(high, np.ceil(norm * longest * (1 + 1e-9)))
    bottom = np.maximum(low, -np.ceil(norm * longest * (1 + 1e-9)))
    left, out = np.flatnonzero(bottom <= top), []
    for level in LEVELS if len(x) else ():
        if not len(left):
            break
        part = np.where(sure[left], 1.0, level)
        t = np.where(part < 1, np.ceil(top[left] - (top[left] - bottom[left]) * part), bottom[left])
        index, short = SuffixIndex(x, t.min(), norm[left].max()), []
        for a in range(0, len(left), QUERIES_AT_ONCE):
            mine, least = left[a:a + QUERIES_AT_ONCE], t[a:a + QUERIES_AT_ONCE]
            query, row, score = index.at_least(q[mine], least)
            who = mine[query]
            fits = (score <= high[who]) & ((labels[row] == q_labels[who]) == same) & (ids[row] != q_ids[who])
            who, row, score = who[fits], row[fits], score[fits]
            order = np.lexsort((ids[row], -score, who))
            who, row, score = who[order], row[order], score[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            full = np.bincount(who, minlength=len(q))[mine] >= k
            over = full | (part[a:a + QUERIES_AT_ONCE] == 1)
            take = (rank < k) & np.isin(who, mine[over])
            out.append((who[take], row[take], score[take]))
            short.append(mine[~over])
        left = np.concatenate(short)
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


_QUERY = ["anchor_id", "anchor_hash", "positive_id", "positive_score"]
_FOUND = "anchor_id long, anchor_hash long, positive_id long, positive_score long, vec_id long, score long"


def _search_shard(k: int, same: bool):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        widths, q_widths = rows["vector"].map(len), queries["vector"].map(len)
        for width in sorted(set(q_widths) & set(widths)):
            own, of_q = rows[widths == width], queries[q_widths == width]
            # rows of one label are joined alone; other labels all together
            groups = [(own[own["label"] == c], g) for c, g in of_q.groupby("label")] if same else [(own, of_q)]
            for r, g in groups:
                if not len(r):
                    continue
                matrix = lambda v: np.stack(v).astype(np.float64).reshape(len(v), width)
                who, row, score = fill_windows(
                    matrix(r["vector"].to_list()), r["vec_id"].to_numpy(), r["label"].to_numpy(),
                    matrix(g["vector"].to_list()), g["anchor_id"].to_numpy(), g["label"].to_numpy(),
                    g["low"].to_numpy().astype(float), g["high"].to_numpy().astype(float), g["sure"].to_numpy(), k, same)
                found = g[_QUERY].iloc[who].reset_index(drop=True)
                found["vec_id"], found["score"] = r["vec_id"].to_numpy()[row], score.astype(np.int64)
                out.append(found)
        found = pd.concat(out) if out else pd.DataFrame({c: [] for c in [*_QUERY, "vec_id", "score"]})
        for c in found:  # positives have no positive of their own yet
            found[c] = found[c].astype("Int64")
        return found
    return run


def _in_windows(rows: DataFrame, queries: DataFrame, shards: int, k: int, same: bool, per_block: int) -> DataFrame:
    """The best ``k`` of all shards for each query, with ``rank``."""
    def search(rows: DataFrame, queries: DataFrame, shards: int) -> DataFrame:
        r = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        q = (queries.withColumn("block", F.pmod(F.xxhash64("anchor_id", "anchor_hash", "positive_id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
        found = r.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInPandas(
            _search_shard(k, same), _FOUND)
        best = Window.partitionBy(*_QUERY).orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    blocks = max(1, -(-queries.count() // per_block))
    if shards > 1:
        # what one shard's k-th row reaches, no other shard needs to go below
        first = search(rows.where(F.col("shard") == 0), queries, 1)
        floors = first.groupBy(*_QUERY[:3]).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(
            F.col("n") == k).select(*[F.col(c).alias(f"f_{c}") for c in _QUERY[:3]], "floor")
        same_query = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in _QUERY[:3]]
        queries = queries.join(floors, same_query, "left").withColumn("sure", F.col("floor").isNotNull()).withColumn(
            "low", F.greatest("low", "floor")).drop("floor", *[f"f_{c}" for c in _QUERY[:3]])
    return search(rows, queries, shards)


def mine_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, cells_per_shard: int = CELLS_PER_SHARD,
                   queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for ``rows(vec_id, label, vector of integers)`` and
    ``anchors`` of the same columns.

    An anchor's positives are its ``positives`` best other rows of its label by
    inner product; for each of them the ``negatives`` best rows of another
    label are returned whose score lies between ``low`` and ``high`` hundredths
    of the positive's. Ties go to the smaller id. Rows with a null id, label or
    vector, or a null component, take no part; vectors meet those of their own
    length; a row of the anchor's own id is neither. Repeated rows count once;
    unlike rows of one id are rows of their own (as anchors, each has its own
    positives). Windows with fewer rows give fewer; an empty table gives none.
    Scores must be below 2**53, larger components raise.

    Rows are dealt to shards of a bounded number of components by a hash of
    the id, so a hot label is spread over all of them. Anchors stand in blocks,
    and a task holds one shard and one block."""
    def clean(df: DataFrame) -> DataFrame:
        whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                         F.col("vector").cast("array<long>").alias("vector")).where(
            F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False))).dropDuplicates()

    own, _ = stored(clean(rows), "negatives-rows")
    cells = own.agg(F.sum(F.size("vector"))).first()[0] or 0
    shards = max(1, -(-cells // cells_per_shard))
    own = own.withColumn("shard", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(shards)).cast("int"))
    nothing = F.lit(None).cast("long")
    q = clean(anchors).select(
        F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "vector").alias("anchor_hash"), "label", "vector",
        nothing.alias("positive_id"), nothing.alias("positive_score"),
        F.lit(-WIDE).alias("low"), F.lit(WIDE).alias("high"), F.lit(False).alias("sure"))
    found = _in_windows(own, q, shards, positives, True, queries_per_block)
    best, _ = stored(found.select("anchor_id", "anchor_hash", F.col("vec_id").alias("positive_id"),
                                  F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")), "negatives-positives")
    score = F.col("positive_score")
    windows = (q.drop("positive_id", "positive_score", "low", "high")
               .join(best.drop("positive_rank"), ["anchor_id", "anchor_hash"])
               .withColumn("low", F.ceil(score * low / F.lit(100.0)))
               .withColumn("high", F.floor(score * high / F.lit(100.0))).where(F.col("low") <= F.col("high")))
    found = _in_windows(own, windows, shards, negatives, False, queries_per_block)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: components times 256, rounded down; every
    seventh row gets the next of ten labels. Vectors with non-finite
    components become null."""
    x = lambda c: c.cast("double")
    finite = ~F.exists("embedding", lambda c: F.isnan(c) | (F.abs(x(c)) == float("inf")))
    label = F.col("label").cast("long")
    return embeddings.select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.when(F.coalesce(finite, F.lit(True)), F.transform("embedding", lambda c: F.floor(256 * x(c)))).alias("vector"))


def anchors_of(rows: DataFrame, every: int = 100) -> DataFrame:
    return rows.where(_divisible(F.col("vec_id"), every))


def _divisible(c: Column, by: int) -> Column:
    return c % by == 0


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return mine_negatives(rows, anchors_of(rows))


_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INT) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
   AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE_SQL = {"op11_hard_negatives": _SQL}
