"""Nearest neighbours by inner product with vantage-point trees per shard.

Rows are hashed into shards; each shard builds a vantage-point tree over its
distinct vectors and answers blocks of queries, and the shards' answers are
merged. Inside a shard an extra coordinate makes all vectors equally long,
which turns the largest inner product into the least Euclidean distance, so
the triangle inequality holds. A subtree is skipped when its shell lies
farther than ``factor`` times the distance of the k-th best found: factor 1
never skips a neighbour and is exact; smaller factors skip more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.plans.tables import table

K, FACTOR = 20, 1.0
ROWS_PER_SHARD, QUERIES_PER_BLOCK, LEAF = 8192, 32_768, 256
CELLS_AT_ONCE = 1 << 21  # queries x vectors kept for each


class VantageTree:
    """A tree over the rows of ``x`` (distinct, finite, at least one)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.norm2 = np.einsum("ij,ij->i", x, x)
        self.far2 = float(self.norm2.max())
        self.x = np.concatenate((x, np.sqrt(np.maximum(self.far2 - self.norm2, 0.0))[:, None]), axis=1)
        self.leaf, rng = leaf, np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (vantage row, inner limit, inner, outer) or (None, rows)
        todo = [(np.arange(len(x)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            if parent is not None:
                self.nodes[parent][2 + side] = len(self.nodes)
            if len(rows) > leaf:
                # of a few candidates, the one whose distances spread most
                best = None
                for v in rng.choice(rows, 4, replace=False):
                    d = np.sqrt(np.maximum(((self.x[rows] - self.x[v]) ** 2).sum(axis=1), 0.0))
                    if best is None or d.std() > best[1].std():
                        best = (v, d)
                v, d = best
                limit = float(np.median(d))
                inner, outer = rows[d <= limit], rows[d > limit]
                if len(outer):
                    todo += [(outer, len(self.nodes), 1), (inner, len(self.nodes), 0)]
                    self.nodes.append([int(v), limit, None, None])
                    continue
            self.nodes.append([None, rows])

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the ``k`` largest inner products with each query, best first
        (-1 where there are fewer), and the number of rows compared."""
        n = len(q)
        best, at = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        # |q' - x'|^2 = far2 + |q|^2 - 2 q.x for the lengthened vectors
        base = self.far2 + np.einsum("ij,ij->i", q, q)
        seen = np.zeros(n, np.int64)

        def kth(rows):
            return np.sqrt(np.maximum(base[rows] - 2 * best[rows, -1], 0.0))

        def visit(node, rows):
            if not len(rows):
                return
            if self.nodes[node][0] is None:
                members = self.nodes[node][1]
                s = q[rows] @ self.x[members, :-1].T
                seen[rows] += len(members)
                every = np.concatenate((best[rows], s), axis=1)
                ids = np.concatenate((at[rows], np.broadcast_to(members, s.shape)), axis=1)
                top = np.argpartition(-every, k - 1, axis=1)[:, :k]
                every, ids = np.take_along_axis(every, top, 1), np.take_along_axis(ids, top, 1)
                order = np.argsort(-every, axis=1, kind="stable")
                best[rows], at[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(ids, order, 1)
                return
            v, limit, inner, outer = self.nodes[node]
            d = np.sqrt(np.maximum(base[rows] - 2 * (q[rows] @ self.x[v, :-1]), 0.0))
            slack = 1e-9 * (1 + limit)
            near = d <= limit
            for side, first, other in ((near, inner, outer), (~near, outer, inner)):
                mine = rows[side]
                visit(first, mine)
                if len(mine):
                    reach = np.abs(d[side] - limit) <= factor * kth(mine) + slack
                    visit(other, mine[reach])

        visit(0, np.arange(n))
        return at, seen


def usable(vector: Column) -> Column:
    """Not null, of finite components, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _search_shard(k: int, factor: float):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64),
                              "score": np.zeros(0), "seen": np.zeros(0, np.int64)})
        if not len(vectors) or not len(queries):
            return empty
        out = []
        widths = vectors["embedding"].map(len)
        for dim, of_q in queries.groupby(queries["query"].map(len)):
            mine = vectors[widths == dim]
            if not len(mine):
                continue
            mine = mine.sort_values("vec_id")
            x, place = np.unique(np.stack(mine["embedding"]).astype(np.float64), axis=0, return_inverse=True)
            place, ids = place.ravel(), mine["vec_id"].to_numpy()
            # of copies of a vector the k + 1 smallest ids can be wanted, no others
            order = np.lexsort((ids, place))
            place, ids = place[order], ids[order]
            first = np.searchsorted(place, np.arange(len(x)))
            held = np.minimum(np.diff(np.append(first, len(ids))), k + 1)
            q, qid = np.stack(of_q["query"]).astype(np.float64), of_q["query_id"].to_numpy()
            tree, some = VantageTree(x), min(len(x), k + 9)  # its own vector, and room for ties
            todo = np.arange(len(q))
            while len(todo):
                again, step = [], max(1, min(4096, CELLS_AT_ONCE // some))
                for a in range(0, len(todo), step):
                    mine = todo[a:a + step]
                    part, seen = tree.search(q[mine], some, factor)
                    found = part.ravel()
                    row = np.repeat(np.arange(len(mine)), some)[found >= 0]
                    found = found[found >= 0]
                    score = (q[mine][row] * x[found]).sum(axis=1)
                    lowest = np.full(len(mine), np.inf)
                    np.minimum.at(lowest, row, score)
                    copies = held[found]
                    row, score = np.repeat(row, copies), np.repeat(score, copies)
                    start = np.repeat(first[found], copies)
                    place_in = np.arange(len(start)) - np.repeat(np.cumsum(copies) - copies, copies)
                    vec = ids[start + place_in]
                    other = vec != qid[mine][row]
                    row, score, vec = row[other], score[other], vec[other]
                    order = np.lexsort((vec, -score, row))
                    row, score, vec = row[order], score[order], vec[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    top = rank < k
                    # where the last vector kept is as near as the k-th row, others cut off may be as well
                    kth = np.full(len(mine), -np.inf)
                    kth[row[rank == k - 1]] = score[rank == k - 1]
                    wide = kth - 1e-9 * (1 + np.abs(kth))
                    more = (some < len(x)) & np.isfinite(kth) & (lowest >= wide)
                    again.append(mine[more])
                    top &= ~more[row]
                    out.append(pd.DataFrame({"query_id": qid[mine][row[top]], "vec_id": vec[top],
                                             "score": score[top], "seen": seen[row[top]]}))
                todo, some = np.concatenate(again), min(len(x), 2 * some)
        return pd.concat(out) if out else empty
    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR,
           rows_per_shard: int = ROWS_PER_SHARD, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """The ``k`` nearest ``vectors(vec_id, embedding)`` of each of
    ``queries(vec_id, embedding)``: ``query_id, rank, vec_id, score, seen``
    (``seen``: rows that the shard compared).

    Vectors that are null, zero or hold null or non-finite components, and
    rows with a null vec_id, take no part on either side; a query meets only
    vectors of its own length. Rows of the query's own id are no candidates.
    Ties go to the smaller id: a query whose list might end among equally near
    vectors is searched again for twice as many. Repeated rows count once. Fewer candidates than
    ``k`` give fewer rows; an empty table gives an empty result.

    A task holds one shard and one block of queries; every block visits every
    shard. Copies of a vector are one point of the tree, so a shard with a
    large group of them is no deeper."""
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates()
    v, q = clean(vectors), clean(queries).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    shards = max(1, -(-v.count() // rows_per_shard))
    blocks = max(1, -(-q.count() // queries_per_block))
    in_shard = (v.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))
                .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    in_block = (q.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(blocks)).cast("int"))
                .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    found = in_shard.groupBy("shard", "block").cogroup(in_block.groupBy("shard", "block")).applyInPandas(
        _search_shard(k, factor), "query_id long, vec_id long, score double, seen long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "seen"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0)).select("query_id", "rank", "vec_id", "score")


QUERIES = {"op9_nearest": op9_nearest}
ORACLE_SQL: dict[str, str] = {}
