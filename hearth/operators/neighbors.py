"""k-nearest-neighbour join by pruned cells, and the operators built on it
(nearest-neighbour imputation, neighbour vote classifier, nearest centre).

Design. Donors are put into the cell of their nearest pivot (a bounded number
of donors drawn by hash). Of each cell the driver keeps its size, its radius
and its smallest distance to the pivot, nothing else. Then, per query:

* the nearest cells that together hold enough donors are searched first, which
  bounds the distance of the k-th neighbour;
* every other cell is dropped before any row moves if the triangle inequality
  puts all its donors beyond that bound: by its radius, by its smallest
  distance, or by the plane between its pivot and the query's nearest one;
* the cells that are left are searched, and a window over the candidates (k a
  bin) gives the exact answer.

Of donors at one place only the k first ones by id are searched, so repeated
rows cost no more pairs. Near cells are searched together, as bins, so that a query moves once for many
cells. A search is a cogroup by bin with numpy distances (a matrix product picks
the pairs whose Euclidean distances of many coordinates are summed); both sides
of a large bin are cut by a hash of the id, so a task holds a bounded number of
rows of each.
On data where nothing can be pruned every query visits every cell, as an exact
join must. ``method="lsh"`` is the approximate choice: rows meet in buckets of
random projections, and only queries left with fewer than k are searched
exactly. No pair table and no cross join is ever materialised.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.session import cut_lineage

#: Donors wanted in a cell, most pivots, and most queries in one task (of donors twice as many).
CELL_ROWS, MAX_PIVOTS, TASK_ROWS = 512, 4096, 4096
#: Cells are searched in bins of near ones: so many, until a bin holds twice TASK_ROWS donors.
BINS = 32
_CHUNK_CELLS = 1_000_000  # distance-matrix cells per numpy chunk (8 MB)
_CHUNK_PAIRS = 250_000  # pairs of rows of buckets per numpy chunk
_PIVOT_CELLS = 32_768  # distances to pivots per numpy chunk, which stay in a core's cache
#: From so many pivots on rows look at the pivots around the nearest of some of them.
COARSE_PIVOTS = 512
#: From so many coordinates on Euclidean distances are bounded by a matrix product first.
PRODUCT_DIM = 8
#: LSH: tables, width of a bucket in k-th distances, queries that measure that distance, projections by metric
#: (at the k-th distance a table agrees with chance 0.41 and 0.38, one of eight with 0.985 and 0.979).
LSH_TABLES, LSH_WIDTH, LSH_SAMPLE = 8, 4.0, 64
LSH_PROJECTIONS = {"euclidean": 4, "manhattan": 2}


def as_vector(cols: Sequence[str | Column]) -> Column:
    """Numeric columns to one ARRAY<DOUBLE> feature column."""
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in cols])


def _pairwise(q: np.ndarray, d: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances between rows of q and rows of d, summing coordinates in
    order (the same rounding as a sequential SQL sum)."""
    acc = np.zeros((q.shape[0], d.shape[0]))
    for j in range(q.shape[1]):
        diff = q[:, j:j + 1] - d[None, :, j]
        if metric == "euclidean":
            acc += diff * diff
        elif metric == "manhattan":
            acc += np.abs(diff)
        elif p == 3:
            acc += np.abs(diff * diff * diff)
        else:
            acc += np.abs(diff) ** p
    if metric == "euclidean":
        np.sqrt(acc, out=acc)
    elif metric == "minkowski":
        acc **= 1.0 / p
    return acc


def _matrix(vectors) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _chunks(n: int, width: int, cells: int = _CHUNK_CELLS):
    step = max(1, cells // max(width, 1))
    return ((a, min(a + step, n)) for a in range(0, n, step))


def _best(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` least finite keys of each row, columns in
    order among equal keys."""
    k = min(k, key.shape[1])
    if k < key.shape[1]:
        kth = np.partition(key, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero((key <= kth[:, None]) & np.isfinite(key))
    else:
        rows, cols = np.nonzero(np.isfinite(key))
    order = np.lexsort((cols, key[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep]


def _best_of(rows: np.ndarray, cols: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` least keys of each row, by row, key and column."""
    order = np.lexsort((cols, key, rows))
    rows = rows[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]


def _pair_distances(q: np.ndarray, d: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs, summed in the order of :func:`_pairwise`."""
    acc = np.zeros(len(rows))
    for j in range(q.shape[1]):
        diff = q[rows, j] - d[cols, j]
        acc += diff * diff
    return np.sqrt(acc)


def _may_be_near(q: np.ndarray, d: np.ndarray, limit: np.ndarray, out: np.ndarray | None, k: int,
                 slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all pairs that can be within ``limit`` and among the
    ``k`` nearest of their row, but those ``out``. Squares of distances come from
    a matrix product, whose rounding is less than the margin allowed for;
    ``slack`` is what rounding may add to a distance."""
    qq, dd = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", d, d)
    square = q @ d.T
    square *= -2.0
    square += qq[:, None]
    square += dd
    if out is not None:
        square[out] = np.inf
    margin = 4 * (q.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(qq) + np.sqrt(dd.max())) ** 2
    reach = np.where(np.isfinite(limit), (limit + slack) ** 2 + margin, np.inf)
    if k < len(d) and not np.isfinite(limit).all():
        kth = np.partition(square, k - 1, axis=1)[:, k - 1]
        kth = (np.sqrt(np.maximum(kth + margin, 0)) + slack) ** 2 + margin
        reach = np.minimum(reach, kth)
    return np.nonzero((square <= reach[:, None] * (1 + 1e-12)) & (square < np.inf))


def _search_cell(k: int, metric: str, p: float, exclude_self: bool, grouped: bool, carry: list[str],
                 targets: list[str], rank_digits: int | None):
    """Cogroup function: the ``k`` nearest donors of a cell for each lane of
    each query. With ``targets`` lane i ranks the donors that know target i and
    returns its value; without, lane 0 ranks all donors."""
    columns = ["__qid", "__lane", "__did", "__dist", "__key", *(["__value"] if targets else carry)]

    def fn(queries: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(donors):
            return pd.DataFrame({c: [] for c in columns})
        donors = donors.iloc[np.argsort(donors["__did"].to_numpy(), kind="stable")].reset_index(drop=True)
        d, q = _matrix(donors["__dv"]), _matrix(queries["__qv"])
        did, qid, limit = donors["__did"].to_numpy(), queries["__qid"].to_numpy(), queries["__limit"].to_numpy()
        lanes = queries["__lanes"].to_numpy()
        needs = np.zeros((len(q), max(len(targets), 1)), bool)
        needs[np.repeat(np.arange(len(q)), [len(x) for x in lanes]), np.concatenate(lanes).astype(int)] = True
        knows = np.stack([donors[t].notna().to_numpy() for t in targets]) if targets else np.ones((1, len(d)), bool)
        parts = []
        # a product knows no null or endless coordinates
        product = (metric == "euclidean" and not targets and q.shape[1] >= PRODUCT_DIM
                   and max(np.abs(q).max(), np.abs(d).max()) < 1e100)
        slack = 2 * 10.0 ** -rank_digits if rank_digits is not None else 0.0
        for a, b in _chunks(len(q), len(d)):
            if product:
                out = None
                if exclude_self:
                    out = qid[a:b][:, None] == did
                if grouped:
                    same = queries["__qg"].to_numpy()[a:b][:, None] == donors["__dg"].to_numpy()
                    out = same if out is None else out | same
                rows, cols = _may_be_near(q[a:b], d, limit[a:b], out, k, slack)
                dist = _pair_distances(q[a:b], d, rows, cols)
                key = np.round(dist, rank_digits) if rank_digits is not None else dist
                within = np.flatnonzero((key <= limit[a:b][rows]) & needs[a:b, 0][rows])
                keep = within[_best_of(rows[within], cols[within], key[within], k)]
                rows, cols = rows[keep], cols[keep]
                parts.append(pd.DataFrame({"__qid": qid[a:b][rows], "__lane": 0, "__did": did[cols], "__dist": dist[keep],
                                           "__key": key[keep], **{c: donors[c].to_numpy()[cols] for c in carry}}))
                continue
            dist = _pairwise(q[a:b], d, metric, p)
            key = np.round(dist, rank_digits) if rank_digits is not None else dist.copy()
            key[key > limit[a:b][:, None]] = np.inf
            if exclude_self:
                key[qid[a:b][:, None] == did] = np.inf
            if grouped:
                key[queries["__qg"].to_numpy()[a:b][:, None] == donors["__dg"].to_numpy()] = np.inf
            for lane in range(needs.shape[1]):
                of, at = np.flatnonzero(needs[a:b, lane]), np.flatnonzero(knows[lane])
                if not len(of) or not len(at):
                    continue
                rows, cols = _best(key[np.ix_(of, at)], k)
                rows, cols = of[rows], at[cols]
                part = {"__qid": qid[a:b][rows], "__lane": lane, "__did": did[cols], "__dist": dist[rows, cols],
                        "__key": key[rows, cols]}
                if targets:
                    part["__value"] = donors[targets[lane]].to_numpy()[cols].astype(np.float64)
                else:
                    part |= {c: donors[c].to_numpy()[cols] for c in carry}
                parts.append(pd.DataFrame(part))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in columns})
    return fn


# --- pivots, cells and bounds -----------------------------------------------------------------------

class Cells:
    """Pivots with the size (all donors, then those that know each target),
    radius and least distance of their cells, and the bin of each cell. A
    bounded number of rows.

    Rows are placed in groups of the nearest of a few coarse pivots. The triangle
    inequality leaves each group the pivots around its coarse one, so the work
    for a row does not grow with all pivots where the data let it. Distances
    between pivots are made where they are needed, as the object goes with tasks."""

    def __init__(self, pivots: np.ndarray, metric: str, p: float):
        self.pivots, self.metric, self.p = pivots, metric, p
        n = len(pivots)
        few = min(n, 4 * math.isqrt(n)) if n >= COARSE_PIVOTS else min(n, 1)
        self.coarse = np.sort(np.random.default_rng(0).choice(n, few, replace=False)) if n else np.zeros(0, np.int64)
        self.sizes = self.radius = self.least = self.bins = None
        self.around: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"around": {}}

    def _from(self, c: int) -> np.ndarray:
        """Distances of a coarse pivot to all pivots."""
        if c not in self.around:
            self.around[c] = _pairwise(self.pivots[c:c + 1], self.pivots, self.metric, self.p)[0]
        return self.around[c]

    def _groups(self, x: np.ndarray):
        """Rows by their nearest coarse pivot: the rows, the distances of that
        pivot to all, and how far the rows are from it at most (endless for rows
        that are not comparable, and where all pivots are looked at anyway)."""
        if len(self.coarse) <= 1:
            if len(x):
                yield np.arange(len(x)), np.zeros(len(self.pivots)), math.inf
            return
        own, away = np.zeros(len(x), np.int64), np.zeros(len(x))
        for a, b in _chunks(len(x), len(self.coarse), _PIVOT_CELLS):
            d = _pairwise(x[a:b], self.pivots[self.coarse], self.metric, self.p)
            own[a:b] = d.argmin(axis=1)
            away[a:b] = d[np.arange(b - a), own[a:b]]
        away[np.isnan(away)] = math.inf
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        for rows in np.split(order, first[1:]) if len(x) else ():
            yield rows, self._from(int(self.coarse[own[rows[0]]])), float(away[rows].max())

    @staticmethod
    def _reach(to: np.ndarray, far) -> np.ndarray:
        # more than rounding can add
        return to <= far + 1e-6 * (1 + to)

    def pack(self, rows: int) -> None:
        """Cells into bins of near ones: a bin takes the cells nearest to its
        first one while they hold at most ``rows`` donors."""
        size, free = self.sizes[:, 0], np.ones(len(self.pivots), bool)
        self.bins, n = np.zeros(len(self.pivots), np.int32), 0
        for c in range(len(self.pivots)):
            if not free[c]:
                continue
            near = np.flatnonzero(free)
            apart = _pairwise(self.pivots[c:c + 1], self.pivots[near], self.metric, self.p)[0]
            near = near[np.argsort(np.where(near == c, -1.0, apart), kind="stable")]
            mine = near[:max(1, int((np.cumsum(size[near]) <= rows).sum()))]
            self.bins[mine], n = n, n + 1
            free[mine] = False

    def measure(self, donors: DataFrame, targets: Sequence[str]) -> None:
        n = len(self.pivots)
        self.sizes = np.zeros((n, 1 + len(targets)), np.int64)
        self.radius, self.least = np.full(n, -np.inf), np.full(n, np.inf)
        for r in donors.groupBy("__cell").agg(
                F.max("__away").alias("__far"), F.min("__away").alias("__near"), F.count(F.lit(1)).alias("__n"),
                *[F.count(t).alias(f"__n{i}") for i, t in enumerate(targets)]).collect():
            self.radius[r["__cell"]], self.least[r["__cell"]] = r["__far"], r["__near"]
            self.sizes[r["__cell"]] = [r["__n"], *[r[f"__n{i}"] for i in range(len(targets))]]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, away = np.zeros(len(x), np.int32), np.zeros(len(x))
        for rows, to, far in self._groups(x):
            # the coarse pivot is one itself, so the nearest is no farther
            some = np.flatnonzero(self._reach(to, 2 * far))
            for a, b in _chunks(len(rows), len(some), _PIVOT_CELLS):
                d, at = _pairwise(x[rows[a:b]], self.pivots[some], self.metric, self.p), rows[a:b]
                near = d.argmin(axis=1)
                cell[at], away[at] = some[near], d[np.arange(b - a), near]
        return cell, away

    def first(self, x: np.ndarray, lanes: Sequence[Sequence[int]], need: int, targets: bool) -> list[np.ndarray]:
        """For each row the bins of the nearest cells that together hold
        ``need`` donors of every lane, or of all cells."""
        out: list = [None] * len(x)
        lanes = [tuple(s) for s in lanes]
        every = sorted({c for s in lanes for c in s})
        for rows, to, far in self._groups(x):
            # cells that hold enough around the coarse pivot: those of a row are no farther than their farthest
            by, reach = np.argsort(to, kind="stable"), 0.0
            for lane in every:
                enough = int(np.searchsorted(np.cumsum(self.sizes[by, lane + 1 if targets else 0]), need))
                reach = max(reach, to[by[enough]] if enough < len(by) else math.inf)
            some = np.flatnonzero(self._reach(to, reach + 2 * far))
            for a, b in _chunks(len(rows), len(some), _PIVOT_CELLS):
                order = some[np.argsort(_pairwise(x[rows[a:b]], self.pivots[some], self.metric, self.p), axis=1, kind="stable")]
                enough = np.zeros(b - a, int)
                mine = [lanes[i] for i in rows[a:b]]
                for lane in sorted({c for s in mine for c in s}):
                    size = self.sizes[:, lane + 1 if targets else 0]
                    short = np.cumsum(size[order], axis=1) < need
                    wants = np.array([lane in s for s in mine])
                    enough = np.where(wants, np.maximum(enough, short.sum(axis=1) + 1), enough)
                for i in range(b - a):
                    out[rows[a + i]] = np.unique(self.bins[order[i, :enough[i]]])
        return out

    def within(self, x: np.ndarray, limit: np.ndarray, seen: Sequence[np.ndarray]) -> list[np.ndarray]:
        """For each row the bins, but those ``seen``, with cells that may hold
        a donor as near as ``limit``."""
        out: list = [None] * len(x)
        for rows, to, far in self._groups(x):
            # the row's nearest pivot, and cells that their radius does not rule out
            some = np.flatnonzero(self._reach(to, 2 * far) | self._reach(to, far + limit[rows].max() + np.maximum(self.radius, 0)))
            pivots, full = self.pivots[some], self.sizes[some, 0] > 0
            for a, b in _chunks(len(rows), len(some), _PIVOT_CELLS):
                d = _pairwise(x[rows[a:b]], pivots, self.metric, self.p)
                own = d.argmin(axis=1)
                mine = d[np.arange(b - a), own][:, None]
                if self.metric == "euclidean":
                    which, own = np.unique(own, return_inverse=True)
                    gap = _pairwise(pivots[which], pivots, self.metric, self.p)[own]
                    plane = np.divide(d ** 2 - mine ** 2, 2 * gap, out=np.zeros_like(d), where=gap > 0)
                else:
                    plane = (d - mine) / 2
                bound = np.maximum(np.maximum(d - self.radius[some], self.least[some] - d), plane)
                reach = (bound <= limit[rows[a:b]][:, None] + 1e-9 * (1 + d)) & full
                for i in range(b - a):
                    out[rows[a + i]] = np.setdiff1d(self.bins[some[reach[i]]], seen[rows[a + i]])
        return out


_PLACE = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
_CELLS = T.ArrayType(T.IntegerType())


def _place(cells: Cells):
    @F.pandas_udf(_PLACE)
    def place(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cell": [], "away": []})
        cell, away = cells.nearest(_matrix(v))
        return pd.DataFrame({"cell": cell, "away": away})
    return place


def _first(cells: Cells, need: int, targets: bool):
    @F.pandas_udf(_CELLS)
    def first(v: pd.Series, lanes: pd.Series) -> pd.Series:
        return pd.Series(cells.first(_matrix(v), lanes.tolist(), need, targets) if len(v) else [], dtype=object)
    return first


def _within(cells: Cells):
    @F.pandas_udf(_CELLS)
    def within(v: pd.Series, limit: pd.Series, seen: pd.Series) -> pd.Series:
        found = cells.within(_matrix(v), limit.to_numpy(), seen.tolist()) if len(v) else []
        return pd.Series(found, dtype=object)
    return within


def _draw_pivots(donors: DataFrame, n_donors: int, cell_rows: int) -> np.ndarray:
    """Distinct donor vectors of the smallest id hashes: at most MAX_PIVOTS."""
    want = min(MAX_PIVOTS, math.ceil(n_donors / cell_rows))
    rows = donors.select("__dv", F.xxhash64("__did").alias("__h"), "__did").orderBy("__h", "__did").limit(want).collect()
    return np.unique(np.array([r["__dv"] for r in rows], np.float64), axis=0) if rows else np.zeros((0, 0))


def _meet(queries: DataFrame, donors: DataFrame, sizes: np.ndarray, fn, schema: T.StructType,
          report: list | None) -> DataFrame:
    """Queries with their ``__cells`` (bins of cells) meet the donors of those.
    The visits of each bin (one number a bin) set how both sides are cut."""
    visits = queries.withColumn("__cell", F.explode("__cells")).drop("__cells")
    n = np.zeros(len(sizes), np.int64)
    for r in visits.groupBy("__cell").count().collect():
        n[r["__cell"]] = r["count"]
    cut = lambda rows: np.ceil(rows / TASK_ROWS).astype(int)
    d_parts, q_parts = cut(sizes / 2), cut(n)
    if report is not None:
        report.append(int((sizes * q_parts + n * d_parts).sum()))
    of_cell = lambda parts: F.array(*[F.lit(int(x)) for x in parts])[F.col("__cell")]
    every = lambda parts: F.explode(F.sequence(F.lit(0), of_cell(parts) - 1))
    dealt = lambda c, parts: F.pmod(F.xxhash64(c, F.lit(11)), of_cell(parts)).cast("int")
    q = visits.withColumn("__qp", dealt("__qid", q_parts)).withColumn("__dp", every(d_parts))
    d = donors.where(of_cell(q_parts) > 0).withColumn("__dp", dealt("__did", d_parts)).withColumn("__qp", every(q_parts))
    by = ("__cell", "__dp", "__qp")
    return q.groupBy(*by).cogroup(d.groupBy(*by)).applyInPandas(fn, schema)


def _lsh_keys(dim: int, width: float, metric: str, seed: int = 7):
    """UDF: a row's bucket in every table, from floors of random projections
    (normal for Euclidean, Cauchy for Manhattan distances)."""
    if metric not in ("euclidean", "manhattan"):
        raise ValueError("buckets of projections need the euclidean or manhattan metric")
    rng = np.random.default_rng(seed)
    each = LSH_PROJECTIONS[metric]
    n = LSH_TABLES * each
    lines = rng.normal(size=(dim, n)) if metric == "euclidean" else rng.standard_cauchy(size=(dim, n))
    shift = rng.uniform(0, width, n)
    mix = rng.integers(1, 1 << 62, each) | 1

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        cell = np.floor((_matrix(v) @ lines + shift) / width).astype(np.int64)
        with np.errstate(over="ignore"):
            key = (cell.reshape(len(v), LSH_TABLES, each) * mix).sum(axis=2)
        return pd.Series(list(key))
    return keys


def _search_buckets(k: int, metric: str, p: float, exclude_self: bool, carry: list[str], targets: list[str],
                    rank_digits: int | None):
    """Cogroup function over a slot of buckets: the ``k`` nearest donors that
    share a bucket with a query, for each of its lanes."""
    columns = ["__qid", "__lane", "__did", "__dist", "__key", *(["__value"] if targets else carry)]

    def best(found):
        # a donor met in several buckets counts once
        order = np.lexsort((found["__did"], found["__key"], found["__lane"], found["__qid"]))
        found = {c: v[order] for c, v in found.items()}
        who = np.stack([found["__qid"], found["__lane"]], axis=1)
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]).any(axis=1) | (found["__did"][1:] != found["__did"][:-1])
        found, who = {c: v[new] for c, v in found.items()}, who[new]
        first = np.ones(len(who), bool)
        first[1:] = (who[1:] != who[:-1]).any(axis=1)
        start = np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
        keep = np.arange(len(who)) - start < k
        return {c: v[keep] for c, v in found.items()}

    def fn(queries: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(donors):
            return pd.DataFrame({c: [] for c in columns})
        names = ["__table", "__bucket", "__qp", "__dp"]
        both = pd.concat((queries[names], donors[names]))
        code = both.groupby(names, sort=False).ngroup().to_numpy()
        of_q, of_d = code[:len(queries)], code[len(queries):]
        by_bucket = np.argsort(of_d, kind="stable")
        low, high = np.searchsorted(of_d[by_bucket], of_q, "left"), np.searchsorted(of_d[by_bucket], of_q, "right")
        q, d = _matrix(queries["__qv"]), _matrix(donors["__dv"])
        qid, did, lanes = queries["__qid"].to_numpy(), donors["__did"].to_numpy(), queries["__lanes"].to_numpy()
        grouped = "__qg" in queries
        held, ends = [], np.cumsum(high - low)
        at = 0
        while at < len(q):
            # so many queries that their pairs fit
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK_PAIRS, "right")))
            n = high[at:to] - low[at:to]
            rows = np.repeat(np.arange(at, to), n)
            cols = by_bucket[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)]
            if exclude_self or grouped:
                keep = np.ones(len(rows), bool)
                if exclude_self:
                    keep &= qid[rows] != did[cols]
                if grouped:
                    keep &= queries["__qg"].to_numpy()[rows] != donors["__dg"].to_numpy()[cols]
                rows, cols = rows[keep], cols[keep]
            apart = _row_distances(q[rows], d[cols], metric, p)
            for lane in range(max(len(targets), 1)):
                wants = np.array([lane in x for x in lanes[at:to]], bool)[rows - at]
                if targets:
                    wants &= donors[targets[lane]].notna().to_numpy()[cols]
                r, c, dist = rows[wants], cols[wants], apart[wants]
                part = {"__qid": qid[r], "__lane": np.full(len(r), lane), "__did": did[c], "__dist": dist,
                        "__key": np.round(dist, rank_digits) if rank_digits is not None else dist}
                if targets:
                    part["__value"] = donors[targets[lane]].to_numpy()[c].astype(np.float64)
                else:
                    part |= {name: donors[name].to_numpy()[c] for name in carry}
                held.append(best(part))
            at = to
        return pd.DataFrame(best({x: np.concatenate([h[x] for h in held]) for x in columns}), columns=columns)
    return fn


def _row_distances(x: np.ndarray, y: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of rows at the same place, summed in the order of :func:`_pairwise`."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        diff = x[:, j] - y[:, j]
        out += diff * diff if metric == "euclidean" else np.abs(diff)
    return np.sqrt(out) if metric == "euclidean" else out


def _meet_in_buckets(queries: DataFrame, donors: DataFrame, fn, schema: T.StructType, keys) -> DataFrame:
    """Queries and donors of equal buckets, as many buckets to a task as make
    a bounded number of rows; the sides of a large bucket are cut by a hash of
    the id."""
    by = ["__table", "__bucket"]
    q = queries.select("*", F.posexplode(keys("__qv")).alias(*by))
    d = donors.select("*", F.posexplode(keys("__dv")).alias(*by))
    slots = max(1, -(-LSH_TABLES * (queries.count() + donors.count()) // TASK_ROWS))

    def large(side: DataFrame, parts: str) -> DataFrame:
        return side.groupBy(*by).count().where(F.col("count") > TASK_ROWS).select(
            *by, F.ceil(F.col("count") / TASK_ROWS).cast("int").alias(parts))
    heavy_q, heavy_d = large(q, "__qn"), large(d, "__dn")

    def cut(side: DataFrame, own: str, ident: str, other: str) -> DataFrame:
        side = side.join(heavy_q, by, "left").join(heavy_d, by, "left")
        n = {c: F.coalesce(F.col(f"{c}n"), F.lit(1)) for c in ("__q", "__d")}
        return (side.withColumn(f"{own}p", F.pmod(F.xxhash64(ident, F.lit(11)), n[own]).cast("int"))
                .withColumn(f"{other}p", F.explode(F.sequence(F.lit(0), n[other] - 1))).drop("__qn", "__dn")
                .withColumn("__slot", F.pmod(F.xxhash64(*by, "__qp", "__dp"), F.lit(slots)).cast("int")))
    return (cut(q, "__q", "__qid", "__d").groupBy("__slot").cogroup(cut(d, "__d", "__did", "__q").groupBy("__slot"))
            .applyInPandas(fn, schema).dropDuplicates(["__qid", "__lane", "__did"]))


def _thinned(d: DataFrame, most: int, targets: list[str]) -> DataFrame:
    """Donors but those that ``most`` smaller ids come before at the same
    place (of the same group, knowing the same targets): these are never among
    the nearest. So the donors at a place, and with them the pairs, are bounded."""
    # sorted by a hash first, as vectors are slow to compare
    same = [F.xxhash64("__dv"), F.col("__dv"), *([F.col("__dg")] if "__dg" in d.columns else []), *[F.col(t).isNull() for t in targets]]
    nth = F.dense_rank().over(Window.partitionBy(*same).orderBy(F.col("__did").asc_nulls_last()))
    return d.withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__nth")


def _index(d: DataFrame, metric: str, p: float, targets: list[str], cell_rows: int) -> tuple[Cells, DataFrame | None]:
    """Cells of the donors, and the donors with the bin of their cell."""
    n = d.count()
    # a power below 1 is no metric: one cell holds all donors
    cells = Cells(_draw_pivots(d, n, cell_rows if metric != "minkowski" or p >= 1 else max(n, 1)), metric, p)
    if not len(cells.pivots):
        return cells, None
    d = cut_lineage(d.withColumn("__at", _place(cells)("__dv")).select(
        "*", F.col("__at.cell").alias("__cell"), F.col("__at.away").alias("__away")).drop("__at"), "donors")
    cells.measure(d, targets)
    cells.pack(min(max(n // BINS, cell_rows), 2 * TASK_ROWS))
    return cells, d.drop("__away").withColumn("__cell", F.array(*[F.lit(int(b)) for b in cells.bins])[F.col("__cell")])


def _search(q: DataFrame, d: DataFrame, *, k: int, metric: str, p: float, exclude_self: bool, carry: list[str],
            targets: list[str], rank_digits: int | None, cell_rows: int, method: str, report: list | None,
            index: tuple[Cells, DataFrame | None] | None = None) -> DataFrame:
    """``__qid, __lane, __did, __dist, __key, rank`` and the carried columns
    (or ``__value``) of ``q(__qid, __qv, __lanes[, __qg])`` among
    ``d(__did, __dv[, __dg], ...)``; ``index`` holds the cells of ``d`` where
    they are known."""
    if metric == "minkowski" and p in (1, 2):
        metric = "manhattan" if p == 1 else "euclidean"
    if method not in ("cells", "lsh"):
        raise ValueError(f"unknown method {method}")
    grouped = "__qg" in q.columns
    extra = ([T.StructField("__value", T.DoubleType())] if targets
             else [T.StructField(d.schema[c].name, d.schema[c].dataType) for c in carry])
    schema = T.StructType([T.StructField("__qid", T.LongType()), T.StructField("__lane", T.IntegerType()),
                           T.StructField("__did", T.LongType()), T.StructField("__dist", T.DoubleType()),
                           T.StructField("__key", T.DoubleType()), *extra])
    fn = _search_cell(k, metric, p, exclude_self, grouped, carry, targets, rank_digits)
    best = Window.partitionBy("__qid", "__lane").orderBy("__key", "__did")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    if index is None:
        d = cut_lineage(_thinned(d, k + exclude_self, targets), "donors")
    if method == "lsh":
        q = cut_lineage(q, "queries")
        dim = d.select(F.size("__dv")).first()
        if dim is None:
            return top(q.sparkSession.createDataFrame([], schema))
        index = _index(d, metric, p, targets, cell_rows)
        some = q.orderBy(F.xxhash64("__qid"), "__qid").limit(LSH_SAMPLE)
        kth = _search(some, d, k=k, metric=metric, p=p, exclude_self=exclude_self, carry=carry, targets=targets,
                      rank_digits=None, cell_rows=cell_rows, method="cells", report=None, index=index)
        width = LSH_WIDTH * (kth.where(F.col("rank") == k).agg(F.avg("__dist")).first()[0] or 0.0) or 1.0
        near = _search_buckets(k, metric, p, exclude_self, carry, targets, rank_digits)
        met = _meet_in_buckets(q, d, near, schema, _lsh_keys(dim[0], width, metric))
        found = cut_lineage(top(met), "neighbours")
        full = found.where(F.col("rank") == k).groupBy("__qid").agg(F.count(F.lit(1)).alias("__full"))
        short = q.join(full, "__qid", "left").where(F.coalesce("__full", F.lit(0)) < F.size("__lanes")).drop("__full")
        rest = _search(short, d, k=k, metric=metric, p=p, exclude_self=exclude_self, carry=carry, targets=targets,
                       rank_digits=rank_digits, cell_rows=cell_rows, method="cells", report=report, index=index)
        return found.join(short.select("__qid"), "__qid", "left_anti").unionByName(rest)

    cells, d = index or _index(d, metric, p, targets, cell_rows)
    if d is None:
        return top(q.sparkSession.createDataFrame([], schema))
    one = len(cells.pivots) == 1
    # rows that exclude themselves or their group need more donors near by
    need = k + exclude_self if not grouped else 2 * k + 8
    near = F.array(F.lit(0)) if one else _first(cells, need, bool(targets))("__qv", "__lanes")
    q = cut_lineage(q.withColumn("__cells", near), "queries")
    sizes = np.bincount(cells.bins, cells.sizes[:, 0]).astype(np.int64)
    found = _meet(q.withColumn("__limit", F.lit(math.inf)), d, sizes, fn, schema, report)
    if one:
        return top(found)
    found = cut_lineage(found, "neighbours")
    kth = found.groupBy("__qid", "__lane").agg(F.sort_array(F.collect_list("__key")).alias("__keys"))
    kth = kth.where(F.size("__keys") >= k).select("__qid", F.col("__keys")[k - 1].alias("__kth")).groupBy("__qid").agg(
        F.max("__kth").alias("__kth"), F.count(F.lit(1)).alias("__full"))
    limit = F.when(F.col("__full") == F.size("__lanes"), F.col("__kth")).otherwise(F.lit(math.inf))
    more = q.join(kth, "__qid", "left").withColumn("__limit", limit).drop("__kth", "__full")
    # keys are rounded distances: what rounds to the limit may lie half a digit beyond
    beyond = F.col("__limit") + (0.5 * 10.0 ** -rank_digits if rank_digits is not None else 0.0)
    more = more.withColumn("__cells", _within(cells)("__qv", beyond, "__cells")).where(F.size("__cells") > 0)
    more = cut_lineage(more, "visits")
    return top(found.unionByName(_meet(more, d, sizes, fn, schema, report)))


def nearest_neighbours(queries: DataFrame, donors: DataFrame, *, k: int, q_id: str, q_vec: str,
                       d_id: str, d_vec: str, carry: Sequence[str] = (),
                       metric: str = "euclidean", p: float = 2.0, exclude_self: bool = False,
                       rank_digits: int | None = None, cell_rows: int = CELL_ROWS,
                       other_group: str | None = None, method: str = "cells", report: list | None = None) -> DataFrame:
    """The k nearest donors of every query.

    Output ``(q_id, d_id, dist, rank, *carry)`` with rank 1..k ordered by
    (distance, donor id). ``metric``: euclidean, manhattan or minkowski (with
    ``p``). ``exclude_self`` skips pairs with equal ids (self join);
    ``other_group`` names a column of both sides whose equal values exclude a
    pair (folds: neighbours come from the other folds, and all folds are
    searched at once). ``rank_digits`` ranks on rounded distances (stable ties
    across engines). Ids must be unique longs on each side.

    ``method="cells"`` is exact; ``"lsh"`` may miss neighbours (its recall is
    measured in the tests and the ``knn_lsh`` query). ``report`` receives the
    number of rows shuffled by each exact search.
    """
    if q_id == d_id:
        raise ValueError("query and donor id columns need different names")
    carry, grouped = list(carry), other_group is not None
    q = queries.select(F.col(q_id).cast("long").alias("__qid"), F.col(q_vec).cast("array<double>").alias("__qv"),
                       F.array(F.lit(0)).alias("__lanes"), *([F.col(other_group).alias("__qg")] if grouped else []))
    d = donors.select(F.col(d_id).cast("long").alias("__did"), F.col(d_vec).cast("array<double>").alias("__dv"),
                      *([F.col(other_group).alias("__dg")] if grouped else []), *[F.col(c) for c in carry])
    top = _search(q, d, k=k, metric=metric, p=p, exclude_self=exclude_self, carry=carry, targets=[],
                  rank_digits=rank_digits, cell_rows=cell_rows, method=method, report=report)
    return top.select(F.col("__qid").alias(q_id), F.col("__did").alias(d_id),
                      F.col("__dist").alias("dist"), "rank", *carry)


def _weighted_value(y: Column, dist: Column, weights: str) -> list[Column]:
    """Aggregates giving the neighbour average: with distance weights, the
    mean of the zero-distance neighbours when there is one, else
    sum(y / d) / sum(1 / d); uniform weights give the plain mean."""
    if weights == "uniform":
        return [F.avg(y).alias("__v")]
    zero = dist == 0
    return [F.avg(F.when(zero, y)).alias("__v0"),
            F.sum(F.when(~zero, y / dist)).alias("__num"),
            F.sum(F.when(~zero, 1.0 / dist)).alias("__den")]


def _value_expr(weights: str) -> Column:
    if weights == "uniform":
        return F.col("__v")
    return F.coalesce(F.col("__v0"), F.try_divide(F.col("__num"), F.col("__den")))


def knn_regress(queries: DataFrame, donors: DataFrame, *, k: int, id_col: str, vec: str,
                target: str, weights: str = "distance", metric: str = "euclidean",
                p: float = 2.0, rank_digits: int | None = None, out: str = "prediction",
                cell_rows: int = CELL_ROWS, other_group: str | None = None, method: str = "cells",
                report: list | None = None) -> DataFrame:
    """Neighbour average of ``target`` for every query: ``(id_col, out)``."""
    nn = nearest_neighbours(queries, donors.withColumnRenamed(id_col, "__d_id"), k=k,
                            q_id=id_col, q_vec=vec, d_id="__d_id", d_vec=vec,
                            carry=[target], metric=metric, p=p, rank_digits=rank_digits,
                            cell_rows=cell_rows, other_group=other_group, method=method, report=report)
    y = F.col(target).cast("double")
    agg = nn.groupBy(id_col).agg(*_weighted_value(y, F.col("dist"), weights))
    return agg.select(id_col, _value_expr(weights).alias(out))


def knn_impute(df: DataFrame, *, id_col: str, fill_cols: Sequence[str],
               feature_cols: Sequence[str] | None = None, k: int = 3,
               weights: str = "distance", rank_digits: int | None = None,
               cell_rows: int = CELL_ROWS, method: str = "cells", report: list | None = None) -> DataFrame:
    """Fill NULLs of each ``fill_cols`` column from the k nearest rows where
    that column is known (inverse-distance mean; zero distance: mean of the
    zero-distance donors), unscaled Euclidean distance on ``feature_cols``
    (default: every other column but the id). A NULL feature raises.
    Columns are independent (the filled columns are not features).

    One search serves all columns: a query ranks, for each column it lacks, the
    donors that know it, so distances are computed once and the rows move once
    however many columns are filled. Filled columns become DOUBLE."""
    fill_cols = list(fill_cols)
    if feature_cols is None:
        feature_cols = [c for c in df.columns if c not in fill_cols and c != id_col]
    base = cut_lineage(df, "impute-base")
    unknown = base.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in feature_cols]).first()
    if any(unknown):
        raise ValueError(f"features must be known: {({c: unknown[c] for c in feature_cols if unknown[c]})} are NULL")
    names = [f"__t{i}" for i in range(len(fill_cols))]
    lacks = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(fill_cols)]),
                     lambda x: x.isNotNull())
    q = base.select(F.col(id_col).cast("long").alias("__qid"), as_vector(feature_cols).alias("__qv"),
                    lacks.alias("__lanes")).where(F.size("__lanes") > 0)
    known = F.coalesce(*[F.col(c).cast("double") for c in fill_cols])
    d = base.where(known.isNotNull()).select(
        F.col(id_col).cast("long").alias("__did"), as_vector(feature_cols).alias("__dv"),
        *[F.col(c).cast("double").alias(n) for c, n in zip(fill_cols, names)])
    nn = _search(q, d, k=k, metric="euclidean", p=2.0, exclude_self=False, carry=[], targets=names,
                 rank_digits=rank_digits, cell_rows=cell_rows, method=method, report=report)
    pred = nn.groupBy("__qid", "__lane").agg(*_weighted_value(F.col("__value"), F.col("__dist"), weights))
    wide = pred.groupBy("__qid").agg(*[F.max(F.when(F.col("__lane") == i, _value_expr(weights))).alias(n)
                                       for i, n in enumerate(names)])
    out = base.join(wide, base[id_col] == wide["__qid"], "left")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(n)).alias(c) for c, n in zip(fill_cols, names)}
    return out.select(*[filled.get(c, F.col(c)) for c in df.columns])


def knn_classify(queries: DataFrame, donors: DataFrame, *, k: int, id_col: str, vec: str,
                 label: str, positive=1, weights: str = "distance", metric: str = "euclidean",
                 p: float = 2.0, rank_digits: int | None = None, out: str = "score",
                 cell_rows: int = CELL_ROWS, other_group: str | None = None,
                 method: str = "cells", report: list | None = None) -> DataFrame:
    """Probability of ``positive`` from a (distance-weighted) vote of the k
    nearest donors: ``(id_col, out)``."""
    d = donors.withColumn("__y", (F.col(label) == positive).cast("double"))
    group = [other_group] if other_group else []
    return knn_regress(queries, d.select(id_col, vec, "__y", *group), k=k, id_col=id_col, vec=vec,
                       target="__y", weights=weights, metric=metric, p=p,
                       rank_digits=rank_digits, out=out, cell_rows=cell_rows, other_group=other_group,
                       method=method, report=report)


def nearest_centre(points: DataFrame, centres: DataFrame, *, point_id: str, vec: str,
                   centre_id: str, centre_vec: str, out: str = "centre") -> DataFrame:
    """Nearest centre of every point (ties to the smallest centre id):
    ``(point_id, out, dist)``. The centres, a bounded table as in every
    clustering here, go with the tasks; no point moves."""
    rows = sorted((r[0], r[1]) for r in centres.select(F.col(centre_id).cast("long"), F.col(centre_vec).cast("array<double>")).collect())
    names, near = np.array([r[0] for r in rows], np.int64), Cells(np.array([r[1] for r in rows], np.float64), "euclidean", 2.0)
    place = T.StructType([T.StructField(out, T.LongType()), T.StructField("dist", T.DoubleType())])

    @F.pandas_udf(place)
    def nearest(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({out: [], "dist": []})
        cell, away = near.nearest(_matrix(v))
        return pd.DataFrame({out: names[cell], "dist": away})
    at = points.select(point_id, nearest(F.col(vec).cast("array<double>")).alias("__at"))
    return at.select(point_id, F.col(f"__at.{out}").alias(out), F.col("__at.dist").alias("dist"))
