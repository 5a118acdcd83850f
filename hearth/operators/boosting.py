"""Second-order gradient boosting of logistic trees on histograms.

Every feature is cut at quantiles once; a row is then its bins. A tree level is
one pass over the rows: each task adds the gradients and hessians of its rows
by (model, node, feature, bin), the sums of all tasks are added, and the best
split of every node follows from them. All models of a run (folds, subsamples,
any parameters) share the passes, and the scores after any number of rounds
come from one fit.

A row's margins are part of the row's table as of an earlier round; a task adds
the trees grown since, and the table is written anew every ``ROUNDS_HELD``
rounds. Models that differ in ``gamma`` alone grow the same trees
until one of them prunes a split that another keeps: until then they are fitted
as one, with one margin a row. Row samples are a hash of (id, round), column
samples a function of the round, so a retried task sees the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.operators.partials import array_sums, dealt
from hearth.session import delete_path, shared_path

MAX_BINS, ROUNDS_HELD = 256, 10
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class BoostParams:
    """``fold``: the fold left out of the training (None: all rows are trained on)."""
    rounds: int = 58
    eta: float = 0.2
    depth: int = 4
    min_child_weight: float = 4.0
    subsample: float = 1.0
    columns: float = 1.0
    gamma: float = 0.0
    reg_lambda: float = 1.0
    fold: int | None = None
    seed: int = 1


@dataclass
class Tree:
    """A heap of 2 ** (depth + 1) - 1 nodes: the feature (-1: leaf), the last
    bin that goes left, the split's gain, and the leaf value."""
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n))

    def leaf_of(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row has reached after ``levels`` splits (default: its leaf)."""
        split, every = self.feature >= 0, np.arange(len(self.feature))
        feature, flat, first = np.maximum(self.feature, 0), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        # a leaf is its own child on both sides
        cut, left = np.where(split, self.cut, np.iinfo(np.int64).max), np.where(split, 2 * every + 1, every)
        node = np.zeros(len(bins), np.int64)
        for _ in range(len(self.feature).bit_length() - 1 if levels is None else levels):
            node = left[node] + (flat[first + feature[node]] > cut[node])
        return node


def uniform(ids: np.ndarray, round_: int, seed: int) -> np.ndarray:
    """A number in [0, 1) of each id and round (a mixing hash)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((round_ + 1) * 0xD1B54A32D192ED03 % (1 << 64)) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) * 2.0 ** -53


def columns_of(p: BoostParams, n: int, round_: int) -> np.ndarray:
    """The features that a round's tree may split on."""
    take = max(1, int(p.columns * n))
    every = np.random.default_rng([p.seed, round_]).permutation(n) if take < n else np.arange(n)
    mask = np.zeros(n, bool)
    mask[every[:take]] = True
    return mask


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return p - y, p * (1.0 - p)


def level_sums(bins, g, h, node, level: int, n_bins: int) -> np.ndarray:
    """Gradient and hessian sums by (node of the level, feature, bin); ``bins``
    has a row for each feature, and the nodes are none below the level."""
    first, width, d = (1 << level) - 1, 1 << level, len(bins)
    if level:
        here = node >= first
        if not here.all():
            bins, g, h, node = bins[:, here], g[here], h[here], node[here]
        place = (node - first) * n_bins
    out = np.empty((2, width, d, n_bins))
    for f in range(d):
        at = bins[f] + place if level else bins[f]
        for i, v in enumerate((g, h)):
            out[i, :, f] = np.bincount(at, v, width * n_bins).reshape(width, n_bins)
    return out


def split_level(tree: Tree, sums: np.ndarray, level: int, p: BoostParams, columns: np.ndarray) -> None:
    """The best split of every node of a level, and its children's values. A
    split keeps the hessian of both sides at ``min_child_weight`` or more; ties
    go to the first feature and the lowest bin."""
    first = (1 << level) - 1
    score = lambda g, h: g * g / (h + p.reg_lambda)
    for i in range(1 << level):
        node = first + i
        if level and not (tree.feature[(node - 1) // 2] >= 0):
            continue
        G, H = sums[0, i], sums[1, i]
        g, h = G[0].sum(), H[0].sum()
        if not level:
            tree.value[0] = -g / (h + p.reg_lambda) * p.eta
        gl, hl = np.cumsum(G, axis=1)[:, :-1], np.cumsum(H, axis=1)[:, :-1]
        if not gl.size:
            continue
        gr, hr = g - gl, h - hl
        allowed = (hl >= p.min_child_weight) & (hr >= p.min_child_weight) & (hl > 0) & (hr > 0) & columns[:, None]
        gain = np.where(allowed, score(gl, hl) + score(gr, hr) - score(g, h), -np.inf)
        f, b = np.unravel_index(gain.argmax(), gain.shape)
        if gain[f, b] <= LEAST_GAIN:
            continue
        tree.feature[node], tree.cut[node], tree.gain[node] = f, b, gain[f, b]
        tree.value[2 * node + 1] = -gl[f, b] / (hl[f, b] + p.reg_lambda) * p.eta
        tree.value[2 * node + 2] = -gr[f, b] / (hr[f, b] + p.reg_lambda) * p.eta


def prune(tree: Tree, gamma: float) -> None:
    """From the bottom up, splits of two leaves that gain less than ``gamma`` go."""
    inner = len(tree.feature) // 2
    for node in reversed(range(inner)):
        if tree.feature[node] >= 0 and tree.gain[node] < gamma and (tree.feature[[2 * node + 1, 2 * node + 2]] < 0).all():
            tree.feature[node] = -1


def bin_bounds(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Ascending values that cut each feature into at most ``max_bins`` parts:
    quantiles weighted by the hessians of the first round, which are all equal.
    A feature of fewer values has a cut at each."""
    shares = [i / max_bins for i in range(1, max_bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"q{i}") for i, c in enumerate(features)],
                 *[F.max(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    out = []
    for i in range(len(features)):
        q = np.unique(np.array(row[f"q{i}"] or [], np.float64))
        out.append(q[q < row[f"m{i}"]] if row[f"m{i}"] is not None else q)
    return out


def binned(x: np.ndarray, bounds: Sequence[np.ndarray]) -> np.ndarray:
    """Bin b holds the values above bound b - 1 and up to bound b; unknown
    values are below all."""
    return np.stack([np.searchsorted(b, np.where(np.isnan(x[:, i]), -np.inf, x[:, i]), side="left")
                     for i, b in enumerate(bounds)], axis=1).astype(np.int32)


@dataclass
class Boosted:
    """Fitted models: their parameters, the bounds of the bins, and the trees
    of each round."""
    params: list[BoostParams]
    features: list[str]
    bounds: list[np.ndarray]
    trees: list[list[Tree]] = field(default_factory=list)  # by round, then model (None when the model is done)

    def stage_scores(self, x: np.ndarray, models: Sequence[int], stages: Sequence[int]) -> np.ndarray:
        """Probabilities of class 1 by some of the models after each of
        ``stages`` rounds: rows x models x stages. Models of equal trees so far
        are one."""
        bins, stages = binned(x, self.bounds), list(stages)
        out, alike = np.zeros((len(x), len(models), len(stages))), [([*range(len(models))], np.zeros(len(x)))]
        for r in range(max(stages) + 1):
            if r in stages:
                for some, margin in alike:
                    out[:, some, stages.index(r)] = (1.0 / (1.0 + np.exp(-margin)))[:, None]
            if r < len(self.trees):
                by_tree: dict = {}
                for k, (some, margin) in enumerate(alike):
                    for i in some:
                        tree = self.trees[r][models[i]]
                        by_tree.setdefault((k, id(tree)), (tree, margin, []))[2].append(i)
                alike = [(some, margin if tree is None else margin + tree.value[tree.leaf_of(bins)])
                         for tree, margin, some in by_tree.values()]
        return out

    def score(self, df: DataFrame, *, stages: Sequence[Sequence[int]] | None = None) -> DataFrame:
        """``df`` with one row for each model and stage (a number of rounds;
        default the model's own): ``model``, ``stage`` and the probability
        ``score`` of class 1."""
        stages = [list(s) for s in stages] if stages else [[p.rounds] for p in self.params]
        features, bounds, trees = self.features, self.bounds, self.trees
        schema = T.StructType([*df.schema.fields, T.StructField("model", T.IntegerType()),
                               T.StructField("stage", T.IntegerType()), T.StructField("score", T.DoubleType())])
        keep = df.columns

        def run(frames):
            for frame in frames:
                bins = binned(_numbers(frame, features), bounds)
                for m, wanted in enumerate(stages):
                    margin = np.zeros(len(frame))
                    for r in range(max(wanted) + 1 if wanted else 0):
                        if r in wanted:
                            yield frame[keep].assign(model=m, stage=r, score=1.0 / (1.0 + np.exp(-margin)))
                        if r < len(trees) and trees[r][m] is not None:
                            margin += trees[r][m].value[trees[r][m].leaf_of(bins)]
        return df.mapInPandas(run, schema)


def _numbers(frame: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    return np.stack([pd.to_numeric(frame[c]).to_numpy(dtype=np.float64, na_value=np.nan) for c in features], axis=1)


def boost(df: DataFrame, params: Sequence[BoostParams], *, features: Sequence[str], id_col: str, label: str = "y",
          fold_col: str | None = None, max_bins: int = MAX_BINS) -> Boosted:
    """Fit all models of ``params`` on the rows of ``df`` (a long id, a 0/1
    label, numeric features; ``fold_col`` where models leave a fold out). Rows
    with a null label are not trained on. What reaches the driver is models x
    nodes of a level x features x bins."""
    params, features = list(params), list(features)
    bounds = bin_bounds(df, features, max_bins)
    n_bins, n_models, d = max((len(b) for b in bounds), default=0) + 1, len(params), len(features)
    out = Boosted(params, features, bounds)
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(id_col).cast("long").alias("__id"), F.col(label).cast("double").alias("__y"),
        (F.col(fold_col) if fold_col else F.lit(-1)).cast("int").alias("__fold"), *features)
    held, spark = "__id long, __y double, __fold int, __bins array<int>, __margins array<double>", df.sparkSession
    by_kin: dict = {}
    for m, p in enumerate(params):
        by_kin.setdefault(replace(p, gamma=0.0, rounds=0), []).append(m)
    kin = list(by_kin.values())
    paths: list[str] = []

    def written(some: DataFrame) -> tuple[DataFrame, int]:
        paths.append(shared_path(spark, "boost-rows"))
        some.write.parquet(paths[-1])
        if len(paths) > 1:
            delete_path(spark, paths.pop(0))
        now = spark.read.schema(held).parquet(paths[0])
        return now, now.rdd.getNumPartitions()

    def start(frames):
        for frame in frames:
            yield frame[["__id", "__y", "__fold"]].assign(__bins=list(binned(_numbers(frame, features), bounds)),
                                                          __margins=list(np.zeros((len(frame), len(by_kin)))))

    def state_of(frame):
        return [np.concatenate(list(frame[c])).reshape(len(frame), -1) if len(frame) else np.zeros((0, d), int) for c in ("__bins", "__margins")]

    def margin_of(m, rows, bins, margins, column, trees):
        """Margins of some rows by model ``m`` after all of ``trees``."""
        margin = margins[rows, column[m]]
        for by_model in trees:
            if by_model[m] is not None:
                margin = margin + by_model[m].value[by_model[m].leaf_of(bins)]
        return margin

    def sums(column, trees, growing, level, round_):
        def part(frame):
            bins, margins = state_of(frame)
            ids, fold, y = frame["__id"].to_numpy(), frame["__fold"].to_numpy(), frame["__y"].to_numpy()
            drawn = {}
            for m, tree in growing.items():
                p = params[m]
                if (p.fold, p.subsample, p.seed) not in drawn:
                    mine = np.ones(len(frame), bool) if p.fold is None else fold != p.fold
                    if p.subsample < 1:
                        mine &= uniform(ids, round_, p.seed) < p.subsample
                    rows = np.flatnonzero(mine)
                    drawn[p.fold, p.subsample, p.seed] = rows, bins[rows], np.ascontiguousarray(bins[rows].T, np.int64), y[rows]
                rows, mine, turned, wanted = drawn[p.fold, p.subsample, p.seed]
                g, h = gradients(margin_of(m, rows, mine, margins, column, trees), wanted)
                yield m, level_sums(turned, g, h, tree.leaf_of(mine, level) if level else None, level, n_bins).ravel()
        return part

    state, parts = written(dealt(rows, "__id").mapInPandas(start, held))
    since, column = 0, {m: i for i, some in enumerate(kin) for m in some}
    for round_ in range(max(p.rounds for p in params)):
        # the first of each kin grows the tree of all
        kin = [some for some in ([m for m in every if round_ < params[m].rounds] for every in kin) if some]
        growing = {some[0]: Tree.empty(params[some[0]].depth) for some in kin}
        for level in range(max(params[m].depth for m in growing)):
            todo = {m: t for m, t in growing.items() if level < params[m].depth and (
                not level or (t.feature[(1 << (level - 1)) - 1:(1 << level) - 1] >= 0).any())}
            if not todo:
                break
            found = array_sums(state, sums(column, out.trees[since:], todo, level, round_), partitions=parts)
            for m in todo:
                if m in found:
                    split_level(todo[m], found[m].reshape(2, 1 << level, d, n_bins), level, params[m],
                                columns_of(params[m], d, round_))
        grown: list[Tree | None] = [None] * n_models
        split_kin: dict = {}
        for k, some in enumerate(kin):
            for m in some:
                tree = replace(growing[some[0]], feature=growing[some[0]].feature.copy())
                prune(tree, params[m].gamma)
                alike = split_kin.setdefault((k, tree.feature.tobytes()), (tree, []))
                grown[m] = alike[0]
                alike[1].append(m)
        kin = [some for _, some in split_kin.values()]
        out.trees.append(grown)
        if len(out.trees) - since >= ROUNDS_HELD and round_ + 1 < max(p.rounds for p in params):
            def settle(frames, first=[some[0] for some in kin], column=column, trees=out.trees[since:]):
                for frame in frames:
                    bins, margins = state_of(frame)
                    every = np.arange(len(frame))
                    yield frame.assign(__margins=list(np.stack([margin_of(m, every, bins, margins, column, trees) for m in first], axis=1)))
            state, parts = written(state.mapInPandas(settle, held))
            since, column = len(out.trees), {m: i for i, some in enumerate(kin) for m in some}
    delete_path(spark, paths[0])
    return out
