"""Kernel SVM through Nystroem landmarks.

The kernel is replaced by its exact projection onto the span of ``landmarks``
training rows (the ones of the smallest id hashes): phi(x) = K(x, L) W with
W W' = K(L, L)^-1. With all rows as landmarks this is the kernel SVM itself; with
fewer, the error falls with the kernel's spectrum (measured in the tests against
an exact dual solution). The hinge is smoothed over a width that shrinks
to ``WIDTHS[-1]``; Newton steps add gradients and Hessians in the tasks that
hold the rows. All models of a run (folds, C, gamma) share every pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.operators.partials import array_sums, dealt
from hearth.session import cut_lineage

LANDMARKS = 128
#: Rows whose distances to the landmarks stay in a core's cache.
KERNEL_ROWS = 512
#: Half widths of the smoothed corner of the hinge, one after another; in the first all rows start inside it.
WIDTHS = (2.0, 0.5, 0.1, 0.02)
STEPS, CLOSE = 25, 1e-6


@dataclass(frozen=True)
class SvmParams:
    """``fold``: the fold left out of the training (None: all rows are trained on)."""
    C: float = 1.0
    gamma: float = 0.01
    fold: int | None = None


@dataclass
class Lift:
    """The map of one (gamma, fold)."""
    landmarks: np.ndarray
    gamma: float
    weights: np.ndarray

    @classmethod
    def fit(cls, landmarks: np.ndarray, gamma: float) -> Lift:
        value, vector = np.linalg.eigh(rbf(landmarks, landmarks, gamma))
        keep = value > 1e-10 * max(value.max(initial=0.0), 1e-300)
        return cls(landmarks, gamma, vector[:, keep] / np.sqrt(value[keep]))

    def __call__(self, kernel: np.ndarray) -> np.ndarray:
        """The mapped rows, whose kernel with the landmarks is given, and a one for the intercept."""
        out = kernel @ np.hstack((self.weights, np.zeros((len(self.weights), 1))))
        out[:, -1] = 1.0
        return out


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    return kernels(x, y, [gamma])[0]


def kernels(x: np.ndarray, y: np.ndarray, gammas: Sequence[float]) -> list[np.ndarray]:
    """The kernel of each of ``gammas``, from distances that are made once."""
    out = [np.empty((len(x), len(y))) for _ in gammas]
    for a in range(0, len(x), KERNEL_ROWS):
        some = x[a:a + KERNEL_ROWS]
        apart = np.zeros((len(some), len(y)))
        for j in range(x.shape[1]):
            diff = some[:, j:j + 1] - y[:, j]
            diff *= diff
            apart += diff
        for gamma, k in zip(gammas, out):
            np.exp(np.multiply(apart, -gamma, out=k[a:a + KERNEL_ROWS]), out=k[a:a + KERNEL_ROWS])
    return out


def lifted(lifts: dict[tuple, Lift], fold: int | None, gammas: Sequence[float], x: np.ndarray) -> dict[float, np.ndarray]:
    """The rows mapped for a fold by each of ``gammas``, which share the fold's landmarks."""
    gammas = list(dict.fromkeys(gammas))
    if not gammas:
        return {}
    return {g: lifts[g, fold](k) for g, k in zip(gammas, kernels(x, lifts[gammas[0], fold].landmarks, gammas))}


@cache
def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a symmetric matrix that tell the others."""
    return np.triu_indices(n)


def hinge(margin: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smoothed hinge of y f(x), its slope and its curvature."""
    short = 1 + width - margin
    corner = (short > 0) & (short < 2 * width)
    loss = np.where(short <= 0, 0.0, np.where(corner, short ** 2 / (4 * width), short - width))
    slope = np.where(short <= 0, 0.0, np.where(corner, -short / (2 * width), -1.0))
    return loss, slope, np.where(corner, 1 / (2 * width), 0.0)


@dataclass
class FittedSvm:
    params: list[SvmParams]
    features: list[str]
    lifts: dict[tuple, Lift]
    weights: list[np.ndarray]

    def margins(self, x: np.ndarray, fold: int | None) -> np.ndarray:
        """Margins by the models that leave ``fold`` out: rows x models, in their order."""
        mine = [m for m, p in enumerate(self.params) if p.fold == fold]
        z = lifted(self.lifts, fold, [self.params[m].gamma for m in mine], x)
        return np.stack([z[self.params[m].gamma] @ self.weights[m] for m in mine], axis=1)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with one row for each model: ``model`` and the margin ``score``."""
        params, features, margins = self.params, self.features, self.margins
        folds = {f: [m for m, p in enumerate(params) if p.fold == f] for f in dict.fromkeys(p.fold for p in params)}
        keep, schema = df.columns, T.StructType([*df.schema.fields, T.StructField("model", T.IntegerType()),
                                                 T.StructField("score", T.DoubleType())])

        def run(frames):
            for frame in frames:
                x = frame[features].to_numpy(dtype=np.float64)
                for fold, mine in folds.items():
                    for m, score in zip(mine, margins(x, fold).T):
                        yield frame[keep].assign(model=m, score=score)
        return df.mapInPandas(run, schema)


def fit_svm(df: DataFrame, params: Sequence[SvmParams], *, features: Sequence[str], id_col: str, label: str = "y",
            fold_col: str | None = None, landmarks: int = LANDMARKS) -> FittedSvm:
    """Fit all models of ``params`` on the rows of ``df`` (0/1 label; features
    that are not null). What reaches the driver is models x landmarks^2."""
    params, features = list(params), list(features)
    rows = cut_lineage(dealt(df.where(F.col(label).isNotNull()).select(
        F.col(id_col).alias("__id"), (2.0 * F.col(label) - 1.0).alias("__y"),
        (F.col(fold_col) if fold_col else F.lit(-1)).cast("int").alias("__fold"),
        *[F.col(c).cast("double").alias(c) for c in features]), "__id"), "svm-rows")
    lifts = {}
    for fold in dict.fromkeys(p.fold for p in params):
        some = rows if fold is None else rows.where(F.col("__fold") != fold)
        drawn = some.orderBy(F.xxhash64("__id"), "__id").select(*features).limit(landmarks).collect()
        held = np.unique(np.array([tuple(r) for r in drawn], np.float64).reshape(len(drawn), len(features)), axis=0)
        for gamma in dict.fromkeys(p.gamma for p in params if p.fold == fold):
            lifts[gamma, fold] = Lift.fit(held, gamma)
    weights = [np.zeros(lifts[p.gamma, p.fold].weights.shape[1] + 1) for p in params]

    def sums(at, width, todo):
        def part(frame):
            x, y, fold = frame[features].to_numpy(dtype=np.float64), frame["__y"].to_numpy(), frame["__fold"].to_numpy()
            for held_out in dict.fromkeys(params[m].fold for m in todo):
                models = [m for m in todo if params[m].fold == held_out]
                mine = np.ones(len(x), bool) if held_out is None else fold != held_out
                z_of, t, made = lifted(lifts, held_out, [params[m].gamma for m in models], x[mine]), y[mine], {}
                for m in models:
                    z = z_of[params[m].gamma]
                    loss, slope, curve = hinge(t * (z @ at[m]), width)
                    corner = curve > 0
                    key = params[m].gamma, corner.tobytes()
                    if key not in made:
                        # rows outside the corner add nothing to the Hessian, those inside alike
                        bent = z if corner.all() else z[corner]
                        made[key] = (bent.T @ bent)[_upper(z.shape[1])] / (2 * width)
                    yield m, np.concatenate(([loss.sum()], (slope * t) @ z, made[key]))
        return part

    parts = rows.rdd.getNumPartitions()
    for width in WIDTHS:
        todo, best, step = list(range(len(params))), {}, {}
        for _ in range(STEPS):
            if not todo:
                break
            going = []
            for m, s in array_sums(rows, sums(weights, width, todo), partitions=parts).items():
                w, c = weights[m], params[m].C
                ridge = np.append(np.ones(len(w) - 1), 0.0)
                value = 0.5 * (ridge * w * w).sum() + c * s[0]
                if m in best and value > best[m][0] + 1e-9 * abs(best[m][0]):
                    # too far: half the step from the best point
                    step[m] = step[m] / 2
                    if np.abs(step[m]).max() > CLOSE:
                        weights[m] = best[m][1] + step[m]
                        going.append(m)
                    else:
                        weights[m] = best[m][1]
                    continue
                best[m] = (value, w)
                grad = ridge * w + c * s[1:len(w) + 1]
                curve = np.zeros((len(w), len(w)))
                curve[_upper(len(w))] = s[len(w) + 1:]
                curve = np.diag(ridge + 1e-9) + c * (curve + np.triu(curve, 1).T)
                step[m] = -np.linalg.solve(curve, grad)
                if np.abs(step[m]).max() <= CLOSE * (1 + np.abs(w).max()):
                    continue
                weights[m] = w + step[m]
                going.append(m)
            todo = going
        for m in todo:
            weights[m] = best[m][1] if m in best else weights[m]
    return FittedSvm(params, features, lifts, weights)
