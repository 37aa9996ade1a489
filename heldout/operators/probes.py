"""Ridge and logistic probes from distributed sums.

Rows carry ``folds``, an array with one entry per probe seed: the inner fold of a
training row, -1 for a held-out row.  One scan then serves every seed, fold,
target and penalty; the driver sees d-by-d matrices only.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .moments import matrix_of, sum_rows
from .ordering import hash_positions

RIDGE_ALPHAS = np.logspace(-3, 5, 17)        # fixed value
LOGISTIC_CS = np.logspace(-4, 4, 9)          # fixed value
DEAD = 1e-12                                 # fixed value: scale below this counts as constant
SAFE = 1e-5                       # least ratio of the pivots of a matrix that is solved directly
TIED = 12                                    # fixed value: penalties whose scores agree to so many places are tied, the least is taken


# ---- membership -------------------------------------------------------------

def membership(scenes: DataFrame, scene: str, seeds: list[int], n_folds: int = 5, train_fraction: float = 0.8, by: list[str] = ()) -> DataFrame:
    """(by..., scene, folds): the split and the inner folds of every seed from one shuffle per seed.

    Training scenes come first in the shuffle, so their place modulo ``n_folds``
    also deals them to folds.
    """
    each = scenes.select(*by, scene).distinct().withColumn("__seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    placed = hash_positions(each, F.col("__seed"), scene, [*by, "__seed"])
    n = F.col("position_total")
    n_train = F.when(n == 1, n).otherwise(F.greatest(F.lit(1), F.least(
        F.bround(F.lit(float(train_fraction)) * n).cast("long"), n - 1)))
    few = F.raise_error(F.lit(f"too few training scenes for {n_folds} folds")).cast("int")
    fold = F.when(n_train < n_folds, few).when(F.col("position") < n_train, F.pmod(F.col("position"), F.lit(n_folds))) \
        .otherwise(F.lit(-1)).cast("int")
    return placed.withColumn("__f", fold).groupBy(*by, scene).agg(
        F.array(*[F.max(F.when(F.col("__seed") == s, F.col("__f"))) for s in seeds]).alias("folds"))


def growing_membership(scenes: DataFrame, scene: str, seed: int, sizes: list[int], n_folds: int = 5,
                       train_fraction: float = 0.8) -> DataFrame:
    """(scene, folds) for one seed and several training sizes over the same held-out scenes.

    Entry k trains on the first ``sizes[k]`` scenes of the shuffle; -2 marks scenes it leaves out.
    """
    placed = hash_positions(scenes.select(scene).distinct(), seed, scene)
    n, p = F.col("position_total"), F.col("position")
    n_train = F.greatest(F.lit(1), F.least(F.bround(F.lit(float(train_fraction)) * n).cast("long"), n - 1))
    entry = lambda size: F.when(p >= n_train, F.lit(-1)).when(p < size, F.pmod(p, F.lit(n_folds))).otherwise(F.lit(-2)).cast("int")
    return placed.select(scene, F.array(*[entry(s) for s in sizes]).alias("folds"))


def with_folds(rows: DataFrame, scene: str, seeds: list[int], n_folds: int = 5, train_fraction: float = 0.8) -> DataFrame:
    return rows.join(membership(rows, scene, seeds, n_folds, train_fraction), scene)


# ---- moments per (seed, fold) -----------------------------------------------

def fold_moments(rows: DataFrame, z: str, center: np.ndarray, scale: np.ndarray, folds: str = "folds") -> DataFrame:
    """(s, fold, i, row): Z'Z of the standardised rows of every inner fold of every seed."""
    schema = "s int, fold int, i int, row array<double>"

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            m = matrix_of(batch.column(0))
            if not len(m):
                continue
            m = (m - center) / scale
            f = matrix_of(batch.column(1)).astype(int)
            for s in range(f.shape[1]):
                for fold in np.unique(f[:, s]):
                    if fold >= 0:
                        part = m[f[:, s] == fold]
                        key = (s, int(fold))
                        sums[key] = sums.get(key, 0.0) + part.T @ part
        for (s, fold), total in sums.items():
            d = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * d, pa.int32()), pa.array([fold] * d, pa.int32()), pa.array(range(d), pa.int32()),
                 pa.array(list(total), pa.list_(pa.float64()))], names=["s", "fold", "i", "row"])

    return sum_rows(rows.select(z, folds).mapInArrow(partial, schema), ["s", "fold", "i"])


# ---- ridge on moments (driver, d by d) --------------------------------------

@dataclass
class LinearFit:
    """Scores are (x - mean) / scale @ coef + intercept."""
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray            # d x k
    intercept: np.ndarray       # k
    penalty: np.ndarray         # k: chosen alpha or C
    cv_scores: np.ndarray       # penalties x k
    iterations: int = 0

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and intercept on the raw scale."""
        w = self.coef / self.scale[:, None]
        return w, self.intercept - self.mean @ w


def _blocks(m: np.ndarray, k: int):
    """Centred moments of a matrix laid out as [1, y (k), x]."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    return n, mean[:k], mean[k:], centred[k:, k:], centred[k:, :k], np.diag(centred)[:k]


def ridge_path(m: np.ndarray, k: int, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (a, d, k) and intercepts (a, k) of all penalties from one eigendecomposition."""
    n, my, mx, g, c, _ = _blocks(m, k)
    lam, v = np.linalg.eigh(g)
    shrunk = (v.T @ c)[None] / (np.maximum(lam, 0.0)[None, :, None] + alphas[:, None, None])
    beta = np.einsum("de,aek->adk", v, shrunk)
    return beta, my - np.einsum("d,adk->ak", mx, beta)


def held_out_r2(m: np.ndarray, k: int, beta: np.ndarray, b0: np.ndarray) -> np.ndarray:
    """R2 (a, k) on rows known only by their moments, about those rows' own mean."""
    n, my, mx, g, c, total = _blocks(m, k)
    bias = my - np.einsum("d,adk->ak", mx, beta) - b0
    residual = total - 2 * np.einsum("dk,adk->ak", c, beta) \
        + np.einsum("adk,de,aek->ak", beta, g, beta, optimize=True) + n * bias ** 2
    return np.where(total > DEAD, 1.0 - residual / np.maximum(total, DEAD), 0.0)


def ridge_from_moments(folds: dict[int, np.ndarray], k: int, center, scale, alphas=RIDGE_ALPHAS) -> LinearFit:
    """Choose a penalty per target on the mean of fold R2, refit on all training rows.

    The scaler comes from the whole training set, inner folds included.
    """
    total = sum(folds.values())
    n, _, mx, g, _, _ = _blocks(total, k)
    sd = np.sqrt(np.clip(np.diag(g) / n, 0, None))
    sd = np.where(sd * scale[1 + k:] < DEAD, 1.0, sd)
    # Re-express the moments with this training set's own mean and scale.
    move = np.eye(len(total))
    move[0, 1 + k:] = -mx
    move[:, 1 + k:] /= sd
    own = {f: move.T @ m @ move for f, m in folds.items()}
    full = sum(own.values())
    alphas = np.asarray(alphas, float)
    scores = np.zeros((len(alphas), 0)) if not k else np.mean([held_out_r2(m, k, *ridge_path(full - m, k, alphas)) for m in own.values()], axis=0)
    best = np.argmax(np.round(scores, TIED), axis=0) if k else None
    if not k:                                                   # only mean and scale are asked for
        return LinearFit(center[1:] + mx * scale[1:], sd * scale[1:], np.zeros((len(mx), 0)), np.zeros(0), np.zeros(0), np.zeros((len(alphas), 0)))
    beta, b0 = ridge_path(full, k, alphas)
    t = np.arange(k)
    return LinearFit(center[1 + k:] + mx * scale[1 + k:], sd * scale[1 + k:], beta[best, :, t].T,
                     b0[best, t] + center[1:1 + k], alphas[best], scores)


def _one_cell(rows: DataFrame, x: str, folds: str, yr: Column, yc: Column) -> DataFrame:
    return rows.select(F.lit(0).alias("cell"), F.col(x).cast("array<double>").alias("x"), yr.alias("yr"), yc.alias("yc"), F.col(folds).alias("folds"))


def fit_ridge(rows: DataFrame, x: str, targets: list[str] | str, seeds: list[int], folds: str = "folds",
              alphas=RIDGE_ALPHAS) -> list[LinearFit]:
    """One fit per seed, all targets jointly.  ``targets``: scalar columns, or one array column."""
    from .grid import fit_ridge as fit
    y = F.col(targets).cast("array<double>") if isinstance(targets, str) else F.array(*[F.col(t).cast("double") for t in targets])
    k = len(targets) if not isinstance(targets, str) else int(rows.select(F.size(targets)).first()[0])
    found = fit(_one_cell(rows, x, folds, y, F.array().cast("array<double>")), {0: k}, alphas)
    return [found[0, s] for s in range(len(seeds))]


def linear_scores(x: Column, fits: list[LinearFit]) -> Column:
    """Array of the scores of all fits, row by row; coefficients ride in the task closure."""
    raw = [f.folded() for f in fits]
    w = np.hstack([a for a, _ in raw])
    b = np.concatenate([np.atleast_1d(c) for _, c in raw])

    @F.arrow_udf("array<double>")
    def score(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.float64()))
        s = matrix_of(v) @ w + b
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))

    return score(x.cast("array<double>"))


# ---- logistic: Newton steps over shared scans -------------------------------

def _solved(hess: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """hess^-1 grad; the shortest least-squares solution where the matrix is not safely positive definite."""
    try:
        pivots = np.diag(np.linalg.cholesky(hess))
        if pivots.min() > SAFE * pivots.max():
            return np.linalg.solve(hess, grad)
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(hess, grad, rcond=None)[0]


class Path:
    """Newton state of one model along the ascending penalty grid."""

    def __init__(self, d: int, cs, tol: float, max_iter: int):
        self.w = np.zeros(d + 1)
        self.cs, self.tol, self.max_iter = list(cs), tol, max_iter
        self.solved: list[np.ndarray] = []
        self.steps = self.worst = 0
        self.base = self.value = None
        self.step, self.length, self.usable = None, 1.0, True

    @property
    def done(self) -> bool:
        return not self.usable or len(self.solved) == len(self.cs)

    def _penalised(self, w, loss, g, h, n):
        c = self.cs[len(self.solved)]
        p = np.append(w[:-1], 0.0) / (c * n)
        return loss / n + 0.5 * p @ w, g / n + p, h / n + np.diag(np.append(np.full(len(w) - 1, 1.0 / (c * n)), 0.0))

    def advance(self, loss, g, h, n, n_pos):
        """Consume the sums taken at ``self.w`` and move on."""
        if n_pos in (0, n):
            self.usable = False
            return
        value, _, _ = self._penalised(self.w, loss, g, h, n)
        if self.value is not None and value > self.value + 1e-12 * abs(self.value) and self.length > 1e-6:
            self.length /= 2
            self.w = self.base + self.length * self.step
            return
        while len(self.solved) < len(self.cs):
            value, grad, hess = self._penalised(self.w, loss, g, h, n)
            step = -_solved(hess, grad)
            if np.abs(grad).max() <= self.tol and -0.5 * grad @ step <= self.tol:
                self.solved.append(self.w.copy())
                self.worst, self.steps = max(self.worst, self.steps), 0
                continue
            self.steps += 1
            if self.steps >= self.max_iter:
                raise RuntimeError(f"logistic probe did not converge in {self.max_iter} steps; the coefficients would be truncated")
            self.base, self.step, self.value, self.length = self.w, step, value, 1.0
            self.w = self.base + step
            return


def fit_logistic(rows: DataFrame, x: str, y: str, seeds: list[int], n_folds: int = 5, folds: str = "folds",
                 cs=LOGISTIC_CS, tol: float = 1e-4, max_iter: int = 100) -> list[LinearFit | None]:
    """One fit per seed; None where the training rows hold one class.

    Every Newton step of every (seed, fold) model shares one scan.
    """
    from . import grid
    from .common import cut
    design = cut(_one_cell(rows, x, folds, F.array().cast("array<double>"), F.array(F.col(y).cast("double"))))
    trained = grid.fit_ridge(design, {0: 0})
    found = grid.fit_logistic(design, {0: 1}, trained, n_folds, cs, tol, max_iter)
    return [found.get((0, 0, s)) for s in range(len(seeds))]
