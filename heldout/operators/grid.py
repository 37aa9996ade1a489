"""Ridge and logistic probes of all cells of a grid in shared scans.

A design has a row per cell and frame: (cell, x, yr, yc, folds); vectors of one cell
have one length, cells may differ. Every scan serves all cells, seeds, folds, targets
and penalties. Partial matrices are symmetric and travel as half of their entries, in
pieces of PIECE numbers. They leave a task when they fill PARTIAL_BYTES, are summed by
(model, piece), and are solved in the tasks that hold the sums; the driver
sees scalers, coefficients and the states of Newton paths, never a matrix. Newton
models leave the scans as they converge, so the number of jobs is that of the longest
path plus a constant, however many cells there are.
"""
from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .moments import matrix_of, sum_rows
from .probes import DEAD, LOGISTIC_CS, RIDGE_ALPHAS, LinearFit, Path, ridge_from_moments

PARTIAL_BYTES = 1 << 26
PIECE = 1 << 16


def _runs(batch: pa.RecordBatch):
    """(cell, rows) for each run of rows of one cell."""
    cell = batch.column(0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
    for a, z in zip(cuts, cuts[1:]):
        if z > a:
            yield int(cell[a]), batch.slice(a, z - a)


class _Sums:
    """Vectors by key, told in pieces; ``add`` says when they should go."""

    def __init__(self, names: list[str]):
        self.names, self.held, self.size = names, {}, 0

    def add(self, key: tuple, vector: np.ndarray) -> bool:
        if key in self.held:
            self.held[key] += vector
        else:
            self.held[key] = vector
            self.size += vector.nbytes
        return self.size > PARTIAL_BYTES

    def told(self):
        for key, v in self.held.items():
            ends = np.append(np.arange(0, len(v), PIECE), len(v))
            pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v))
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(pieces), pa.int32()) for k in key), pa.array(np.arange(len(pieces), dtype=np.int32)), pieces], [*self.names, "i", "row"])
        self.held, self.size = {}, 0


@lru_cache(maxsize=8)
def _half(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def _packed(m: np.ndarray) -> np.ndarray:
    """The upper half of a symmetric matrix."""
    return m[_half(len(m))]


def _whole(v: np.ndarray) -> np.ndarray:
    n = int((2 * len(v)) ** 0.5)
    out = np.empty((n, n))
    out[_half(n)] = v
    out.T[_half(n)] = v
    return out


def _vector(table: pa.Table) -> np.ndarray:
    """The pieces of one key, put together."""
    order = np.argsort(table.column("i").to_numpy())
    return table.column("row").combine_chunks().take(pa.array(order)).flatten().to_numpy(zero_copy_only=False)


def _key_columns(key: tuple, names: list[str]) -> list[pa.Array]:
    return [pa.array([v], pa.int32()) for v, _ in zip(key, names)]


def scalers(design: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and scale of [1, yr, x] per cell, over all rows: they only keep sums of squares from cancelling."""
    z = F.concat(F.array(F.lit(1.0)), "yr", "x")
    out = {}
    for r in design.groupBy("cell").agg(Summarizer.metrics("mean", "variance").summary(array_to_vector(z)).alias("s"), F.max(F.size("yr")).alias("k")).collect():
        mean, scale = np.array(r["s"]["mean"].toArray()), np.sqrt(np.clip(np.array(r["s"]["variance"].toArray()), 0, None))
        scale[scale < DEAD] = 1.0
        mean[0], scale[:1 + r["k"]] = 0.0, 1.0
        out[r["cell"]] = (mean, scale)
    return out


def fit_ridge(design: DataFrame, n_targets: dict[int, int], alphas=RIDGE_ALPHAS) -> dict[tuple[int, int], LinearFit]:
    """(cell, place of the seed) -> fit of the cell's ``yr`` targets (a fit without targets still has mean and scale of the training rows)."""
    centred = scalers(design)
    spark = design.sparkSession
    known = spark.sparkContext.broadcast(centred)

    def partial(batches):
        sums = _Sums(["cell", "s", "fold"])
        for batch in batches:
            for cell, rows in _runs(batch):
                center, scale = known.value[cell]
                yr = matrix_of(rows.column(2)) if n_targets[cell] else np.zeros((rows.num_rows, 0))
                m = (np.hstack([np.ones((rows.num_rows, 1)), yr, matrix_of(rows.column(1))]) - center) / scale
                folds = matrix_of(rows.column(3)).astype(int)
                full = False
                for s in range(folds.shape[1]):
                    for fold in np.unique(folds[:, s]):
                        if fold >= 0:
                            part = m[folds[:, s] == fold]
                            full |= sums.add((cell, s, int(fold)), _packed(part.T @ part))
                if full:
                    yield from sums.told()
        yield from sums.told()

    summed = sum_rows(design.select("cell", "x", "yr", "folds").mapInArrow(partial, "cell int, s int, fold int, i int, row array<double>"), ["cell", "s", "fold", "i"])

    def solve(key, table):
        cell, s = (v.as_py() for v in key)
        fold = table.column("fold").to_numpy()
        fit = ridge_from_moments({int(f): _whole(_vector(table.filter(pa.array(fold == f)))) for f in np.unique(fold)}, n_targets[cell], *known.value[cell], alphas)
        return pa.Table.from_arrays([*_key_columns((cell, s), ["cell", "s"]), pa.array([pickle.dumps(fit)], pa.binary())], ["cell", "s", "fit"])

    found = summed.groupBy("cell", "s").applyInArrow(solve, "cell int, s int, fit binary").toArrow()
    return {(c, s): pickle.loads(b) for c, s, b in zip(*(found.column(i).to_pylist() for i in range(3)))}


def fit_logistic(design: DataFrame, n_targets: dict[int, int], trained: dict[tuple[int, int], LinearFit], n_folds: int = 5, cs=LOGISTIC_CS,
                 tol: float = 1e-4, max_iter: int = 100) -> dict[tuple[int, int, int], LinearFit | None]:
    """(cell, place of the target, place of the seed) -> fit of the cell's ``yc`` targets; None where the training rows hold one class.

    ``trained`` holds mean and scale of the training rows of every (cell, seed). The model
    on the whole training set walks the same warm-started path as the fold models.
    """
    names = ["cell", "t", "s", "fold"]
    models = {(c, t, s, f): Path(len(fit.mean), cs, tol, max_iter) for (c, s), fit in trained.items() for t in range(n_targets[c]) for f in [*range(n_folds), -1]}
    if not models:
        return {}
    spark = design.sparkSession
    scale = spark.sparkContext.broadcast({k: (f.mean, f.scale) for k, f in trained.items()})
    data = design.select("cell", "x", "yc", "folds")

    def standardised(x: np.ndarray, cell: int, s: int) -> np.ndarray:
        mean, sd = scale.value[cell, s]
        return np.hstack([(x - mean) / sd, np.ones((len(x), 1))])

    def wanted(keys):
        by: dict[int, dict[int, list]] = {}
        for k in keys:
            by.setdefault(k[0], {}).setdefault(k[2], []).append(k)
        return by

    def sums_at(now):
        def partial(batches):
            at, sums = wanted(now.value), _Sums(names)
            for batch in batches:
                for cell, rows in _runs(batch):
                    if cell not in at:
                        continue
                    x, y, folds = matrix_of(rows.column(1)), matrix_of(rows.column(2)), matrix_of(rows.column(3)).astype(int)
                    full = False
                    for s, keys in at[cell].items():
                        a = standardised(x, cell, s)
                        for key in keys:
                            use = (folds[:, s] >= 0) & (folds[:, s] != key[3])
                            b, truth = a[use], y[use, key[1]]
                            if not len(b):
                                continue
                            z = b @ now.value[key].w
                            p = 0.5 * (1 + np.tanh(0.5 * z))
                            facts = np.logaddexp(0.0, z).sum() - truth @ z, len(b), truth.sum()
                            slope = b.T @ (p - truth)
                            b *= np.sqrt(p * (1 - p))[:, None]
                            full |= sums.add(key, np.concatenate([facts, slope, _packed(b.T @ b)]))     # one matrix by itself: half the work
                    if full:
                        yield from sums.told()
            yield from sums.told()
        return sum_rows(data.mapInArrow(partial, "cell int, t int, s int, fold int, i int, row array<double>"), [*names, "i"])

    def step_of(now):
        def step(key, table):
            key = tuple(v.as_py() for v in key)
            found, path = _vector(table), now.value[key]
            d = len(path.w)
            try:
                path.advance(found[0], found[3:3 + d], _whole(found[3 + d:]), found[1], found[2])
                told = None
            except RuntimeError as error:
                told = str(error)
            return pa.Table.from_arrays([*_key_columns(key, names), pa.array([pickle.dumps(path)], pa.binary()), pa.array([told], pa.string())], [*names, "path", "error"])
        return step

    while current := {k: m for k, m in models.items() if not m.done}:
        now = spark.sparkContext.broadcast(current)
        found = sums_at(now).groupBy(*names).applyInArrow(step_of(now), "cell int, t int, s int, fold int, path binary, error string").toArrow()
        met = set()
        for *key, path, error in zip(*(found.column(i).to_pylist() for i in range(6))):
            if error:
                raise RuntimeError(error)
            models[tuple(key)] = pickle.loads(path)
            met.add(tuple(key))
        for k in current.keys() - met:                          # no rows to train on
            models[k].usable = False
        now.unpersist()

    counts = _confusions(data, {k: m for k, m in models.items() if m.usable and k[3] >= 0}, standardised, wanted, len(cs))
    fits: dict[tuple[int, int, int], LinearFit | None] = {}
    for (c, t, s, f), whole in models.items():
        if f != -1:
            continue
        if not whole.usable:
            fits[c, t, s] = None
            continue
        used = [g for g in range(n_folds) if models[c, t, s, g].usable]
        scores = np.zeros(len(cs))
        for g in used:
            for k in range(len(cs)):
                tp, fn, tn, fp = counts.get((c, t, s, g, k), (0, 0, 0, 0))
                recalls = [a / (a + b) for a, b in ((tp, fn), (tn, fp)) if a + b]
                scores[k] += np.mean(recalls) if recalls else np.nan
        scores = scores / max(len(used), 1)
        at = int(np.argmax(scores)) if used else int(np.argmin(np.abs(np.asarray(cs) - 1.0)))
        w = whole.solved[at]
        own = trained[c, s]
        fits[c, t, s] = LinearFit(own.mean, own.scale, w[:-1, None], w[-1:], np.array([float(cs[at])]), scores[:, None], max(models[c, t, s, g].worst for g in [*used, -1]))
    return fits


def _confusions(data: DataFrame, models: dict, standardised, wanted, n_cs: int) -> dict:
    """Held-out confusion counts of every (cell, target, seed, fold, penalty) in one scan."""
    known = data.sparkSession.sparkContext.broadcast({k: np.array(m.solved).T for k, m in models.items()})

    def partial(batches):
        at, sums = wanted(known.value), {}
        for batch in batches:
            for cell, rows in _runs(batch):
                if cell not in at:
                    continue
                x, y, folds = matrix_of(rows.column(1)), matrix_of(rows.column(2)) == 1, matrix_of(rows.column(3)).astype(int)
                for s, keys in at[cell].items():
                    a = standardised(x, cell, s)
                    for key in keys:
                        use = folds[:, s] == key[3]
                        if use.any():
                            hit, pos = a[use] @ known.value[key] > 0, y[use, key[1]][:, None]
                            sums[key] = sums.get(key, 0) + np.array([(hit & pos).sum(0), (~hit & pos).sum(0), (~hit & ~pos).sum(0), (hit & ~pos).sum(0)])
        rows_ = [(*k, c, *map(int, v[:, c])) for k, v in sums.items() for c in range(n_cs)]
        if rows_:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32() if i < 5 else pa.int64()) for i, a in enumerate(zip(*rows_))],
                                             names=["cell", "t", "s", "fold", "c", "tp", "fn", "tn", "fp"])

    summed = data.mapInArrow(partial, "cell int, t int, s int, fold int, c int, tp long, fn long, tn long, fp long") \
        .groupBy("cell", "t", "s", "fold", "c").agg(*[F.sum(v).alias(v) for v in ("tp", "fn", "tn", "fp")])
    return {tuple(r[:5]): tuple(r[5:]) for r in summed.collect()}


def held_out_accuracy(design: DataFrame, fits: dict[tuple[int, int], LinearFit]) -> dict[tuple[int, int], float]:
    """(cell, place of the seed) -> balanced accuracy of the cell's first ``yc`` target over the classes among its held-out rows, from one scan."""
    known = design.sparkSession.sparkContext.broadcast({k: f.folded() for k, f in fits.items()})

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            for cell, rows in _runs(batch):
                x, y, folds = matrix_of(rows.column(1)), matrix_of(rows.column(2))[:, 0], matrix_of(rows.column(3)).astype(int)
                for s in range(folds.shape[1]):
                    held = folds[:, s] == -1
                    if held.any() and (cell, s) in known.value:
                        w, b = known.value[cell, s]
                        hit, truth = (x[held] @ w + b)[:, 0] > 0, y[held]
                        sums[cell, s] = sums.get((cell, s), 0) + np.array([(hit & (truth == 1)).sum(), (truth == 1).sum(), (~hit & (truth == 0)).sum(), (truth == 0).sum()])
        if sums:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], pa.int32()) for i in range(2)), *(pa.array([int(v[i]) for v in sums.values()], pa.int64()) for i in range(4))], ["cell", "s", "tp", "p", "tn", "n"])

    summed = design.select("cell", "x", "yc", "folds").mapInArrow(partial, "cell int, s int, tp long, p long, tn long, n long").groupBy("cell", "s").agg(*[F.sum(c).alias(c) for c in ("tp", "p", "tn", "n")])
    out = {}
    for r in summed.collect():
        recalls = [a / b for a, b in ((r["tp"], r["p"]), (r["tn"], r["n"])) if b]
        out[r["cell"], r["s"]] = float(np.mean(recalls)) if recalls else float("nan")
    return out


def held_out_scores(rows: DataFrame, weights: dict[int, tuple[np.ndarray, np.ndarray]], slots: dict[int, list[tuple]], schema: str, keep: list[str]) -> DataFrame:
    """(keep..., the slot's values..., y_true, score) for every fit of a row's cell that holds the row out.

    ``rows`` are (cell, x, y, folds, keep...). A fit is a column of the cell's coefficients
    and intercepts on the raw scale; its slot is (place of the seed, place of the target in y, values as in ``schema``).
    """
    spark = rows.sparkSession
    kept = rows.select(*keep)
    told = to_arrow_schema(spark.createDataFrame([], schema).schema)
    heads = {c: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(list(zip(*at))[2:], told)], schema=told) for c, at in slots.items()}
    known = spark.sparkContext.broadcast({c: (*weights[c], np.array([v[0] for v in at]), np.array([v[1] for v in at]), heads[c]) for c, at in slots.items()})

    def score(batches):
        for batch in batches:
            for cell, part in _runs(batch):
                w, b, s, k, head = known.value[cell]
                y = part.column(2)
                at, slot = np.nonzero(matrix_of(part.column(3)).astype(int)[:, s] == -1)
                found = (matrix_of(part.column(1)) @ w + b)[at, slot]
                truth = y.flatten().take(pa.array(at * len(y[0]) + k[slot]))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(at)) for i in range(4, part.num_columns)),
                                                  *(column.take(pa.array(slot)) for column in head.columns), truth, pa.array(found)],
                                                 [*keep, *told.names, "y_true", "score"])

    held = rows.where(F.array_contains("folds", -1) & F.col("cell").isin(*slots)).select("cell", "x", "y", "folds", *keep)
    own = T.StructType([*kept.schema.fields, *spark.createDataFrame([], schema).schema.fields, T.StructField("y_true", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return held.mapInArrow(score, own)
