"""Transitions between consecutive frames and how well they are predicted."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import grid
from .common import correlation, cut, finite
from .metrics import nan
from .moments import matrix_of
from .ordering import positions
from .probes import fit_ridge, linear_scores


def transitions(rows: DataFrame, scene: str, frame: str, z: str, x: str, y: str, time: str, dense: bool = False) -> DataFrame:
    """(scene, frame, z_now, z_next, action): each frame with the next of its scene.

    Places in the scene are joined to the following place, so rows spread by
    (scene, place) and a long scene is no hot key.  ``dense`` says that ``frame``
    already counts 0, 1, 2, ... .
    """
    placed = rows.withColumn("__p", F.col(frame).cast("long")) if dense else positions(rows, [frame], [scene], name="__p")
    now = placed.select(scene, frame, "__p", F.col(z).alias("z_now"), F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(time).alias("__t"))
    nxt = placed.select(scene, (F.col("__p") - 1).alias("__p"), F.col(z).alias("z_next"),
                        F.col(x).alias("__x2"), F.col(y).alias("__y2"), F.col(time).alias("__t2"))
    pair = now.join(nxt, [scene, "__p"])
    action = F.array(*[c.cast("double") for c in (F.col("__x2") - F.col("__x"), F.col("__y2") - F.col("__y"),
                                                  F.col("__t2") - F.col("__t"), F.lit(1.0))])
    return pair.select(scene, frame, "z_now", "z_next", action.alias("action"))


def action_scale(train: DataFrame, action: str = "action", parts: int = 4, floor: float = 1e-8) -> list[float]:
    """Largest magnitude of each action part; 1 for a part that never moves."""
    row = train.agg(*[F.max(F.abs(F.col(action)[i])).alias(f"a{i}") for i in range(parts)]).first()
    return [v if v is not None and v >= floor else 1.0 for v in row]


def squared_error(a: str, b: str, scale) -> "F.Column":
    s = F.array(*[F.lit(float(v)) for v in scale])
    gap = F.transform(F.arrays_zip(F.col(a).alias("p"), F.col(b).alias("q"), s.alias("s")), lambda t: F.pow((t["p"] - t["q"]) / t["s"], 2))
    return F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v) / F.lit(float(len(scale)))


def stationary_mse(test: DataFrame, scale, z_now: str = "z_now", z_next: str = "z_next") -> DataFrame:
    """Mean squared change of the standardised latent: the error of predicting no change."""
    return test.agg(F.count(F.lit(1)).alias("n_test"), F.avg(squared_error(z_next, z_now, scale)).alias("stationary_mse"))


def predictability(moves: DataFrame, scene: str, folds: str, seeds: list[int]) -> list[dict]:
    """Linear next-latent predictor per seed: R2 against the stationary baseline on held-out scenes.

    Inputs are the latent and the scaled action, targets the next latent; all
    target dimensions share the moments.
    """
    out = []
    for s, seed in enumerate(seeds):
        own = moves.withColumn("folds", F.array(F.col(folds)[s]))
        train = own.where(F.col("folds")[0] >= 0)
        from .moments import standardiser
        _, scale = standardiser(train, "z_now", floor=1e-8)
        sizes = action_scale(train)
        act = F.transform(F.arrays_zip(F.col("action").alias("p"), F.array(*[F.lit(v) for v in sizes]).alias("s")), lambda t: t["p"] / t["s"])
        inputs = own.select("folds", "z_next", "z_now", F.concat(F.col("z_now").cast("array<double>"), act).alias("x"))
        fit = fit_ridge(inputs, "x", "z_next", [seed])[0]
        test = inputs.where(F.col("folds")[0] < 0).withColumn("guess", linear_scores(F.col("x"), [fit]))
        row = test.agg(F.count(F.lit(1)).alias("n"), F.avg(squared_error("z_next", "z_now", scale)).alias("still"),
                       F.avg(squared_error("z_next", "guess", scale)).alias("model")).first()
        still, model = row["still"], row["model"]
        out.append({"seed": seed, "n_test": row["n"], "latent_dim": len(scale), "model_mse": model, "stationary_mse": still,
                    "r2_vs_stationary": 1.0 - model / still if still else float("nan")})
    return out


def predictability_all(moves: DataFrame, sizes: dict[int, int]) -> dict[tuple[int, int], dict]:
    """As ``predictability`` for all cells and seeds in shared scans: (cell, place of the seed) -> its figures.

    ``moves`` holds (cell, z_now, z_next, action, folds), sorted by cell within its partitions; ``sizes`` the length of each cell's latent.
    The ridge standardises its inputs, so the action needs no scale of its own.
    """
    z = lambda c: F.col(c).cast("array<double>")
    design = cut(moves.select("cell", F.concat(z("z_now"), "action").alias("x"), z("z_next").alias("yr"), "folds"))
    fits = grid.fit_ridge(design, sizes)
    known = moves.sparkSession.sparkContext.broadcast({k: (*f.folded(), np.where(f.scale[:sizes[k[0]]] < 1e-8, 1.0, f.scale[:sizes[k[0]]])) for k, f in fits.items()})

    def errors(batches):
        sums: dict = {}
        for batch in batches:
            for cell, rows in grid._runs(batch):
                x, after, folds = (matrix_of(rows.column(i)) for i in (1, 2, 3))
                for s in range(folds.shape[1]):
                    held = folds[:, s] == -1
                    if held.any() and (cell, s) in known.value:
                        w, b, scale = known.value[cell, s]
                        still, model = (np.mean(((after[held] - v) / scale) ** 2, axis=1).sum() for v in (x[held, :sizes[cell]], x[held] @ w + b))
                        sums[cell, s] = sums.get((cell, s), 0.0) + np.array([held.sum(), still, model])
        if sums:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], pa.int32()) for i in range(2)), *(pa.array([v[i] for v in sums.values()], pa.float64()) for i in range(3))], ["cell", "s", "n", "still", "model"])

    found = design.mapInArrow(errors, "cell int, s int, n double, still double, model double").groupBy("cell", "s").agg(*[F.sum(c).alias(c) for c in ("n", "still", "model")]).collect()
    out = {}
    for r in found:
        still, model = r["still"] / r["n"], r["model"] / r["n"]
        out[r["cell"], r["s"]] = {"n_test": int(r["n"]), "latent_dim": sizes[r["cell"]], "model_mse": model, "stationary_mse": still, "r2_vs_stationary": 1.0 - model / still if still else float("nan")}
    return out


def correlation_over_cells(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson over cells where both are finite; NaN below three of them."""
    both = cells.select(finite(F.col(a)).alias("a"), finite(F.col(b)).alias("b")).dropna()
    return both.agg(F.count(F.lit(1)).alias("n_cells"), correlation("a", "b").alias("__r")).select(
        "n_cells", F.when(F.col("n_cells") > 2, F.coalesce("__r", nan())).otherwise(nan()).alias("pearson"))
