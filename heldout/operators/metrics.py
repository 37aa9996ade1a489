"""Point metrics per cell.  ``by`` names the cell columns; empty means one cell."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .ordering import running, with_ranges


def nan() -> Column:
    return F.lit(float("nan"))


def r2(rows: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred", name: str = "value") -> DataFrame:
    """1 - residual / total about the cell's own mean; NaN when the total is 0."""
    t, q = F.col(y).cast("double"), F.col(p).cast("double")
    sums = rows.groupBy(*by).agg(F.sum((t - q) * (t - q)).alias("__res"), (F.var_pop(t) * F.count(t)).alias("__tot"))
    return sums.select(*by, F.when(F.col("__tot") > 0, 1 - F.col("__res") / F.col("__tot")).otherwise(nan()).alias(name))


def confusion(y: str, p: str) -> dict[str, Column]:
    t, q = F.col(y).cast("int"), F.col(p).cast("int")
    return {k: F.sum(c.cast("long")) for k, c in {
        "tp": (t == 1) & (q == 1), "fn": (t == 1) & (q != 1),
        "tn": (t == 0) & (q == 0), "fp": (t == 0) & (q != 0)}.items()}


def present_recall(tp: Column, fn: Column, tn: Column, fp: Column) -> Column:
    """Mean recall over the classes that occur; NaN if none does."""
    pos = F.when(tp + fn > 0, tp / (tp + fn))
    neg = F.when(tn + fp > 0, tn / (tn + fp))
    return F.coalesce((pos + neg) / 2, pos, neg, nan())


def balanced_accuracy(rows: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred",
                      name: str = "value") -> DataFrame:
    counts = rows.groupBy(*by).agg(*[c.alias(k) for k, c in confusion(y, p).items()])
    return counts.select(*by, present_recall(*[F.col(k) for k in ("tp", "fn", "tn", "fp")]).alias(name))


def tied_counts(rows: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """Positive and negative counts per distinct score."""
    t = F.col(y).cast("int")
    return rows.groupBy(*by, F.col(score).cast("double").alias("__s")).agg(
        F.sum((t == 1).cast("long")).alias("pos"), F.sum((t == 0).cast("long")).alias("neg"))


def tied_scores(rows: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """Positive and negative counts per distinct score, cut into score ranges."""
    return with_ranges(cut(tied_counts(rows, by, y, score)), "__s")


def area(ranged: DataFrame, by: list[str], name: str) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties counting half."""
    run = running(ranged, ["__s"], {"neg_below": F.col("neg")}, by)
    sums = run.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * F.lit(0.5))).alias("__w"),
        F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    both = (F.col("__p") > 0) & (F.col("__n") > 0)
    return sums.select(*by, F.when(both, F.col("__w") / (F.col("__p").cast("double") * F.col("__n"))).otherwise(nan()).alias(name))


def auroc(rows: DataFrame, by: list[str], y: str = "y_true", score: str = "y_score", name: str = "value") -> DataFrame:
    """Area under the ROC curve by midranks; NaN with one class."""
    return area(tied_scores(rows, by, y, score), by, name)


METRICS = {"r2": r2, "balanced_accuracy": balanced_accuracy, "auroc": auroc}


def metric(kind: str, rows: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred", name: str = "value") -> DataFrame:
    if kind not in METRICS:
        raise ValueError(f"unknown metric {kind!r}")
    return METRICS[kind](rows, by, y, p, name=name)
