"""From raw predictions to summary rows, comparisons, verdicts and curves.

Predictions are one long table: exp, seed, encoder, train_condition, layer, view,
task, eval_condition, target, scene_index, frame_index, y_true, y_pred, y_score,
occlusion_fraction.  Nothing here refits a model, and all cells go through one job.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bootstrap as B
from .common import cut, finite
from .metrics import METRICS, balanced_accuracy, nan, present_recall, r2
from .testing import difference_tests, holm, verdict

# Names of the cell columns and targets, bins and their least sizes.
CELL = ["exp", "seed", "encoder", "train_condition", "layer", "view", "task", "eval_condition", "target"]
REGRESSION = ("log_mass", "friction_slide", "obj_pos_x", "obj_pos_y", "obj_speed", "ee_obj_dist")
CLASSIFICATION = ("contact_state", "support_state")
BINS = (0.0, 0.2, 0.4, 0.6, 1.01)    # fixed values
MIN_BIN_ROWS, MIN_BIN_SCENES = 30, 8


def headline(target: Column, classes=CLASSIFICATION) -> Column:
    """The metric a target is reported by; unknown targets are regressions."""
    return F.when(target.isin(*classes), F.lit("balanced_accuracy")).otherwise(F.lit("r2"))


def chance(metric: Column) -> Column:
    return F.when(metric == "r2", F.lit(0.0)).when(metric.isin("balanced_accuracy", "auroc"), F.lit(0.5))


def cell_scores(predictions: DataFrame, cell: list[str] = CELL, classes=CLASSIFICATION) -> DataFrame:
    """Headline value per cell: (cell..., metric, value)."""
    is_class = F.col("target").isin(*classes)
    a = r2(predictions.where(~is_class), cell).withColumn("metric", F.lit("r2"))
    b = balanced_accuracy(predictions.where(is_class), cell).withColumn("metric", F.lit("balanced_accuracy"))
    return a.unionByName(b)


def summarize(predictions: DataFrame, n_boot: int = 2000, cell: list[str] = CELL, classes=CLASSIFICATION) -> DataFrame:
    """One row per cell and metric with interval, trivial score and majority rate.

    Draws are keyed by seed and scene set, so the metrics of a cell describe the
    same resampled scenes.
    """
    is_class = F.col("target").isin(*classes)
    scene = "scene_index"
    facts = predictions.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(scene).alias("n_scenes"),
        F.avg(F.col("y_true").cast("double")).alias("__rate"))
    plans = [("r2", predictions.where(~is_class), "y_pred"),
             ("balanced_accuracy", predictions.where(is_class), "y_pred"),
             ("auroc", predictions.where(is_class & F.col("y_score").isNotNull()), "y_score")]
    parts = [METRICS[kind](rows, cell, "y_true", p).withColumn("metric", F.lit(kind)) for kind, rows, p in plans]
    drawn = B.samples({kind: (rows, "y_true", p) for kind, rows, p in plans}, cell, scene, n_boot, 0)
    spread = B.interval(drawn, [*cell, "metric"]).drop("n_boot")
    long = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(spread, [*cell, "metric"])
    majority = F.when(F.col("metric") != "r2", F.greatest("__rate", 1 - F.col("__rate")))
    return long.join(facts, cell).select(*cell, "n_rows", "n_scenes", "metric", "value", "ci_low", "ci_high",
                                         chance(F.col("metric")).alias("trivial"), majority.alias("majority_rate"))


def aggregate_seeds(summary: DataFrame) -> DataFrame:
    """Mean over seeds; the interval is the union of the seeds' intervals, the spread a population sd."""
    keys = ["exp", "encoder", "train_condition", "layer", "view", "task", "eval_condition", "target", "metric"]
    skip = lambda c: finite(F.col(c))
    return summary.groupBy(*keys).agg(
        F.avg(skip("value")).alias("value"), F.min(skip("ci_low")).alias("ci_low"), F.max(skip("ci_high")).alias("ci_high"),
        F.stddev_pop(skip("value")).alias("seed_sd"), F.count(F.lit(1)).alias("n_seeds"),
        F.min_by("trivial", "seed").alias("trivial"), F.min_by("majority_rate", "seed").alias("majority_rate"))


def best_cells(scores: DataFrame, by: list[str], cell: list[str] = ("layer", "view")) -> DataFrame:
    """The best finite cell per group; equal values go to the first cell in order.

    Chosen on held-out scores, hence optimistic: it makes a claim of absence harder.
    Scores are read once: sums of doubles differ in their last bits from one
    evaluation to the next, so a best value never meets its own row by equality.
    """
    ok = scores.where(finite(F.col("value")).isNotNull())
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("value").desc(), *cell))
    return ok.withColumn("__place", place).where("__place = 1").select(*by, *cell, "value")


def compare_to_baseline(predictions: DataFrame, encoder: str, baseline: str, margin: float = 0.05, n_boot: int = 2000,
                        classes=CLASSIFICATION, baseline_predictions: DataFrame | None = None, skip_mismatched: bool = False) -> DataFrame:
    """Paired contrast of two encoders' best cells per (exp, seed, target).

    Rows are paired by key and must all pair; otherwise the call fails, or, with
    ``skip_mismatched``, that (exp, seed, target) has no row.  A baseline table of its
    own is met by every exp that has its (seed, target).  Both models' sums ride on the same
    scene rows, so each replicate resamples the same scenes for both.
    """
    unit = ["exp", "seed", "target"]
    rest = [c for c in CELL if c not in {*unit, "encoder"}]
    key = [*unit, "scene_index", "frame_index"]

    def side(frame, name, tag):
        rows = frame.where(F.col("encoder") == name)
        best = cut(best_cells(cut(cell_scores(rows, CELL, classes)), unit, rest))
        picked = rows.join(best.withColumnRenamed("value", f"__v{tag}"), [*unit, *rest])
        return picked.select(*key, F.col("y_true").alias(f"y{tag}"), F.col("y_pred").alias(f"p{tag}"), f"__v{tag}")

    a = side(predictions, encoder, "a")
    b = side(baseline_predictions if baseline_predictions is not None else predictions, baseline, "b")
    if baseline_predictions is not None:
        b = b.drop("exp").join(predictions.where(F.col("encoder") == encoder).select(*unit).distinct(), ["seed", "target"])
    paired = cut(a.join(b, key, "full_outer"))
    lonely = paired.where(F.col("pa").isNull() | F.col("pb").isNull()).select(*unit).distinct()
    if skip_mismatched:
        paired = cut(paired.join(lonely, unit, "left_anti"))
    elif lonely.limit(1).count():
        raise RuntimeError("encoder and baseline were evaluated on different rows")
    is_class = F.col("target").isin(*classes)
    observed = cut(paired.groupBy(*unit).agg((F.max("__va") - F.max("__vb")).alias("observed")))
    names = {"a": "pa", "b": "pb"}
    r = B.regression_sums(paired.where(~is_class), unit, "scene_index", "ya", names)
    c = B.confusion_sums(paired.where(is_class), unit, "scene_index", "ya", names)
    drawn = B.resample(r.unionByName(c, allowMissingColumns=True), unit, "scene_index", n_boot, 0)      # one stage of counts for all targets
    gaps = drawn.select(*unit, "b", F.when(is_class, B.balanced_of("a") - B.balanced_of("b")).otherwise(B.r2_of("a") - B.r2_of("b")).alias("gap"))
    tests = difference_tests(gaps.join(observed, unit), unit, "gap", "observed", margin)
    return tests.select("exp", "seed", F.lit(encoder).alias("encoder"), F.lit(baseline).alias("baseline"), "target",
                        headline(F.col("target"), classes).alias("metric"),
                        *[x for x in tests.columns if x not in unit])


def hypothesis_table(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adjusts within the seeds of one target and reads the verdict."""
    family = ["encoder", "baseline", "target"]
    adjusted = holm(tests, "p_superiority", family, "p_superiority_holm")
    return adjusted.withColumn("holm_family", F.concat(F.lit("seeds tested for target="), F.col("target"))) \
        .withColumn("verdict", verdict(F.col("p_superiority_holm"), F.col("tost_equivalent"), F.col("tost_margin"), alpha))


def bin_of(x: Column, bins=BINS) -> Column:
    """Number of the half-open bin that holds x; null outside."""
    out = None
    for i, (lo, hi) in enumerate(zip(bins, bins[1:])):
        hit = (x >= F.lit(float(lo))) & (x < F.lit(float(hi)))
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


def paired_rows(predictions: DataFrame, encoder: str, targets, task: str = "transfer",
                base: str = "base", other: str = "occluded") -> DataFrame:
    """Each row of the treated evaluation beside the base row of the same scene and frame.

    Of several cells the first in (layer, view) order is taken.  A target whose
    treated rows do not all find a partner is left out.
    """
    rows = predictions.where((F.col("encoder") == encoder) & (F.col("task") == task) & F.col("target").isin(*targets))
    unit, spot = ["exp", "seed", "target"], ["layer", "view"]
    cells = cut(rows.select(*unit, *spot).distinct())         # few rows; the least of structs is found by sorting all that it sees
    first = cut(cells.groupBy(*unit).agg(F.min(F.struct(*spot)).alias("__c")).select(*unit, "__c.*"))
    rows = rows.join(first, [*unit, *spot])
    key = [*unit, "scene_index", "frame_index"]
    b = rows.where(F.col("eval_condition") == base).select(*key, F.col("y_true").alias("y_base"), F.col("y_pred").alias("p_base"))
    o = rows.where(F.col("eval_condition") == other).select(*key, F.col("y_true").alias("y_occ"), F.col("y_pred").alias("p_occ"), "occlusion_fraction", F.lit(True).alias("__other"))
    both = cut(b.join(o, key, "full_outer"))
    scenes = both.groupBy(*unit, "scene_index").agg(F.bool_or(F.coalesce("__other", F.lit(False))).alias("__other"),
                                                    F.bool_and(F.col("p_base").isNotNull() & F.col("p_occ").isNotNull()).alias("__ok"))
    whole = cut(scenes.where("__other").groupBy(*unit).agg(F.bool_and("__ok").alias("__ok")).where("__ok").drop("__ok"))
    return both.where("__other").drop("__other").join(whole, unit)


def retained_skill(paired: DataFrame, unit: list[str], seed="seed", classes=CLASSIFICATION, bins=BINS, n_boot: int = 500,
                   min_rows: int = MIN_BIN_ROWS, min_scenes: int = MIN_BIN_SCENES) -> DataFrame:
    """(unit..., bin, n_rows, value, ci_low, ci_high, base_value): skill kept relative to the matched base rows.

    Within a bin R2 divides by the variance of the whole treated set, so bins are
    on one scale.  Every unit has a row for every bin; thin and empty ones give NaN.  Scenes of the bin are resampled with both
    sides together.
    """
    is_class = F.col("target").isin(*classes)
    spread = paired.groupBy(*unit).agg(F.var_pop(F.col("y_occ").cast("double")).alias("__var"))
    rows = paired.join(spread, unit).withColumn("bin", bin_of(F.col("occlusion_fraction"), bins))
    cell = [*unit, "bin"]
    hit = lambda y, p, v: ((F.col(y).cast("int") == v) & (F.col(p).cast("int") == v)).cast("double")
    miss = lambda y, p, v: ((F.col(y).cast("int") == v) & (F.col(p).cast("int") != v)).cast("double")
    sums = rows.where("bin is not null").groupBy(*cell, "scene_index").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.max("__var").alias("__var"),
        *[F.sum(F.pow(F.col(f"y_{s}").cast("double") - F.col(f"p_{s}"), 2)).alias(f"rss_{s}") for s in ("base", "occ")],
        *[F.sum(f(f"y_{s}", f"p_{s}", v)).alias(f"{k}_{s}") for s in ("base", "occ")
          for k, f, v in (("tp", hit, 1), ("fn", miss, 1), ("tn", hit, 0), ("fp", miss, 0))])
    sums = cut(sums)
    stats = [c for c in sums.columns if c not in {*cell, "scene_index", "__var"}]

    def score(s: str) -> Column:
        fit = F.when(F.col("__var") > 0, 1 - F.col(f"rss_{s}") / F.col("n") / F.col("__var")).otherwise(nan())
        return F.when(is_class, present_recall(*[F.col(f"{k}_{s}") for k in ("tp", "fn", "tn", "fp")])).otherwise(fit)

    level = F.when(is_class, F.lit(0.5)).otherwise(F.lit(0.0))
    room = F.col("__b") - level
    ratio = F.when(F.abs(room) > 1e-9, (F.col("__o") - level) / room).otherwise(nan())
    total = sums.groupBy(*cell).agg(*[F.sum(c).alias(c) for c in stats], F.max("__var").alias("__var"),
                                    F.count(F.lit(1)).alias("n_scenes"))
    total = total.withColumn("__b", score("base")).withColumn("__o", score("occ"))
    thick = (F.col("n") >= min_rows) & (F.col("n_scenes") >= min_scenes)
    point = total.select(*cell, F.col("n").cast("long").alias("n_rows"), thick.alias("__thick"),
                         ratio.alias("value"), F.col("__b").alias("base_value"), "__var")
    point = cut(point)
    drawn = B.resample(sums.drop("__var"), cell, "scene_index", n_boot, F.col(seed) if seed in unit else 0)
    drawn = drawn.join(point.select(*cell, "__var"), cell).withColumn("__b", score("base")).withColumn("__o", score("occ"))
    spread = B.interval(drawn.select(*cell, "b", ratio.alias("sample")), cell)
    keep = lambda c: F.when(F.col("__thick"), F.col(c)).otherwise(nan()).alias(c)
    every = paired.select(*unit).distinct().withColumn("bin", F.explode(F.array(*[F.lit(i) for i in range(len(bins) - 1)])))
    found = every.join(point.join(spread, cell), cell, "left").withColumn("__thick", F.coalesce("__thick", F.lit(False)))
    return found.select(*cell, F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), *[keep(c) for c in ("value", "ci_low", "ci_high", "base_value")])


def best_band(summary: DataFrame, by=("target", "encoder")) -> DataFrame:
    """Best row per group with its interval."""
    return summary.where(finite(F.col("value")).isNotNull()).groupBy(*by).agg(
        F.max(F.struct("value", "ci_low", "ci_high", "layer", "view")).alias("__b")).select(*by, "__b.*")


def layer_curve(summary: DataFrame, encoder: str, view: str) -> DataFrame:
    """Points of one encoder and view by layer with their error widths."""
    return summary.where((F.col("encoder") == encoder) & (F.col("view") == view)).select(
        "target", "layer", "metric", "value", (F.col("value") - F.col("ci_low")).alias("err_low"),
        (F.col("ci_high") - F.col("value")).alias("err_high"), chance(F.col("metric")).alias("chance")).orderBy("target", "layer")
