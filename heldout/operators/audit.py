"""Integrity and label audits.  Each check is a small table of rows."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.keyed import uniform
from ..functions.pvalues import kolmogorov_p
from .common import cut, finite
from .metrics import nan
from .ordering import hash_positions, positions, running, with_ranges


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def refuse_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    example = duplicate_keys(rows, keys).limit(1).collect()
    if example:
        raise RuntimeError(f"duplicate rows, e.g. {example[0].asDict()}")
    return rows


def correspondence(features: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows on both sides and on one side only; passed when every key pairs."""
    a = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("__a"))
    b = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("__b"))
    both = a.join(b, keys, "full_outer").select(F.coalesce("__a", F.lit(0)).alias("a"), F.coalesce("__b", F.lit(0)).alias("b"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = both.agg(n("a").alias("feature_rows"), n("b").alias("target_rows"),
                   n((F.col("b") == 0).cast("long")).alias("features_only"), n((F.col("a") == 0).cast("long")).alias("targets_only"),
                   n((F.col("a") != F.col("b")).cast("long")).alias("unequal_keys"))
    return out.withColumn("passed", F.col("unequal_keys") == 0)


def first_frames(rows: DataFrame, scene: str, frame: str, columns: list[str]) -> DataFrame:
    """One row per scene: the values at its first frame."""
    return rows.groupBy(scene).agg(F.min_by(F.struct(*columns), frame).alias("__s")).select(scene, "__s.*")


def missing_ids(found: DataFrame, key: str, expected: int) -> DataFrame:
    wanted = found.sparkSession.range(expected).withColumnRenamed("id", key)
    return wanted.join(found.select(F.col(key).cast("long").alias(key)), key, "left_anti")


def missing_report(missing: DataFrame, key: str, listed: int = 20) -> DataFrame:
    """How many are missing and the first few of them, in order."""
    first = missing.orderBy(key).limit(listed).agg(F.array_sort(F.collect_list(key)))
    total = missing.agg(F.count(F.lit(1)).alias("n_missing"))
    return total.select("n_missing", first.scalar().alias("examples"), F.greatest(F.col("n_missing") - listed, F.lit(0)).alias("n_more"))


def dead_shard(missing: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """The commonest gap between missing ids, if it dominates: (stride, gaps, shard).

    Gaps come from joining each place in the order with the next, not from a
    window over all ids.
    """
    placed = positions(missing.select(F.col(key).cast("long").alias(key)), [key])
    nxt = placed.select((F.col("position") - 1).alias("position"), F.col(key).alias("__next"))
    gaps = placed.join(nxt, "position").groupBy((F.col("__next") - F.col(key)).alias("stride")).agg(F.count(F.lit(1)).alias("gaps"))
    top = gaps.orderBy(F.desc("gaps"), "stride").limit(1)
    total = missing.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))).scalar()
    return top.select("stride", "gaps", total.alias("t")).where((F.col("t.n") > 2) & (F.col("gaps") > F.col("t.n") * F.lit(share))) \
        .select("stride", "gaps", F.col("t.n").alias("n_missing"), F.pmod(F.col("t.first"), F.col("stride")).alias("shard"))


def unpaired(found: DataFrame, partner: DataFrame, key: str) -> DataFrame:
    return found.select(key).distinct().join(partner.select(key), key, "left_anti")


def quality_rollup(scenes: DataFrame, flags: list[str], means: list[str], corrupt: str | None = None,
                   frames_per_scene: float = 10.0) -> DataFrame:
    """Flag counts, means that skip missing values, contact rate, unreadable records."""
    bad = F.col(corrupt).isNotNull() if corrupt else F.lit(False)
    row = scenes.agg(
        F.count(F.lit(1)).alias("n_found"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("unreadable"),
        *[F.coalesce(F.sum(F.col(f).cast("boolean").cast("long")), F.lit(0)).alias(f) for f in flags],
        *[F.avg(finite(F.col(m))).alias(f"mean_{m}") for m in means])
    if "n_contact_frames" in means:
        row = row.withColumn("contact_positive_rate", F.col("mean_n_contact_frames") / F.lit(frames_per_scene))
    return row


def rule_problems(report: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violated): one row per rule over a one-row report; counts that the report lacks were not asked for."""
    report = report.withColumns({c: F.lit(None).cast("long") for c in ("n_missing", "n_unpaired") if c not in report.columns})
    cells = [F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("violated")) for n, c in rules.items()]
    return report.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


CORPUS_RULES = {                     # fixed values: bounds of a healthy corpus
    "no_scenes": "n_found = 0",
    "scenes_missing": "coalesce(n_missing, 0) > 0",
    "scenes_unpaired": "coalesce(n_unpaired, 0) > 0",
    "distractor_touched": "distractor_touched > 0",
    "left_the_frame": "all_frames_in_frame < n_found - unreadable",
    "contact_rate_outside_band": "contact_positive_rate not between 0.25 and 0.55",
    "unreadable_records": "unreadable > 0",
}


def corpus_rules() -> dict[str, Column]:
    return {n: F.expr(e) for n, e in CORPUS_RULES.items()}


def completeness(report: DataFrame, missing: DataFrame | None = None, without_partner: DataFrame | None = None) -> DataFrame:
    """A roll-up beside the number of missing scenes and of those without a counterpart; null where it was not asked."""
    for name, rows in (("n_missing", missing), ("n_unpaired", without_partner)):
        report = report.withColumn(name, F.lit(None).cast("long") if rows is None else rows.agg(F.count(F.lit(1))).scalar())
    return report


def _check(rows: DataFrame, name, value: Column, passed: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("name"), value.cast("double").alias("value"), passed.cast("boolean").alias("passed"))


def rate_band(rows: DataFrame, column: str, low: float, high: float) -> DataFrame:
    m = rows.agg(F.avg(F.col(column).cast("double")).alias("v"))
    return _check(m, f"{column}_rate", F.col("v"), F.col("v").between(low, high))


def not_constant(rows: DataFrame, column: str) -> DataFrame:
    m = rows.agg(F.avg(F.col(column).cast("double")).alias("v"))
    return _check(m, f"{column}_not_constant", F.col("v"), (F.col("v") > 0) & (F.col("v") < 1))


def finite_checks(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A failing row per column with non-finite values, else one passing row; a single scan."""
    numeric = columns or [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)]
    sums = rows.agg(*[F.coalesce(F.sum(finite(F.col(c)).isNull().cast("long")), F.lit(0)).alias(c) for c in numeric])
    cells = F.array(*[F.struct(F.lit(f"finite:{c}").alias("name"), F.col(c).alias("value")) for c in numeric])
    bad = F.filter(cells, lambda s: s["value"] > 0)
    fine = F.array(F.struct(F.lit("all_targets_finite").alias("name"), F.lit(0).cast("long").alias("value")))
    out = sums.select(F.explode(F.when(F.size(bad) > 0, bad).otherwise(fine)).alias("c")).select("c.*")
    return out.select("name", F.col("value").cast("double").alias("value"), (F.col("value") == 0).alias("passed"))


def uniform_cdf(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / F.lit(high - low)))


def log_uniform_cdf(x: Column, low: float, high: float) -> Column:
    import math
    a, b = math.log(low), math.log(high)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log(F.greatest(x, F.lit(1e-12))) - F.lit(a)) / F.lit(b - a)))


def ks_statistic(values: DataFrame, value: str, cdf) -> DataFrame:
    """(statistic, n): largest gap between the empirical and the given distribution.

    Works on distinct values with counts; order comes from value ranges.
    """
    counted = values.select(F.col(value).cast("double").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("ties"))
    run = running(with_ranges(counted, "v"), ["v"], {"below": F.col("ties")})
    f, n = cdf(F.col("v")), F.col("below_total")
    gap = F.greatest((F.col("below") + F.col("ties")) / n - f, f - F.col("below") / n)
    return run.agg(F.max(gap).alias("statistic"), F.coalesce(F.max(n), F.lit(0)).alias("n"))


def ks_check(values: DataFrame, value: str, cdf, name: str, level: float = 0.01, method: str = "exact") -> DataFrame:
    """The KS test as a check row; only (D, n) reaches the driver."""
    row = ks_statistic(values, value, cdf).first()
    p = kolmogorov_p(row["statistic"] if row["statistic"] is not None else float("nan"), int(row["n"]), method)
    return values.sparkSession.createDataFrame([(f"ks:{name}", p, bool(p > level), row["statistic"], int(row["n"]))],
                                               "name string, value double, passed boolean, statistic double, n long")


def label_gate(frames: DataFrame, scene: str, frame: str, contact: str, support: str,
               distributions: dict[str, tuple], band=(0.25, 0.55)) -> DataFrame:
    """All label checks in one table: rates, constancy, finiteness, per-scene distributions with their statistic and n."""
    checks = rate_band(frames, contact, *band).unionByName(not_constant(frames, support)).unionByName(finite_checks(frames))
    checks = checks.withColumn("statistic", F.lit(None).cast("double")).withColumn("n", F.lit(None).cast("long"))
    held = [c for c in distributions if c in frames.columns]
    if held:
        first = cut(first_frames(frames, scene, frame, held))
        for c in held:
            checks = checks.unionByName(ks_check(first, c, distributions[c], c))
    return checks


def label_report(checks: DataFrame, frames: DataFrame, scene: str) -> DataFrame:
    """One row: the gate's verdict over its checks, frames, scenes and the checks themselves."""
    said = checks.agg(F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False)).alias("passed"), F.sort_array(F.collect_list(F.struct(*checks.columns))).alias("checks"))
    size = frames.agg(F.struct(F.count(F.lit(1)).alias("f"), F.countDistinct(scene).alias("s"))).scalar()
    return said.withColumn("__n", size).select("passed", F.col("__n.f").alias("n_frames"), F.col("__n.s").alias("n_scenes"), "checks")


def gate_verdicts(checks: DataFrame, gate: str = "gate") -> DataFrame:
    """One verdict per gate: fail if any check failed, needs human if any is null, else pass."""
    v = checks.groupBy(gate).agg(F.sum((F.col("passed") == F.lit(False)).cast("int")).alias("f"),
                                 F.sum(F.col("passed").isNull().cast("int")).alias("h"), F.count(F.lit(1)).alias("n_checks"))
    failed, human = F.coalesce(F.col("f"), F.lit(0)) > 0, F.col("h") > 0
    return v.select(gate, "n_checks", F.when(failed, F.lit(False)).when(human, F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("passed"),
                    F.when(failed, F.lit("fail")).when(human, F.lit("needs human")).otherwise(F.lit("pass")).alias("verdict"))


def review_sample(frames: DataFrame, scene: str, frame: str, n: int = 20, per_scene: int = 2, seed: int = 0) -> DataFrame:
    """n frames for a human to look at, at most ``per_scene`` of a scene, in a seeded order."""
    u = uniform(seed, "review", F.col(scene), F.col(frame))
    few = hash_positions(frames, F.lit(f"{seed}|review"), [scene, frame], [scene], name="__r").where(F.col("__r") < per_scene)
    return few.drop("__r", "__r_total").withColumn("__u", u).orderBy("__u", scene, frame).limit(n).drop("__u")


def half_precision(x: Column) -> Column:
    """Vector rounded to IEEE half and back."""
    @F.arrow_udf("array<double>")
    def rounded(v: pa.Array) -> pa.Array:
        flat = v.flatten().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(v.offsets.cast(pa.int32()), pa.array(flat.astype(np.float32).astype(np.float16).astype(np.float64)))
    return rounded(x.cast("array<double>"))


def pair_equality(base: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per column: pairs compared, pairs that differ (nulls compare equal) and rows on one side only; passed if there are neither."""
    b = base.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in columns], F.lit(1).alias("__b"))
    both = other.select(*keys, *columns, F.lit(1).alias("__o")).join(b, keys, "full_outer")
    pair = F.col("__b").isNotNull() & F.col("__o").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = both.agg(count(pair).alias("__n"), count(~pair).alias("__lonely"), *[
        count(pair & ~F.col(c).eqNullSafe(F.col(f"__b_{c}"))).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("factor"), F.col("__n").alias("n_pairs"), F.col(c).alias("n_unequal"), F.col("__lonely").alias("n_one_sided"),
                               ((F.col(c) == 0) & (F.col("__lonely") == 0) & (F.col("__n") > 0)).alias("passed")) for c in columns])
    return sums.select(F.explode(cells).alias("r")).select("r.*")


def divergence(base: DataFrame, other: DataFrame, keys: list[str], columns: list[str], scene: str, bound: float) -> DataFrame:
    """Per scene: the largest absolute difference over matched rows, rows without a partner or value, and whether it diverged.

    A scene diverges beyond the bound, or if any of its rows could not be compared.
    """
    b = base.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in columns])
    gaps = [F.abs(F.col(c) - F.col(f"__b_{c}")) for c in columns]
    worst = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    open_ = finite(gaps[0]).isNull()
    for g in gaps[1:]:
        open_ = open_ | finite(g).isNull()
    return other.select(*keys, *columns).join(b, keys, "full_outer").groupBy(scene).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.when(~open_, worst)).alias("max_divergence"), F.sum(open_.cast("long")).alias("n_uncompared")) \
        .withColumn("diverged", (F.col("n_uncompared") > 0) | (F.col("max_divergence") > bound))


def determinism(first: DataFrame, again: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6, exact: list[str] = ()) -> DataFrame:
    """One row: keys on one side only, the largest difference, values that one side lacks or that differ where they must be equal, passed.

    A value that is null or not finite on one side only is ``n_unequal``, as is any
    difference in the columns of ``exact``; two tables without a common row do not pass.
    """
    a = first.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns], *[F.col(c).alias(f"x_{c}") for c in exact], F.lit(1).alias("__a"))
    b = again.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns], *[F.col(c).alias(f"y_{c}") for c in exact], F.lit(1).alias("__b"))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    gaps = [F.abs(finite(F.col(f"a_{c}")) - finite(F.col(f"b_{c}"))) for c in columns]
    other = [(finite(F.col(f"a_{c}")).isNull() != finite(F.col(f"b_{c}")).isNull()).cast("long") for c in columns]
    other += [(finite(F.col(f"a_{c}")).isNull() & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) & finite(F.col(f"b_{c}")).isNull()).cast("long") for c in columns]
    other += [(~F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}"))).cast("long") for c in exact]
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = a.join(b, keys, "full_outer").agg(
        count((~both).cast("long")).alias("one_sided"), F.coalesce(F.max(F.when(both, F.greatest(*gaps, F.lit(0.0)))), F.lit(0.0)).alias("max_difference"),
        count(F.when(both, sum(other, F.lit(0)))).cast("long").alias("n_unequal"), count(both.cast("long")).alias("__n"))
    return out.withColumn("passed", (F.col("__n") > 0) & (F.col("one_sided") == 0) & (F.col("n_unequal") == 0) & (F.col("max_difference") <= tolerance)).drop("__n")


def applied_equals_sampled(sampled: DataFrame, recorded: DataFrame, key: str, column: str, tolerance: float = 1e-6) -> DataFrame:
    """One row over all scenes of either side; a scene without a record or with a missing value fails the check."""
    gap = F.abs(F.col("__s") - F.col("__r"))
    both = sampled.select(key, F.col(column).cast("double").alias("__s")).join(
        recorded.select(key, F.col(column).cast("double").alias("__r")), key, "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    known = finite(gap)
    out = both.agg(F.count(F.lit(1)).alias("n_scenes"), F.max(known).alias("max_difference"), count(known > tolerance).alias("n_wrong"), count(known.isNull()).alias("n_missing"))
    return out.withColumn("passed", (F.col("n_scenes") > 0) & (F.col("n_wrong") == 0) & (F.col("n_missing") == 0))
