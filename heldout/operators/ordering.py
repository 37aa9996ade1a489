"""Ranks and running sums over a total order, with no group in one task.

A window without a fine partition key sends a whole group to one task.  Here
rows are cut into value ranges first; each range is summed on its own and shifted
by the totals of the ranges before it, which are one row per (group, range).
Ranges come from quantiles of the first order column, so that column should not
repeat one value over much of the table; where values do repeat, the callers
count them first and rank the distinct ones.
"""
from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keyed import uniform
from .common import cut, parallelism

RANGE = "__range"


def with_ranges(df: DataFrame, order: str, n_ranges: int | None = None) -> DataFrame:
    """Adds the number of the value range that ``order`` falls in.

    Bounds are quantiles from one aggregate; only those few numbers reach the driver.
    """
    n = n_ranges or parallelism(df.sparkSession)
    value = F.col(order).cast("timestamp").cast("double") if _is_time(df, order) else F.col(order).cast("double")
    staged = df.withColumn("__v", value)
    probs = [i / n for i in range(1, n)] or [0.5]
    row = staged.agg(F.percentile_approx("__v", F.array(*[F.lit(p) for p in probs]), 20 * n).alias("q")).first()
    cuts = sorted({q for q in (row["q"] or []) if q == q and abs(q) != float("inf")})
    splits = [-float("inf"), *cuts, float("inf")]
    if len(splits) == 2:
        splits = [-float("inf"), 0.0, float("inf")]
    out = Bucketizer(splits=splits, inputCol="__v", outputCol=RANGE, handleInvalid="keep").transform(staged)
    return out.withColumn(RANGE, F.coalesce(F.col(RANGE).cast("int"), F.lit(-1))).drop("__v")


def _is_time(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName().startswith("timestamp")


def with_hash_ranges(df: DataFrame, u: str, n_ranges: int | None = None) -> DataFrame:
    """As ``with_ranges`` for a column already uniform on [0, 1): no quantile pass."""
    n = n_ranges or parallelism(df.sparkSession)
    return df.withColumn(RANGE, F.coalesce(F.floor(F.col(u) * n).cast("int"), F.lit(-1)))


def running(df: DataFrame, order: list, sums: dict[str, Column], by: list[str] = (),
            keep_range: bool = False) -> DataFrame:
    """Exclusive running sums (``name``) and group totals (``name_total``) of a ranged table.

    ``df`` carries the range column, whose order agrees with ``order``; rows whose
    order value is null come first.  Group columns must not be null.
    """
    by = list(by)
    keys = [*by, RANGE]
    parts = df.groupBy(*keys).agg(*[F.sum(c).alias(f"__{n}_part") for n, c in sums.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys,
        *[F.coalesce(F.sum(f"__{n}_part").over(before), F.lit(0)).alias(f"__{n}_off") for n in sums],
        *[F.sum(f"__{n}_part").over(group).alias(f"{n}_total") for n in sums])
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = df.select("*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"__{n}_loc") for n, c in sums.items()])
    joined = ranged.join(offsets, keys)
    out = joined.select(
        *[F.col(c) for c in df.columns if c != RANGE or keep_range],
        *[(F.col(f"__{n}_loc") + F.col(f"__{n}_off")).alias(n) for n in sums],
        *[F.col(f"{n}_total") for n in sums])
    return out


def running_max(df: DataFrame, order: list, value: Column, by: list[str], name: str) -> DataFrame:
    """Inclusive running maximum of a ranged table."""
    by = list(by)
    keys = [*by, RANGE]
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    staged = df.withColumn("__m", value)
    offsets = staged.groupBy(*keys).agg(F.max("__m").alias("__part")).select(
        *keys, F.max("__part").over(group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)).alias("__off"))
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = staged.withColumn("__loc", F.max("__m").over(local)).join(offsets, keys)
    return joined.select(*[F.col(c) for c in df.columns if c != RANGE],
                         F.greatest("__loc", F.coalesce("__off", "__loc")).alias(name))


def positions(df: DataFrame, order: list[str], by: list[str] = (), name: str = "position") -> DataFrame:
    """0-based place of each row in its group; ``order[0]`` is numeric or a time."""
    ranged = with_ranges(df, order[0])
    return running(ranged, order, {name: F.lit(1)}, by)


def hash_positions(df: DataFrame, seed, key: str | list[str], by: list[str] = (), name: str = "position") -> DataFrame:
    """0-based place of each distinct key in a seeded shuffle of its group.

    Adds ``name`` and ``name_total``.  The shuffle depends on seed and key only.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ranged = with_hash_ranges(df.withColumn("__u", uniform(seed, *[F.col(k) for k in keys])), "__u")
    return running(ranged, ["__u", *keys], {name: F.lit(1)}, by).drop("__u")


def value_ranks(df: DataFrame, value: str, by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """Average ranks of the distinct values: start + (count + 1) / 2, 1-based.

    Counts are taken per value first, so a value held by most rows stays one row.
    """
    counted = df.groupBy(*by, value).agg(F.sum(weight if weight is not None else F.lit(1)).alias("ties"))
    ranked = running(with_ranges(cut(counted), value), [value], {"below": F.col("ties")}, by)
    return ranked.withColumn("rank", F.col("below") + (F.col("ties") + 1) / F.lit(2.0)) \
        .withColumnRenamed("below_total", "n")
