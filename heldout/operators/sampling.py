"""Scenes as a table of independent factors, each drawn from its own keyed stream."""
from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keyed import bernoulli, between, choice, log_between, zero_or_between

SHAPES = ("box", "sphere", "cylinder")


@dataclass(frozen=True)
class Factor:
    name: str
    group: str                      # physical | layout | appearance
    kind: str                       # continuous | categorical | binary
    draw: Callable[..., Column]     # keys -> Column
    levels: tuple = ()


def _c(name, group, draw, *args):
    return Factor(name, group, "continuous", lambda *k: draw(*args, *k))


def _b(name, group, p):
    return Factor(name, group, "binary", lambda *k: bernoulli(p, *k))


def _k(name, group, levels):
    return Factor(name, group, "categorical", lambda *k: choice(levels, *k), tuple(levels))


# Names, groups and ranges of the 24 factors.
FACTORS = (
    _c("mass", "physical", log_between, 0.05, 2.0),
    _c("friction_slide", "physical", between, 0.05, 1.2),
    _c("spawn_height", "physical", zero_or_between, 0.35, 0.02, 0.20),
    _c("obj_radius", "layout", between, 0.26, 0.36),
    _c("approach_angle", "layout", between, -0.52, 0.52),
    _c("push_dist", "layout", between, 0.08, 0.18),
    _c("obj_yaw", "layout", between, 0.0, math.pi / 2),
    _c("distractor_angle", "layout", between, 0.90, 1.40),
    _b("distractor_side", "layout", 0.5),
    _c("distractor_radius", "layout", between, 0.22, 0.42),
    _c("obj_size", "appearance", between, 0.03, 0.09),
    _c("obj_hue", "appearance", between, 0.0, 1.0),
    _k("obj_geom_type", "appearance", SHAPES),
    _c("floor_gray", "appearance", between, 0.62, 0.86),
    _c("light_x", "appearance", between, -0.35, 0.35),
    _c("light_y", "appearance", between, -0.35, 0.35),
    _c("light_z", "appearance", between, 1.60, 2.40),
    _c("cam_daz", "appearance", between, -2.0, 2.0),
    _c("cam_del", "appearance", between, -2.0, 2.0),
    _c("cam_ddist", "appearance", between, -0.03, 0.03),
    _b("distractor_present", "appearance", 0.5),
    _c("distractor_size", "appearance", between, 0.03, 0.09),
    _c("distractor_hue", "appearance", between, 0.0, 1.0),
    _k("distractor_geom_type", "appearance", SHAPES),
)
FINGER_RADIUS = 0.012                # fixed value, metres
SATURATION, VALUE = 0.75, 0.85       # fixed values of the hue ramp


def scene_id(condition: Column, index: Column) -> Column:
    return F.format_string("%s_%05d", condition, index)


def sample_factors(scenes: DataFrame, scene: str, seed: int, factors=FACTORS) -> DataFrame:
    """scene_index, master_seed and every factor; no shuffle, no order, no state.

    A value depends on (seed, scene, factor name) only, so adding a factor or a
    condition changes no other value.
    """
    index = F.col(scene).cast("long")
    return scenes.select(index.alias("scene_index"), F.lit(seed).alias("master_seed"),
                         *[f.draw(F.lit(seed), index, f.name).alias(f.name) for f in factors])


def factor_table(spark, n: int, seed: int, minimum: int = 0) -> DataFrame:
    """Factors of scenes 0..n-1; ``minimum`` raises n where a test needs enough draws."""
    return sample_factors(spark.range(max(n, minimum)), "id", seed)


def with_conditions(factors: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """One row per condition and scene, factors equal across conditions.

    ``limits`` caps a condition to scene indices below a number.
    """
    index = F.col("scene_index")
    wanted = F.array_compact(F.array(*[
        F.lit(c) if n is None else F.when(index < n, F.lit(c)) for c, n in limits.items()]))
    out = factors.select(F.explode(wanted).alias("condition"), "*")
    return out.select("condition", scene_id(F.col("condition"), index).alias("scene_id"),
                      *[c for c in out.columns if c != "condition"])


def hue_rgb(hue: Column, s: float = SATURATION, v: float = VALUE) -> dict[str, Column]:
    """Red, green and blue of a hue in [0, 1) at fixed saturation and value."""
    h = F.pmod(hue.cast("double"), F.lit(1.0)) * 6
    def channel(shift: float) -> Column:
        k = F.pmod(h + F.lit(shift), F.lit(6.0))
        return F.lit(v) - F.lit(v * s) * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))
    return {"r": channel(5.0), "g": channel(3.0), "b": channel(1.0)}


def clearance(radius: Column, angle: Column, size: Column) -> Column:
    """Gap between a distractor at (radius, angle off the push ray) and the finger on that ray."""
    return F.abs(radius * F.sin(angle)) - size * F.lit(math.sqrt(2.0)) - F.lit(FINGER_RADIUS)


def clearance_audit(factors: DataFrame, bound: float = 0.01) -> DataFrame:
    """Smallest clearance over scenes with a distractor, from the placed positions."""
    side = F.when(F.col("distractor_side") == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    ray = F.col("approach_angle")
    at = ray + side * F.col("distractor_angle")
    x, y = F.col("distractor_radius") * F.cos(at), F.col("distractor_radius") * F.sin(at)
    gap = F.abs(F.cos(ray) * y - F.sin(ray) * x) - F.col("distractor_size") * F.lit(math.sqrt(2.0)) - F.lit(FINGER_RADIUS)
    worst = factors.where("distractor_present = 1").agg(F.count(F.lit(1)).alias("n_scenes"), F.min(gap).alias("min_clearance"))
    return worst.withColumn("passed", F.col("min_clearance") > bound)
