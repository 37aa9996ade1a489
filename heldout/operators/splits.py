"""Train/test splits, folds and the shuffled-label control, all by scene.

A scene is never on both sides.  Every assignment follows the order of a seeded
hash of the scene, so it depends on seed and scene alone.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .ordering import hash_positions, positions

CONTROL_OFFSET = 9973                # fixed value: the control's seed is the probe's plus this


def scene_split(rows: DataFrame, scene: str, seed: int, train_fraction: float = 0.8) -> DataFrame:
    """(scene, is_train): the first round(fraction * n) scenes of the shuffle, kept within 1..n-1."""
    ranked = hash_positions(rows.select(scene).distinct(), seed, scene)
    n = F.col("position_total")
    n_train = F.greatest(F.lit(1), F.least(F.bround(F.lit(float(train_fraction)) * n).cast("long"), n - 1))
    return ranked.select(scene, F.when(n == 1, F.lit(True)).otherwise(F.col("position") < n_train).alias("is_train"))


def grouped_folds(rows: DataFrame, scene: str, n_folds: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """(scene, fold): shuffled scenes dealt in turn; refuses fewer scenes than folds."""
    ranked = hash_positions(rows.select(scene).distinct(), seed, scene)
    refusal = F.raise_error(F.concat(F.col("position_total").cast("string"),
                                     F.lit(f" scenes cannot make {n_folds} folds"))).cast("int")
    fold = F.when(F.col("position_total") < n_folds, refusal) \
        .otherwise(F.pmod(F.col("position"), F.lit(n_folds)).cast("int"))
    return ranked.select(scene, fold.alias(name))


def mark(rows: DataFrame, assignment: DataFrame, scene: str) -> DataFrame:
    """Carries a per-scene assignment to the rows; small scene tables are broadcast."""
    return rows.join(assignment, scene)


def only_scenes(rows: DataFrame, scenes: DataFrame, scene: str) -> DataFrame:
    return rows.join(scenes.select(scene).distinct(), scene, "left_semi")


def strided_shards(rows: DataFrame, key: str, n_shards: int) -> DataFrame:
    """(key, shard): ids in order, every n-th to the same shard."""
    ranked = positions(rows.select(key).distinct(), [key])
    return ranked.select(key, F.pmod(F.col("position"), F.lit(n_shards)).cast("int").alias("shard"))


def shuffled_labels(rows: DataFrame, scene: str, frame: str, labels: list[str], seed: int) -> DataFrame:
    """Labels moved between scenes and permuted within: (scene, frame, labels...).

    Scene number i in id order takes the block of scene number i in shuffle order;
    rows of the block are dealt in a keyed order.  A shorter donor wraps around.
    All labels of a row move together.
    """
    seed = seed + CONTROL_OFFSET
    scenes = cut(rows.groupBy(scene).agg(F.count(F.lit(1)).alias("__size")))
    taker = positions(scenes.select(scene), [scene], name="turn").select(scene, "turn")
    giver = hash_positions(scenes, seed, scene, name="turn").select(F.col(scene).alias("__donor"), "__size", "turn")
    pairing = cut(taker.join(giver, "turn").select(scene, "__donor", "__size"))
    donors = positions(rows.select(scene, frame, *labels), [frame], [scene], name="__at").select(
        F.col(scene).alias("__donor"), F.col("__at"), *labels)
    places = hash_positions(rows.select(scene, frame), seed, [scene, frame], [scene], name="__at")
    wanted = places.join(pairing, scene) \
        .select(scene, frame, "__donor", F.pmod(F.col("__at"), F.col("__size")).alias("__at"))
    return wanted.join(donors, ["__donor", "__at"]).select(scene, frame, *labels)


def selectivity(real: DataFrame, control: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Score on the real task less the score on the control."""
    return real.select(*on, F.col(value).alias("real")).join(
        control.select(*on, F.col(value).alias("control")), on) \
        .withColumn("selectivity", F.col("real") - F.col("control"))
