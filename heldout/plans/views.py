"""The shared tables seen as scenes and frames.

events      -> frames: a user is a scene, its events in time order are frames
embeddings  -> features: ten vectors make a scene
lineitem    -> a factor table with physical, layout and appearance columns
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.common import cut
from ..operators.decorrelation import expand
from ..operators.ordering import positions
from ..operators.splits import scene_split

ALERTS = ("error", "purchase")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Events without the place in the scene; nothing is shuffled."""
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("scene_index"), "ts", "event_id", "event_type", "value",
                    F.get_json_object("props", "$.k").cast("double").alias("k"),
                    F.col("event_type").isin(*ALERTS).cast("int").alias("cls"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    placed = positions(plain_frames(spark, folder), ["ts", "event_id"], ["scene_index"], name="frame_index")
    return placed.drop("frame_index_total")


def scored(rows: DataFrame) -> DataFrame:
    """A regression and a classification readout for each frame, scores with many ties."""
    score = F.floor(F.col("k") / 10) + 2 * F.col("cls") - 5
    return rows.withColumn("y_pred", 0.8 * F.col("value") + 0.3 * F.col("k")) \
        .withColumn("score", score.cast("double")).withColumn("guess", (score > 0).cast("int")) \
        .withColumn("cell", F.pmod(F.col("scene_index"), F.lit(5)).cast("int"))


# encoder, layer, weight of the truth, weight of the noise, lift of an alert's score
READOUTS = (("strong", 8, 0.8, 0.3, 2), ("strong", 11, 0.9, 0.2, 3), ("weak", 0, 0.1, 0.3, 0))


def readouts(task: str = "real", condition: str = "base", encoders=None):
    """Structs of one prediction row per readout and target, of all encoders or those named."""
    cells = []
    for encoder, layer, w, noise, lift in READOUTS:
        if encoders is not None and encoder not in encoders:
            continue
        head = [F.lit(encoder).alias("encoder"), F.lit("base").alias("train_condition"), F.lit(layer).alias("layer"),
                F.lit("mean").alias("view"), F.lit(task).alias("task"), F.lit(condition).alias("eval_condition")]
        value = w * F.col("value") + noise * F.col("k") + (1 - w) * 50
        score = (F.floor(F.col("k") / 10) + lift * F.col("cls") - 5).cast("double")
        cells.append(F.struct(*head, F.lit("value").alias("target"), F.col("value").alias("y_true"), value.alias("y_pred"),
                              F.lit(None).cast("double").alias("y_score")))
        cells.append(F.struct(*head, F.lit("alert").alias("target"), F.col("cls").cast("double").alias("y_true"),
                              (score > 0).cast("double").alias("y_pred"), score.alias("y_score")))
    return F.explode(F.array(*cells))


CLASSES = ("alert",)
SEEDS = (0, 1)


def predictions(spark: SparkSession, folder: str, seeds=SEEDS, encoders=None) -> DataFrame:
    """Held-out predictions of every readout: the scenes a seed does not train on."""
    rows = cut(frames(spark, folder))
    parts = []
    for s in seeds:
        held = scene_split(rows, "scene_index", s).where("not is_train").select("scene_index")
        parts.append(rows.join(held, "scene_index").withColumn("seed", F.lit(s)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit("D").alias("exp"), "seed", "scene_index", "frame_index", readouts(encoders=encoders).alias("r")) \
        .select("exp", "seed", "scene_index", "frame_index", "r.*")


HALF_MONTH = "2024-01-16"


def whole_halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Frames before and from mid-month, numbered apart."""
    rows = plain_frames(spark, folder)
    early = F.col("ts") < F.lit(HALF_MONTH).cast("timestamp_ntz")
    place = lambda r: cut(positions(r, ["ts", "event_id"], ["scene_index"], name="frame_index").drop("frame_index_total"))
    return place(rows.where(early)), place(rows.where(~early))


def halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The same, cut to the common frames.

    Both halves number a scene's frames from 0 without gaps, so the common ones are
    those up to the other half's last: one row per scene meets the frames.
    """
    a, b = whole_halves(spark, folder)

    def common(rows: DataFrame, other: DataFrame) -> DataFrame:
        last = other.groupBy("scene_index").agg(F.max("frame_index").alias("__last"))
        return rows.join(last, "scene_index").where(F.col("frame_index") <= F.col("__last")).drop("__last")

    return common(a, b), common(b, a)


def transfer_predictions(spark: SparkSession, folder: str, encoders=None) -> DataFrame:
    """Readouts on both halves as base and treated evaluations of one task."""
    base, other = halves(spark, folder)
    cols = ["scene_index", "frame_index"]
    b = base.select(*cols, F.lit(None).cast("double").alias("occlusion_fraction"), readouts("transfer", "base", encoders).alias("r"))
    o = other.select(*cols, (F.col("k") / 100).alias("occlusion_fraction"), readouts("transfer", "occluded", encoders).alias("r"))
    return b.unionByName(o).select(F.lit("E").alias("exp"), F.lit(0).alias("seed"), *cols, "occlusion_fraction", "r.*")


def features(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return v.select(F.floor(F.col("vec_id") / 10).alias("scene_index"), (F.col("vec_id") % 10).alias("frame_index"),
                    F.col("embedding").cast("array<double>").alias("x"), "label", (F.col("label") >= 5).cast("int").alias("cls"))


def factor_rows(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.select("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"),
                     "l_extendedprice", "l_returnflag", ((F.dayofyear("l_shipdate") + F.lit(0.3)) / F.lit(367.0)).alias("l_dayhue"))


FACTOR_COLUMNS = lambda: [
    *expand("l_quantity", "physical"), *expand("l_discount", "physical"),
    *expand("l_tax", "layout"), *expand("l_linenumber", "layout"),
    *expand("l_extendedprice", "appearance"), *expand("l_returnflag", "appearance", "categorical", ("A", "N", "R")),
    *expand("l_dayhue", "appearance", circular=True)]
