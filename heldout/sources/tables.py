"""Reading and writing the pipeline's tables."""
from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def targets(spark: SparkSession, path: str, condition: str, scenes: DataFrame | None = None) -> DataFrame:
    """Frame labels of one condition, all scenes or those of a list; the phase text stays behind."""
    rows = spark.read.parquet(path).where(F.col("condition") == condition)
    rows = rows.drop("phase") if "phase" in rows.columns else rows
    return rows if scenes is None else rows.join(scenes.select("scene_index").distinct(), "scene_index", "left_semi")


def features(spark: SparkSession, path: str, encoder: str, condition: str, layer: int, view: str) -> DataFrame:
    """One cell of the feature table, pruned by partition; absence is an error."""
    rows = _read(spark, path).where(
        (F.col("encoder") == encoder) & (F.col("condition") == condition) & (F.col("layer") == layer) & (F.col("view") == view))
    if rows.isEmpty():
        raise FileNotFoundError(f"no features for {encoder}, {condition}, layer {layer}, view {view} under {path}")
    return rows.select("scene_index", "frame_index", "x")


def patches(spark: SparkSession, path: str, encoder: str, condition: str, layer: int) -> DataFrame:
    rows = _read(spark, path).where(
        (F.col("encoder") == encoder) & (F.col("condition") == condition) & (F.col("layer") == layer))
    if rows.isEmpty():
        raise FileNotFoundError(f"no patch tokens for {encoder}, {condition}, layer {layer} under {path}")
    return rows.select("scene_index", "frame_index", "patch_index", "x")


def write_features(rows: DataFrame, path: str) -> None:
    _overwrite(rows, path, ["encoder", "condition", "layer", "view"])


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; FileNotFoundError if there is nothing at the path."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(path) from error
        raise


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return _read(spark, path)
    except FileNotFoundError:
        return None


RUN, UNIT = "__run", ["exp", "seed"]


def predictions(spark: SparkSession, path: str, exp: str, seeds: list[int] | None = None) -> DataFrame:
    """The rows of an experiment's newest finished write of each (exp, seed)."""
    live = newest(spark, path).where(F.col("exp") == exp)
    runs = live.select(*UNIT, RUN)
    rows = _read(spark, f"{path}/rows").where(F.col("exp") == exp).join(runs, [*UNIT, RUN], "left_semi").drop(RUN)
    return rows if seeds is None else rows.where(F.col("seed").isin(*seeds))


def newest(spark: SparkSession, path: str) -> DataFrame:
    """(exp, seed, __run, version): which write of each unit counts."""
    return _read(spark, f"{path}/commits").groupBy(*UNIT).agg(F.max_by(F.struct(RUN, "version"), F.struct("version", RUN)).alias("__c")).select(*UNIT, "__c.*")


def write_predictions(rows: DataFrame, path: str, units: list[tuple] | None = None) -> None:
    """Replaces (exp, seed) units by the rows, all at once: those that the rows hold, and those of ``units`` even if they have none.

    Rows go to files of this write alone; then one small commit file names the write for
    each unit, and appears as a whole. Readers see the old rows or the new ones, and a
    write that dies half-way is never seen. Rows of replaced writes stay on disk.
    """
    spark, run = rows.sparkSession, f"w{uuid.uuid4().hex}"
    rows.withColumn(RUN, F.lit(run)).write.mode("append").partitionBy(RUN, *UNIT).parquet(f"{path}/rows")
    told = _read(spark, f"{path}/rows").where(F.col(RUN) == run).select(*UNIT).distinct()
    if units:
        told = told.unionByName(spark.createDataFrame(units, told.schema)).distinct()
    earlier = read_if_there(spark, f"{path}/commits")
    version = 0 if earlier is None else (earlier.agg(F.max("version")).first()[0] or 0)
    told.withColumn(RUN, F.lit(run)).withColumn("version", F.lit(version + 1).cast("long")).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _overwrite(rows: DataFrame, path: str, parts: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


SCENE_SCHEMA = """scene_id string, scene_index long, condition string, master_seed long, factors map<string,string>,
 quality struct<contact_detected: boolean, n_contact_frames: long, n_airborne_frames: long, distractor_touched: boolean,
 all_frames_in_frame: boolean, settled_by_end: boolean, max_obj_radius: double, final_obj_radius: double,
 mean_occlusion: double, n_steps: long, episode_seconds: double>, occlusion_method string, unreadable string"""


def scene_records(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Scene quality records; a corrupt one keeps its text in ``unreadable`` and the scan goes on."""
    return spark.read.schema(SCENE_SCHEMA).option("mode", "PERMISSIVE").option("multiLine", whole_files) \
        .option("columnNameOfCorruptRecord", "unreadable").json(path)


def complete_scenes(labels: DataFrame, frames: DataFrame, scene: str = "scene_index") -> DataFrame:
    """Scenes that have both labels and frames."""
    return labels.select(scene).distinct().join(frames.select(scene), scene, "left_semi")


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One fixed header for all rows; nulls become empty cells."""
    out = rows.select(*columns) if columns else rows
    out.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def pair_lines(pairs: DataFrame) -> DataFrame:
    """The pair table as it is written: rho to 6 places, p to 6 significant digits, 0/1 flags."""
    digits = F.format_string("%.5e", F.col("p_holm"))
    e = F.regexp_extract(digits, "e([+-][0-9]+)$", 1).cast("int")
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    mantissa = trim(F.regexp_extract(digits, "^(.*)e", 1))
    shown = F.when(F.col("p_holm") == 0, F.lit("0")).when(e < -4, F.concat(mantissa, F.lit("e-"), F.lpad(F.abs(e).cast("string"), 2, "0"))) \
        .otherwise(trim(F.format_string("%.10f", digits.cast("double"))))
    return pairs.select("a", "b", "group_a", "group_b", F.format_string("%.6f", F.col("rho")).alias("rho"), shown.alias("p_holm"),
                        F.col("considered").cast("int").alias("considered"))


def json_rows(rows: DataFrame) -> DataFrame:
    """Each row as a JSON object with its keys in order."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    json_rows(rows).write.mode("overwrite").text(path)


def config_hash(config: dict, length: int = 12) -> str:
    """Short digest of a job's configuration; equal configs in any key order agree."""
    def plain(v):
        if isinstance(v, np.generic):
            return v.item()
        if isinstance(v, np.ndarray):
            return v.tolist()
        raise TypeError(f"not a plain value: {type(v).__name__}")
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), default=plain)
    return hashlib.sha256(text.encode()).hexdigest()[:length]


def row_hash(*columns: str, length: int = 12):
    """The same kind of digest for a configuration held in a row."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, length)
