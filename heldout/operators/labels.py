"""From a trace of steps to labelled frames.

A scene may hold any share of the steps, so nothing here sends one scene to one
task: windows are cut into chunks of steps with a small overlap, and per-scene
choices come from aggregates.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keyed import normal_draw
from .common import correlation, cut, finite
from .moments import matrix_of
from .ordering import positions

# The ten capture slots of an episode.
PHASES = ("rest_pre_approach", "approach", "approach", "first_contact", "sustained_contact",
          "sustained_contact", "last_contact", "post_contact_moving", "decelerating", "episode_end")
REST_SECONDS, EARLY_SECONDS, AFTER_SECONDS = 0.02, 0.09, 0.05
SETTLED_SPEED = 0.01
FORCE_THRESHOLD = 1e-3
MAX_DROPPED = 0.02
CHUNK = 4096                         # steps per window partition


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def touch_flags(steps: DataFrame, contacts: DataFrame, keys: list[str], one: int, others: list[int],
                threshold: float = FORCE_THRESHOLD, name: str = "flag") -> DataFrame:
    """True at steps where ``one`` bears force against any of ``others``, in either order."""
    a, b = F.col("geom1"), F.col("geom2")
    pair = ((a == one) & b.isin(others)) | ((b == one) & a.isin(others))
    hits = contacts.where(pair & (norm(F.col("fx"), F.col("fy"), F.col("fz")) > threshold)).select(*keys).distinct()
    return steps.join(hits.withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def chunked(df: DataFrame, step: str, reach: int, chunk: int = CHUNK) -> DataFrame:
    """Copies rows into every chunk that they reach; ``home`` marks the original."""
    at = F.col(step).cast("long")
    home = F.floor(at / chunk)
    spots = F.sequence(F.floor((at - reach) / chunk), F.floor((at + reach) / chunk))
    return df.select("*", home.alias("__home"), F.explode(spots).alias("__chunk")) \
        .withColumn("home", F.col("__home") == F.col("__chunk")).drop("__home")


def debounce(trace: DataFrame, scene: str, step: str, flag: str, width: int = 3, name: str = "flag_clean",
             chunk: int = CHUNK) -> DataFrame:
    """True where a centred window of ``width`` steps is true throughout.

    A window cut short at an end equals repeating the end value.
    """
    if width % 2 == 0 or width < 1:
        raise ValueError("width must be odd")
    reach = width // 2
    w = Window.partitionBy(scene, "__chunk").orderBy(F.col(step).cast("long")).rangeBetween(-reach, reach)
    out = chunked(trace, step, reach, chunk).withColumn(name, F.min(F.col(flag).cast("boolean")).over(w))
    return out.where("home").drop("home", "__chunk")


def capture_steps(trace: DataFrame, scene: str, step: str, flag: str, speed: str, dt: float) -> DataFrame:
    """Ten wanted steps per scene with contact: (scene, slot, wanted, n_steps).

    Steps are numbered from 0.  The scene table is joined back once, to find when
    motion stops.
    """
    on = F.col(flag).cast("boolean")
    at = F.col(step).cast("long")
    facts = trace.groupBy(scene).agg(
        (F.max(at) + 1).alias("n_steps"), F.min(F.when(on, at)).alias("__first"),
        F.max(F.when(on, at)).alias("__last"), F.sum(on.cast("long")).alias("__m")).where("__m > 0")
    ranked = positions(trace.where(on).select(scene, at.alias(step)), [step], [scene], name="__k")
    m = F.col("__k_total")
    thirds = ranked.groupBy(scene).agg(
        F.max(F.when(F.col("__k") == F.floor(m / 3), F.col(step))).alias("__third"),
        F.max(F.when(F.col("__k") == F.floor(2 * m / 3), F.col(step))).alias("__two_thirds"))
    final = F.col("n_steps") - 1
    rest = F.least(F.lit(round(REST_SECONDS / dt)), final)
    span = F.col("__first") - rest
    after = F.least(F.col("__last") + round(AFTER_SECONDS / dt), final)
    facts = cut(facts.join(thirds, scene).withColumn("__after", after))
    still = trace.select(scene, at.alias(step), speed).where(F.col(speed) < SETTLED_SPEED) \
        .join(facts.select(scene, "__after"), scene).where(F.col(step) >= F.col("__after")) \
        .groupBy(scene).agg(F.min(step).alias("__still"))
    facts = facts.join(still, scene, "left")
    settle = F.least(F.coalesce(F.col("__still"), final), final)
    slots = [rest,
             rest + F.least(F.lit(round(EARLY_SECONDS / dt)), F.greatest((span * F.lit(0.5)).cast("long"), F.lit(1))),
             rest + (span * F.lit(0.75)).cast("long"),
             F.col("__first"), F.col("__third"), F.col("__two_thirds"), F.col("__last"), F.col("__after"),
             F.floor((F.col("__after") + settle) / 2), final]
    return facts.select(scene, "n_steps", F.posexplode(F.array(*[s.cast("long") for s in slots])).alias("slot", "wanted"))


def strictly_increasing(wanted: DataFrame, by: list[str], slot: str = "slot", value: str = "wanted",
                        n: str = "n_steps", name: str = "step_index") -> DataFrame:
    """Nearest strictly increasing steps: pushed forward, then back from the end.

    ``ok`` is false for all slots of an episode too short to hold them.  A window
    holds one scene's slots only.
    """
    w = Window.partitionBy(*by).orderBy(slot)
    last = F.col(n) - 1
    clipped = F.greatest(F.lit(0), F.least(F.col(value), last))
    forward = wanted.withColumn("__f", F.col(slot) + F.max(clipped - F.col(slot)).over(w))
    end = F.lead(slot).over(w).isNull()
    capped = forward.withColumn("__f", F.when(end, F.least(F.col("__f"), last)).otherwise(F.col("__f")))
    back = w.rowsBetween(0, Window.unboundedFollowing)
    out = capped.withColumn(name, F.col(slot) + F.min(F.col("__f") - F.col(slot)).over(back))
    return out.withColumn("ok", F.min(name).over(Window.partitionBy(*by)) >= 0).drop("__f")


def dropped_share(scenes: DataFrame, kept: DataFrame, scene: str, bound: float = MAX_DROPPED) -> DataFrame:
    """n_scenes, n_dropped and whether the share of scenes without frames is tolerable."""
    lost = scenes.select(scene).distinct().join(kept.select(scene).distinct().withColumn("__kept", F.lit(1)), scene, "left")
    return lost.agg(F.count(F.lit(1)).alias("n_scenes"), F.sum(F.col("__kept").isNull().cast("long")).alias("n_dropped")) \
        .withColumn("passed", F.col("n_dropped") <= F.col("n_scenes") * F.lit(bound))


def refuse(check: DataFrame, what: str) -> None:
    """Raises unless the one-row check passed."""
    row = check.first()
    if not row["passed"]:
        raise RuntimeError(f"{what}: {row.asDict()}")


def phase(frame: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHASES]), (frame + 1).cast("int"))


def frame_targets(trace: DataFrame, steps: DataFrame, factors: DataFrame, scene: str, step: str, dt: float) -> DataFrame:
    """Trace rows at the chosen steps, with phase, time and the scene's factors, null where a scene has none."""
    picked = steps.where("ok").select(scene, F.col("slot").alias("frame_index"), "step_index")
    rows = trace.withColumnRenamed(step, "step_index").join(picked, [scene, "step_index"])
    labelled = rows.withColumn("phase", phase(F.col("frame_index"))).withColumn("time", F.col("step_index") * F.lit(dt))
    out = labelled.join(factors, scene, "left")
    return out.withColumn("log_mass", F.log("mass")) if "mass" in factors.columns else out


def scene_quality(frames: DataFrame, trace: DataFrame, scene: str, dt: float) -> DataFrame:
    """Per-scene flags, counts and means of frames and steps."""
    f = frames.groupBy(scene).agg(
        F.sum(F.col("contact_state").cast("long")).alias("n_contact_frames"),
        F.sum((F.col("support_state") == 0).cast("long")).alias("n_airborne_frames"),
        F.bool_and(F.col("obj_in_frame").cast("boolean")).alias("all_frames_in_frame"),
        F.avg("occlusion_fraction").alias("mean_occlusion"))
    t = trace.groupBy(scene).agg(
        F.bool_or(F.col("distractor_hit").cast("boolean")).alias("distractor_touched"),
        F.max(F.greatest(F.abs("obj_x"), F.abs("obj_y"))).alias("max_obj_radius"),
        F.max_by(norm(F.col("obj_x"), F.col("obj_y")), "step").alias("final_obj_radius"),
        (F.max_by("speed", "step") < SETTLED_SPEED).alias("settled_by_end"),
        (F.max("step") + 1).alias("n_steps"))
    return f.join(t, scene).withColumn("contact_detected", F.lit(True)) \
        .withColumn("episode_seconds", F.col("n_steps") * F.lit(dt))


def project(point: list[Column], camera: list[Column], rotation: list[Column], fovy: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixel u, v, depth and in_frame of world points; ``rotation`` is row-major, camera axes in columns.

    Behind the camera there is no pixel: NaN and not in frame.
    """
    rel = [p - c for p, c in zip(point, camera)]
    x, y, z = (sum((rotation[3 * r + c] * rel[r] for r in (1, 2)), rotation[c] * rel[0]) for c in range(3))
    depth = -z
    seen = depth > 1e-6
    focal = (height / 2) / F.tan(F.radians(fovy) / 2)
    nan = F.lit(float("nan"))
    u = F.when(seen, width / 2 + focal * x / depth).otherwise(nan)
    v = F.when(seen, height / 2 - focal * y / depth).otherwise(nan)
    inside = seen & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return {"u": u, "v": v, "depth": depth, "in_frame": inside}


def hidden_share(samples: DataFrame, keys: list[str], name: str = "occlusion_fraction") -> DataFrame:
    """Weighted share of camera-facing samples whose ray stops short; 0 if none faces.

    Columns: ``cosine``, ``distance``, ``hit`` (negative when the ray hits nothing).
    A sample weighs what it covers in the image: cosine over squared distance.
    """
    faces = F.col("cosine") > 0
    w = F.when(faces, F.col("cosine") / (F.col("distance") * F.col("distance"))).otherwise(F.lit(0.0))
    hidden = (F.col("hit") >= 0) & (F.col("hit") < F.col("distance") - 1e-4)
    sums = samples.groupBy(*keys).agg(F.sum(F.when(hidden, w).otherwise(F.lit(0.0))).alias("__h"), F.sum(w).alias("__w"))
    return sums.select(*keys, F.when(F.col("__w") > 0, F.col("__h") / F.col("__w")).otherwise(F.lit(0.0)).alias(name))


def covered_share(pixels: DataFrame, keys: list[str], target: Column, name: str = "occlusion_fraction") -> DataFrame:
    """1 - visible / silhouette from two id masks per pixel; 0 where there is no silhouette."""
    n = pixels.groupBy(*keys).agg(F.sum((F.col("full_id") == target).cast("long")).alias("visible"),
                                  F.sum((F.col("solo_id") == target).cast("long")).alias("silhouette"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("visible") / F.col("silhouette")))
    return n.withColumn(name, F.when(F.col("silhouette") > 0, share).otherwise(F.lit(0.0)))


def agreement(pairs: DataFrame, a: str, b: str, threshold: float = 0.95) -> DataFrame:
    """Correlation, differences, means and ranges of two estimators in one row."""
    gap = F.abs(F.col(a) - F.col(b))
    row = pairs.agg(F.count(F.lit(1)).alias("n_measurements"), F.coalesce(correlation(a, b), F.lit(float("nan"))).alias("pearson_r"),
                    F.avg(gap).alias("mean_abs_difference"), F.max(gap).alias("max_abs_difference"),
                    *[f(c).alias(f"{c}_{n}") for c in (a, b) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    return row.withColumn("passed", F.coalesce(finite(F.col("pearson_r")) > threshold, F.lit(False)))


def block_means(pixels: DataFrame, keys: list[str], height: int, width: int, side: int = 32) -> DataFrame:
    """Grey level of a side-by-side grid as a vector.  Pixels: (keys..., y, x, r, g, b).

    A clip's frames share the keys and average into one grid.  Luma weights are fixed values.
    """
    if height % side or width % side:
        raise ValueError(f"{height}x{width} does not divide into {side}x{side} blocks")
    luma = (F.lit(0.299) * F.col("r") + F.lit(0.587) * F.col("g") + F.lit(0.114) * F.col("b")) / F.lit(255.0)
    block = F.floor(F.col("y") / (height // side)) * side + F.floor(F.col("x") / (width // side))
    cells = pixels.groupBy(*keys, block.cast("int").alias("__block")).agg(F.avg(luma).alias("__v"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__block", "__v"))),
                                                lambda s: s["__v"]).alias("x"))


def resample_clip(frames: DataFrame, scene: str, frame: str, n: int) -> DataFrame:
    """n clip slots per scene filled by the nearest frame, halves to even; frames repeat."""
    lengths = frames.groupBy(scene).agg(F.count(F.lit(1)).alias("__t"))
    spot = F.bround(F.col("slot") * ((F.col("__t") - 1) / F.lit(float(max(n - 1, 1)))))
    slots = lengths.select(scene, "__t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    wanted = slots.select(scene, "slot", F.least(spot, F.col("__t") - 1).cast("long").alias(frame))
    return wanted.join(frames, [scene, frame])


def random_features(features: DataFrame, x: str, dim: int, seed: int, name: str = "x") -> DataFrame:
    """The untrained baseline: the same rows through fixed random weights, normal draws keyed by (seed, entry, output)."""
    d = int(features.select(F.size(x)).first()[0])
    weights = np.array([[normal_draw(seed, i, j) for j in range(dim)] for i in range(d)]) / math.sqrt(d)

    @F.arrow_udf("array<double>")
    def apply(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.float64()))
        s = np.tanh(matrix_of(v) @ weights)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * dim, pa.int32()), pa.array(s.ravel()))

    return features.withColumn(name, apply(F.col(x).cast("array<double>")))
