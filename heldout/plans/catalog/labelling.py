"""From step tables to labelled frames."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import labels as L, moments as Mo
from ...operators.common import cut
from ...operators.sampling import sample_factors
from .. import views as V
from .registry import FEATURES, FRAMES, PLAIN, cells, query, u

R6 = lambda c: F.round(F.col(c), 6).alias(c)
DT = 0.01

TRACE = FRAMES + """,
raw AS (SELECT scene_index, frame_index AS step, cls AS flag, value / 1000 AS speed, event_id, value, k FROM frames),
trace AS (SELECT *, min(flag) OVER (PARTITION BY scene_index ORDER BY step ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS clean FROM raw)"""


def trace(spark, d):
    """Frames of a user as the steps of an episode, contact flag cleaned."""
    f = V.frames(spark, d).select("scene_index", F.col("frame_index").alias("step"), F.col("cls").alias("flag"),
                                  (F.col("value") / 1000).alias("speed"), "event_id", "value", "k")
    return L.debounce(f, "scene_index", "step", "flag", name="clean")


@query("debounce", f"WITH {TRACE} SELECT scene_index, step, clean FROM trace")
def debounce(spark, d):
    return trace(spark, d).select("scene_index", "step", "clean")


@query("debounce_reach", f"""WITH {TRACE} SELECT scene_index, step, min(flag) OVER (PARTITION BY scene_index ORDER BY step ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 1 AS clean FROM raw""")
def debounce_reach(spark, d):
    """A window that spans several chunks."""
    f = V.frames(spark, d).select("scene_index", F.col("frame_index").alias("step"), F.col("cls").alias("flag"))
    return L.debounce(f, "scene_index", "step", "flag", 11, "clean", chunk=2).select("scene_index", "step", "clean")


@query("debounce_wide", f"""WITH {TRACE} SELECT scene_index, step, min(flag) OVER (PARTITION BY scene_index ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS clean FROM raw""")
def debounce_wide(spark, d):
    f = V.frames(spark, d).select("scene_index", F.col("frame_index").alias("step"), F.col("cls").alias("flag"))
    return L.debounce(f, "scene_index", "step", "flag", 5, "clean", chunk=16).select("scene_index", "step", "clean")


WANTED = TRACE + """,
f0 AS (SELECT scene_index, max(step) + 1 AS n, min(step) FILTER (clean) AS first, max(step) FILTER (clean) AS last, count(*) FILTER (clean) AS m FROM trace GROUP BY 1 HAVING count(*) FILTER (clean) > 0),
act AS (SELECT scene_index, step, row_number() OVER (PARTITION BY scene_index ORDER BY step) - 1 AS r FROM trace WHERE clean),
f1 AS (SELECT f0.*, least(2, n - 1) AS i0, least(last + 5, n - 1) AS i7, a.step AS i4, b.step AS i5 FROM f0 JOIN act a ON a.scene_index = f0.scene_index AND a.r = m // 3 JOIN act b ON b.scene_index = f0.scene_index AND b.r = 2 * m // 3),
f2 AS (SELECT f1.*, least(coalesce((SELECT min(t.step) FROM trace t WHERE t.scene_index = f1.scene_index AND t.step >= f1.i7 AND t.speed < 0.01), n - 1), n - 1) AS settle FROM f1),
wanted AS (SELECT scene_index, n AS n_steps, unnest(range(10)) AS slot, unnest([i0, i0 + least(9, greatest(CAST(trunc(0.5 * (first - i0)) AS BIGINT), 1)), i0 + CAST(trunc(0.75 * (first - i0)) AS BIGINT), first, i4, i5, last, i7, (i7 + settle) // 2, n - 1]) AS wanted FROM f2)"""


@query("frame_select", f"WITH {WANTED} SELECT scene_index, CAST(slot AS INT) AS slot, CAST(wanted AS BIGINT) AS wanted, CAST(n_steps AS BIGINT) AS n_steps FROM wanted")
def frame_select(spark, d):
    return L.capture_steps(cut(trace(spark, d)), "scene_index", "step", "clean", "speed", DT).select("scene_index", "slot", "wanted", "n_steps")


REPAIRED = WANTED + """,
fw AS (SELECT *, slot + max(greatest(0, least(wanted, n_steps - 1)) - slot) OVER (PARTITION BY scene_index ORDER BY slot) AS f FROM wanted),
cp AS (SELECT * EXCLUDE (f), CASE WHEN slot = 9 THEN least(f, n_steps - 1) ELSE f END AS f FROM fw),
rp AS (SELECT *, slot + min(f - slot) OVER (PARTITION BY scene_index ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step_index FROM cp),
repaired AS (SELECT *, min(step_index) OVER (PARTITION BY scene_index) >= 0 AS ok FROM rp)"""


def _steps(spark, d, t):
    return L.strictly_increasing(L.capture_steps(t, "scene_index", "step", "clean", "speed", DT), ["scene_index"])


@query("monotone_repair", f"WITH {REPAIRED} SELECT scene_index, CAST(slot AS INT) AS slot, CAST(step_index AS BIGINT) AS step_index, ok FROM repaired")
def monotone_repair(spark, d):
    return _steps(spark, d, cut(trace(spark, d))).select("scene_index", "slot", "step_index", "ok")


PHASE_SQL = "[" + ", ".join(f"'{p}'" for p in L.PHASES) + "][CAST(slot AS INT) + 1]"


@query("frame_targets", f"""WITH {REPAIRED} SELECT r.scene_index, CAST(r.slot AS INT) AS frame_index, CAST(step_index AS BIGINT) AS step_index, {PHASE_SQL} AS phase, t.event_id,
CAST(round(step_index * 0.01, 6) AS DOUBLE) AS time, round(ln(1 + r.scene_index % 7), 6) AS log_mass FROM repaired r JOIN trace t ON t.scene_index = r.scene_index AND t.step = r.step_index WHERE ok""")
def frame_targets(spark, d):
    t = cut(trace(spark, d))
    factors = t.select("scene_index").distinct().withColumn("mass", (1 + F.col("scene_index") % 7).cast("double"))
    out = L.frame_targets(t, _steps(spark, d, t), factors, "scene_index", "step", DT)
    return out.select("scene_index", "frame_index", "step_index", "phase", "event_id", R6("time"), R6("log_mass"))


@query("phase_join", f"WITH {FRAMES}, x AS (SELECT frame_index % 10 AS slot FROM frames) SELECT {PHASE_SQL} AS phase, count(*) AS n FROM x GROUP BY 1")
def phase_join(spark, d):
    return V.frames(spark, d).groupBy(L.phase(F.col("frame_index") % 10).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@query("dropped_scenes", f"""WITH {TRACE}, s AS (SELECT scene_index, bool_or(speed > 0.3) AS kept FROM trace GROUP BY 1)
SELECT count(*) AS n_scenes, count(*) FILTER (NOT kept) AS n_dropped, count(*) FILTER (NOT kept) <= 0.02 * count(*) AS passed FROM s""")
def dropped_scenes(spark, d):
    f = V.plain_frames(spark, d)
    return L.dropped_share(f, f.where("value / 1000 > 0.3"), "scene_index")


@query("contact_flags", """WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
h AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE ((l_suppkey % 5 = 1 AND l_partkey % 5 IN (2, 3)) OR (l_partkey % 5 = 1 AND l_suppkey % 5 IN (2, 3)))
 AND sqrt((l_discount / 100) ** 2 + (l_tax / 100) ** 2 + (l_quantity / 100000) ** 2) > 1e-3)
SELECT s.l_orderkey AS scene_index, s.l_linenumber AS step, h.l_orderkey IS NOT NULL AS flag FROM s LEFT JOIN h USING (l_orderkey, l_linenumber)""")
def contact_flags(spark, d):
    li = V.table(spark, d, "lineitem")
    contacts = li.select(F.col("l_orderkey").alias("scene_index"), F.col("l_linenumber").alias("step"), (F.col("l_suppkey") % 5).alias("geom1"),
                         (F.col("l_partkey") % 5).alias("geom2"), (F.col("l_discount") / 100).alias("fx"), (F.col("l_tax") / 100).alias("fy"),
                         (F.col("l_quantity") / 100000).alias("fz"))
    steps = contacts.select("scene_index", "step").distinct()
    return L.touch_flags(steps, contacts, ["scene_index", "step"], 1, [2, 3]).select("scene_index", "step", "flag")


@query("vector_norms", f"""WITH {FRAMES} SELECT event_id, round(sqrt((value / 100) ** 2 + (k / 50) ** 2 + 1), 6) AS speed, round(sqrt((value / 100 - k / 50) ** 2 + 1), 6) AS distance FROM frames""")
def vector_norms(spark, d):
    f = V.plain_frames(spark, d)
    a, b = F.col("value") / 100, F.col("k") / 50
    return f.select("event_id", F.round(L.norm(a, b, F.lit(1.0)), 6).alias("speed"), F.round(L.norm(a - b, F.lit(1.0)), 6).alias("distance"))


@query("projection", f"""WITH {PLAIN}, g AS (SELECT event_id, value / 100 - (scene_index % 7 - 3) AS dx, k / 50 + 2 AS dy, 1 - 1.5 AS dz, cos(scene_index * 0.02) AS c, sin(scene_index * 0.02) AS s, 45 + scene_index % 10 AS fovy FROM plain),
r AS (SELECT event_id, c * dx + s * dy AS x, dz AS y, -(s * dx - c * dy) AS depth, 112 / tan(radians(fovy) / 2) AS f FROM g),
q AS (SELECT event_id, depth, CASE WHEN depth > 1e-6 THEN 112 + f * x / depth ELSE 'nan'::DOUBLE END AS u, CASE WHEN depth > 1e-6 THEN 112 - f * y / depth ELSE 'nan'::DOUBLE END AS v FROM r)
SELECT event_id, round(u, 4) AS u, round(v, 4) AS v, round(depth, 6) AS depth, depth > 1e-6 AND u >= 0 AND u < 224 AND v >= 0 AND v < 224 AS in_frame FROM q""")
def projection(spark, d):
    f = V.plain_frames(spark, d)
    a = F.col("scene_index") * F.lit(0.02)
    c, s, zero, one = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    out = L.project([F.col("value") / 100, F.col("k") / 50, one], [(F.col("scene_index") % 7 - 3).cast("double"), F.lit(-2.0), F.lit(1.5)],
                    [c, zero, s, s, zero, -c, zero, one, zero], (45 + F.col("scene_index") % 10).cast("double"), F.lit(224.0), F.lit(224.0))
    return f.select("event_id", F.round(out["u"], 4).alias("u"), F.round(out["v"], 4).alias("v"), F.round(out["depth"], 6).alias("depth"), out["in_frame"].alias("in_frame"))


@query("weighted_hidden", """WITH p AS (SELECT l_orderkey, (l_quantity - 20) / 50 AS c, 1 + l_extendedprice / 100000 AS d, l_discount, l_returnflag FROM lineitem),
w AS (SELECT l_orderkey, CASE WHEN c > 0 THEN c / (d * d) ELSE 0 END AS w, CASE WHEN l_returnflag = 'A' THEN -1 ELSE d * (0.95 + l_discount) END AS hit, d FROM p)
SELECT l_orderkey AS scene_index, round(coalesce(sum(CASE WHEN hit >= 0 AND hit < d - 1e-4 THEN w ELSE 0 END) / nullif(sum(w), 0), 0), 6) AS occlusion_fraction FROM w GROUP BY 1""")
def weighted_hidden(spark, d):
    li = V.table(spark, d, "lineitem")
    far = 1 + F.col("l_extendedprice") / 100000
    s = li.select(F.col("l_orderkey").alias("scene_index"), ((F.col("l_quantity") - 20) / 50).alias("cosine"), far.alias("distance"),
                  F.when(F.col("l_returnflag") == "A", F.lit(-1.0)).otherwise(far * (0.95 + F.col("l_discount"))).alias("hit"))
    return L.hidden_share(s, ["scene_index"]).select("scene_index", R6("occlusion_fraction"))


@query("visible_ratio", """WITH n AS (SELECT l_orderkey AS scene_index, count(*) FILTER (l_suppkey % 3 = 1) AS visible, count(*) FILTER (l_partkey % 3 = 1) AS silhouette FROM lineitem GROUP BY 1)
SELECT scene_index, visible, silhouette, round(CASE WHEN silhouette = 0 THEN 0 ELSE greatest(0, least(1, 1 - visible / silhouette)) END, 6) AS occlusion_fraction FROM n""")
def visible_ratio(spark, d):
    px = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene_index"), (F.col("l_suppkey") % 3).alias("full_id"), (F.col("l_partkey") % 3).alias("solo_id"))
    return L.covered_share(px, ["scene_index"], F.lit(1)).select("scene_index", "visible", "silhouette", R6("occlusion_fraction"))


@query("estimator_agreement", f"""WITH {PLAIN}, p AS (SELECT value AS a, 0.8 * value + 0.3 * k AS b FROM plain)
SELECT count(*) AS n_measurements, round(corr(a, b), 6) AS pearson_r, round(avg(abs(a - b)), 6) AS mean_abs_difference, round(max(abs(a - b)), 6) AS max_abs_difference,
round(avg(a), 6) AS a_mean, round(min(a), 6) AS a_min, round(max(a), 6) AS a_max, round(avg(b), 6) AS b_mean, round(min(b), 6) AS b_min, round(max(b), 6) AS b_max, corr(a, b) > 0.95 AS passed FROM p""")
def estimator_agreement(spark, d):
    p = V.plain_frames(spark, d).select(F.col("value").alias("a"), (0.8 * F.col("value") + 0.3 * F.col("k")).alias("b"))
    out = L.agreement(p, "a", "b")
    return out.select("n_measurements", *[R6(c) for c in out.columns if c not in ("n_measurements", "passed")], "passed")


@query("agreement_constant", f"""WITH {PLAIN} SELECT count(*) AS n_measurements, CASE WHEN count(DISTINCT 5.0) = 1 THEN 'nan'::DOUBLE ELSE corr(value, 5.0) END AS pearson_r, false AS passed FROM plain""")
def agreement_constant(spark, d):
    """An estimator that never changes: no correlation, not passed."""
    p = V.plain_frames(spark, d).select(F.col("value").alias("a"), F.lit(5.0).alias("b"))
    return L.agreement(p, "a", "b").select("n_measurements", "pearson_r", "passed")


@query("block_means", """WITH px AS (SELECT vec_id, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i)),
g AS (SELECT vec_id, (i // 8) // 2 * 4 + (i % 8) // 2 AS block, (0.299 * (v + 1) * 100 + 0.587 * (v * 50 + 100) + 0.114 * 100) / 255 AS grey FROM px)
SELECT vec_id, CAST(block AS INT) AS block, round(avg(grey), 6) AS grey FROM g GROUP BY 1, 2""")
def block_means(spark, d):
    px = V.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).withColumn("e", F.col("e").cast("double"))
    px = px.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), ((F.col("e") + 1) * 100).alias("r"),
                   (F.col("e") * 50 + 100).alias("g"), F.lit(100.0).alias("b"))
    out = L.block_means(px, ["vec_id"], 8, 8, 4)
    return out.select("vec_id", F.posexplode("x").alias("block", "grey")).select("vec_id", "block", R6("grey"))


@query("token_mean", """WITH px AS (SELECT vec_id // 5 AS frame, CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i))
SELECT frame, i, round(avg(v), 6) AS v FROM px GROUP BY 1, 2""")
def token_mean(spark, d):
    t = V.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("frame"), F.col("embedding").cast("array<double>").alias("x"))
    return Mo.mean_vector(t, "x", ["frame"]).select("frame", F.posexplode("x").alias("i", "v")).select("frame", "i", (F.round("v", 6) + 0.0).alias("v"))


@query("clip_resample", f"""WITH {FRAMES}, n AS (SELECT scene_index, count(*) AS t FROM frames GROUP BY 1),
s AS (SELECT scene_index, CAST(slot AS INT) AS slot, CAST(least(round_even(slot * ((t - 1) / 15.0::DOUBLE), 0), t - 1) AS BIGINT) AS frame_index FROM n, range(16) r(slot))
SELECT s.scene_index, slot, s.frame_index, event_id FROM s JOIN frames f USING (scene_index, frame_index)""")
def clip_resample(spark, d):
    return L.resample_clip(cut(V.frames(spark, d)), "scene_index", "frame_index", 16).select("scene_index", "slot", "frame_index", "event_id")


@query("scene_quality", f"""WITH {FRAMES} SELECT scene_index, CAST(sum(cls) AS BIGINT) AS n_contact_frames, count(*) FILTER (k < 50) AS n_airborne_frames, bool_and(value < 200) AS all_frames_in_frame,
round(avg(k / 100), 6) AS mean_occlusion, bool_or(value > 400) AS distractor_touched, round(max(greatest(value / 100, k / 100)), 6) AS max_obj_radius,
round(arg_max(sqrt((value / 100) ** 2 + (k / 100) ** 2), frame_index), 6) AS final_obj_radius, arg_max(value, frame_index) / 1000 < 0.01 AS settled_by_end,
max(frame_index) + 1 AS n_steps, CAST(round((max(frame_index) + 1) * 0.01, 6) AS DOUBLE) AS episode_seconds FROM frames GROUP BY 1""")
def scene_quality(spark, d):
    f = cut(V.frames(spark, d))
    frames = f.select("scene_index", F.col("cls").alias("contact_state"), (F.col("k") >= 50).cast("int").alias("support_state"),
                      (F.col("value") < 200).alias("obj_in_frame"), (F.col("k") / 100).alias("occlusion_fraction"))
    steps = f.select("scene_index", F.col("frame_index").alias("step"), (F.col("value") > 400).alias("distractor_hit"),
                     (F.col("value") / 100).alias("obj_x"), (F.col("k") / 100).alias("obj_y"), (F.col("value") / 1000).alias("speed"))
    q = L.scene_quality(frames, steps, "scene_index", DT)
    return q.select("scene_index", "n_contact_frames", "n_airborne_frames", "all_frames_in_frame", R6("mean_occlusion"), "distractor_touched",
                    R6("max_obj_radius"), R6("final_obj_radius"), "settled_by_end", "n_steps", R6("episode_seconds"))


@query("random_features", f"""WITH {FEATURES}, w AS (SELECT a, b, sqrt(-2 * ln(1 - {u('7', 'a', 'b', '0')})) * cos(2 * pi() * {u('7', 'a', 'b', '1')}) / 8 AS w FROM range(64) r(a), range(16) q(b)),
{cells(64)} SELECT scene_index, frame_index, CAST(b AS INT) AS i, round(tanh(sum(v * w)), 6) AS v FROM cells JOIN w ON w.a = cells.i GROUP BY scene_index, frame_index, b""")
def random_features(spark, d):
    out = L.random_features(V.features(spark, d), "x", 16, 7, "z")
    return out.select("scene_index", "frame_index", F.posexplode("z").alias("i", "v")).withColumn("v", F.round("v", 6) + 0.0)
