"""Cell summaries, comparisons, verdicts and curves over the predictions view."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import summary as S
from ...operators.common import cut
from .. import views as V
from .registry import HALVES, PREDICTIONS, _readout_rows, draws, query

R6 = lambda c: F.round(F.col(c), 6).alias(c)
CELL = "exp, seed, encoder, train_condition, layer, view, task, eval_condition, target"

SCORES = f"""scores AS (SELECT {CELL}, CASE WHEN target = 'alert' THEN 'balanced_accuracy' ELSE 'r2' END AS metric,
 CASE WHEN target = 'alert' THEN (sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1.0 ELSE 0 END) / sum(y_true) + sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1.0 ELSE 0 END) / sum(1 - y_true)) / 2
 ELSE 1 - sum((y_true - y_pred) ** 2) / sum((y_true - m) ** 2) END AS value
 FROM (SELECT *, avg(y_true) OVER (PARTITION BY {CELL}) AS m FROM predictions) GROUP BY {CELL})"""


@query("cell_scores", f"WITH {PREDICTIONS}, {SCORES} SELECT {CELL}, metric, round(value, 6) AS value FROM scores")
def cell_scores(spark, d):
    return S.cell_scores(cut(V.predictions(spark, d)), classes=V.CLASSES).select(*S.CELL, "metric", R6("value"))


@query("best_cell", f"""WITH {PREDICTIONS}, {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY encoder, seed, target ORDER BY value DESC, layer, view) AS rn FROM scores)
SELECT encoder, seed, target, layer, view, round(value, 6) AS value FROM r WHERE rn = 1""")
def best_cell(spark, d):
    scores = S.cell_scores(cut(V.predictions(spark, d)), classes=V.CLASSES)
    return S.best_cells(scores, ["encoder", "seed", "target"]).select("encoder", "seed", "target", "layer", "view", R6("value"))


N, CURVE_N = 2000, 500
TEST_SCENES = "(SELECT DISTINCT seed, scene_index FROM predictions)"
SUMMARY = f"""WITH {PREDICTIONS}, {SCORES}, {draws(TEST_SCENES, N, 'seed', 'seed')},
ps AS (SELECT {CELL}, scene_index, sum((y_true - y_pred) ** 2) AS rss, count(*) AS n, sum(y_true - 50) AS sy, sum((y_true - 50) ** 2) AS syy,
 sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN y_true = 1 THEN 1.0 ELSE 0 END) AS p,
 sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1.0 ELSE 0 END) AS tn, sum(CASE WHEN y_true = 0 THEN 1.0 ELSE 0 END) AS q FROM predictions GROUP BY {CELL}, scene_index),
boot AS (SELECT {', '.join('p.' + c.strip() for c in CELL.split(','))}, d.b, CASE WHEN target = 'alert' THEN (sum(times * tp) / nullif(sum(times * p), 0) + sum(times * tn) / nullif(sum(times * q), 0)) / 2 ELSE 1 - sum(times * rss) / (sum(times * syy) - sum(times * sy) ** 2 / sum(times * n)) END AS s
 FROM ps p JOIN drawn d ON p.seed = d.seed AND p.scene_index = d.scene_index GROUP BY {', '.join('p.' + c.strip() for c in CELL.split(','))}, d.b),
level AS (SELECT {CELL}, scene_index, y_score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM predictions WHERE target = 'alert' GROUP BY ALL),
tie AS (SELECT {', '.join('p.' + c.strip() for c in CELL.split(','))}, CAST(d.b AS BIGINT) AS b, y_score AS score, CAST(sum(times * pos) AS DOUBLE) AS pos, CAST(sum(times * neg) AS DOUBLE) AS neg FROM
 level p JOIN (SELECT * FROM drawn UNION ALL SELECT DISTINCT seed, -1, scene_index, 1 FROM predictions) d ON p.seed = d.seed AND p.scene_index = d.scene_index GROUP BY ALL),
auc AS (SELECT {CELL}, b, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS s FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {CELL}, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM tie) GROUP BY {CELL}, b),
pts AS (SELECT {CELL}, metric, value FROM scores UNION ALL SELECT {CELL}, 'auroc', s FROM auc WHERE b = -1),
ci AS (SELECT {CELL}, metric, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM
 (SELECT *, CASE WHEN target = 'alert' THEN 'balanced_accuracy' ELSE 'r2' END AS metric FROM boot UNION ALL SELECT *, 'auroc' FROM auc WHERE b >= 0) GROUP BY {CELL}, metric),
facts AS (SELECT {CELL}, count(*) AS n_rows, count(DISTINCT scene_index) AS n_scenes, avg(y_true) AS rate FROM predictions GROUP BY {CELL}),
summary AS (SELECT {CELL}, n_rows, n_scenes, metric, value, lo AS ci_low, hi AS ci_high, CASE WHEN metric = 'r2' THEN 0.0 ELSE 0.5 END AS trivial,
 CASE WHEN metric <> 'r2' THEN greatest(rate, 1 - rate) END AS majority_rate FROM pts JOIN ci USING ({CELL}, metric) JOIN facts USING ({CELL}))"""


@query("summary_long", SUMMARY + f""" SELECT {CELL}, n_rows, n_scenes, metric, round(value, 6) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
CAST(trivial AS DOUBLE) AS trivial, round(majority_rate, 6) AS majority_rate FROM summary""")
def summary_long(spark, d):
    s = S.summarize(cut(V.predictions(spark, d)), N, classes=V.CLASSES)
    return s.select(*S.CELL, "n_rows", "n_scenes", "metric", *[R6(c) for c in ("value", "ci_low", "ci_high")], "trivial", R6("majority_rate"))


@query("seed_aggregate", SUMMARY + """ SELECT exp, encoder, train_condition, layer, view, task, eval_condition, target, metric, round(avg(value), 6) AS value,
round(min(ci_low), 6) AS ci_low, round(max(ci_high), 6) AS ci_high, round(stddev_pop(value), 6) AS seed_sd, count(*) AS n_seeds,
CAST(arg_min(trivial, seed) AS DOUBLE) AS trivial, round(arg_min(majority_rate, seed), 6) AS majority_rate FROM summary
GROUP BY exp, encoder, train_condition, layer, view, task, eval_condition, target, metric""")
def seed_aggregate(spark, d):
    a = S.aggregate_seeds(S.summarize(cut(V.predictions(spark, d)), N, classes=V.CLASSES))
    return a.select(*[R6(c) if c in ("value", "ci_low", "ci_high", "seed_sd", "majority_rate") else c for c in a.columns])


@query("best_band", SUMMARY + """, r AS (SELECT *, row_number() OVER (PARTITION BY target, encoder, seed ORDER BY value DESC, ci_low DESC) AS rn FROM summary WHERE metric <> 'auroc')
SELECT target, encoder, seed, round(value, 6) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, layer, view FROM r WHERE rn = 1""")
def best_band(spark, d):
    s = S.summarize(cut(V.predictions(spark, d)), N, classes=V.CLASSES).where("metric <> 'auroc'")
    return S.best_band(s, ("target", "encoder", "seed")).select("target", "encoder", "seed", *[R6(c) for c in ("value", "ci_low", "ci_high")], "layer", "view")


@query("layer_curve", SUMMARY + """ SELECT target, layer, metric, round(value, 6) AS value, round(value - ci_low, 6) AS err_low, round(ci_high - value, 6) AS err_high,
CAST(trivial AS DOUBLE) AS chance FROM summary WHERE encoder = 'strong' AND view = 'mean' AND seed = 0""")
def layer_curve(spark, d):
    cells = V.predictions(spark, d, seeds=(0,), encoders=("strong",)).where("view = 'mean'")     # the cells shown; draws do not depend on others
    s = S.summarize(cut(cells), N, classes=V.CLASSES)
    return S.layer_curve(s, "strong", "mean").select("target", "layer", "metric", *[R6(c) for c in ("value", "err_low", "err_high")], "chance")


M = 0.05
COMPARE = f"""WITH {PREDICTIONS}, {SCORES}, top AS (SELECT *, row_number() OVER (PARTITION BY encoder, seed, target ORDER BY value DESC, layer, view) AS rn FROM scores),
pick AS (SELECT p.* FROM predictions p JOIN top t ON t.rn = 1 AND t.encoder = p.encoder AND t.seed = p.seed AND t.target = p.target AND t.layer = p.layer AND t.view = p.view),
pr AS (SELECT a.seed, a.target, a.scene_index, a.y_true AS y, a.y_pred AS pa, b.y_pred AS pb FROM pick a JOIN pick b ON a.encoder = 'strong' AND b.encoder = 'weak' AND a.seed = b.seed AND a.target = b.target AND a.scene_index = b.scene_index AND a.frame_index = b.frame_index),
{draws('(SELECT DISTINCT seed, scene_index FROM pr)', N, 'seed', 'seed')},
ps AS (SELECT seed, target, scene_index, count(*) AS n, sum(y) AS p, sum(1 - y) AS q, sum(CASE WHEN y = 1 THEN CAST(pa = 1 AS INT) - CAST(pb = 1 AS INT) ELSE 0 END) AS hit, sum(CASE WHEN y = 0 THEN CAST(pa = 0 AS INT) - CAST(pb = 0 AS INT) ELSE 0 END) AS miss,
 sum((y - pb) ** 2) - sum((y - pa) ** 2) AS less, sum(y - 50) AS sy, sum((y - 50) ** 2) AS syy FROM pr GROUP BY ALL),
g AS (SELECT p.seed, p.target, d.b, CASE WHEN p.target = 'alert' THEN sum(times * hit) / sum(times * p) / 2 + sum(times * miss) / sum(times * q) / 2
 ELSE sum(times * less) / (sum(times * syy) - sum(times * sy) ** 2 / sum(times * n)) END AS gap
 FROM ps p JOIN drawn d ON p.seed = d.seed AND p.scene_index = d.scene_index GROUP BY p.seed, p.target, d.b),
obs AS (SELECT a.seed, a.target, a.metric, a.value - b.value AS observed FROM top a JOIN top b ON a.encoder = 'strong' AND b.encoder = 'weak' AND a.rn = 1 AND b.rn = 1 AND a.seed = b.seed AND a.target = b.target),
tests AS (SELECT 'D' AS exp, seed, 'strong' AS encoder, 'weak' AS baseline, target, metric, observed AS observed_difference, avg(CASE WHEN gap <= 0 THEN 1.0 ELSE 0 END) AS p_superiority,
 quantile_cont(gap, 0.05) AS lo, quantile_cont(gap, 0.95) AS hi, avg(CASE WHEN gap >= {M} THEN 1.0 ELSE 0 END) AS up, avg(CASE WHEN gap <= -{M} THEN 1.0 ELSE 0 END) AS down, count(*) AS n FROM g JOIN obs USING (seed, target) GROUP BY seed, target, metric, observed),
full_tests AS (SELECT exp, seed, encoder, baseline, target, metric, observed_difference, p_superiority, lo > -{M} AND hi < {M} AS tost_equivalent, lo AS tost_ci_low, hi AS tost_ci_high, up AS tost_p_upper, down AS tost_p_lower, greatest(up, down) AS tost_p_tost, n AS tost_n_boot FROM tests)"""
TEST_ROUND = "exp, seed, encoder, baseline, target, metric, round(observed_difference, 6) AS observed_difference, round(p_superiority, 6) AS p_superiority, tost_equivalent, round(tost_ci_low, 6) AS tost_ci_low, round(tost_ci_high, 6) AS tost_ci_high, round(tost_p_upper, 6) AS tost_p_upper, round(tost_p_lower, 6) AS tost_p_lower, round(tost_p_tost, 6) AS tost_p_tost, tost_n_boot"
TEST_COLS = ["exp", "seed", "encoder", "baseline", "target", "metric", "observed_difference", "p_superiority", "tost_equivalent",
             "tost_ci_low", "tost_ci_high", "tost_p_upper", "tost_p_lower", "tost_p_tost", "tost_n_boot"]


def _rounded(t, cols):
    doubles = {n for n, k in t.dtypes if k == "double"}
    return t.select(*[R6(c) if c in doubles else c for c in cols])


@query("paired_diff_tost", f"{COMPARE} SELECT {TEST_ROUND} FROM full_tests")
def paired_diff_tost(spark, d):
    t = S.compare_to_baseline(cut(V.predictions(spark, d)), "strong", "weak", M, N, V.CLASSES)
    return _rounded(t, TEST_COLS)


@query("verdicts", f"""{COMPARE}, r AS (SELECT *, count(*) OVER (PARTITION BY target) AS m, row_number() OVER (PARTITION BY target ORDER BY p_superiority, seed) AS k FROM full_tests),
h AS (SELECT *, least(1.0, max((m - k + 1) * p_superiority) OVER (PARTITION BY target ORDER BY p_superiority, seed ROWS UNBOUNDED PRECEDING)) AS p_holm FROM r)
SELECT seed, target, round(p_holm, 6) AS p_superiority_holm, 'seeds tested for target=' || target AS holm_family,
CASE WHEN p_holm < 0.05 AND tost_equivalent THEN 'detectable but below the 0.05 effect-size threshold' WHEN p_holm < 0.05 THEN 'above baseline' WHEN tost_equivalent THEN 'equivalent to baseline' ELSE 'inconclusive' END AS verdict FROM h""")
def verdicts(spark, d):
    t = S.compare_to_baseline(cut(V.predictions(spark, d)), "strong", "weak", M, N, V.CLASSES)
    return S.hypothesis_table(t).select("seed", "target", R6("p_superiority_holm"), "holm_family", "verdict")


PAIRED = HALVES + """,
pj AS (SELECT a.scene_index, a.frame_index, a.value AS vb, b.value AS vo, a.k AS kb, b.k AS ko, a.cls AS cb, b.cls AS co, b.k / 100 AS occ FROM base_half a JOIN other_half b USING (scene_index, frame_index)),
pp AS (SELECT 'value' AS target, scene_index, frame_index, occ, vb AS y_base, vo AS y_occ, 0.8 * vb + 0.3 * kb + (1 - 0.8) * 50 AS p_base, 0.8 * vo + 0.3 * ko + (1 - 0.8) * 50 AS p_occ FROM pj
 UNION ALL SELECT 'alert', scene_index, frame_index, occ, cb, co, CASE WHEN floor(kb / 10) + 2 * cb - 5 > 0 THEN 1 ELSE 0 END, CASE WHEN floor(ko / 10) + 2 * co - 5 > 0 THEN 1 ELSE 0 END FROM pj),
binned AS (SELECT *, var_pop(y_occ) OVER (PARTITION BY target) AS var, CAST(CASE WHEN occ < 0.2 THEN 0 WHEN occ < 0.4 THEN 1 WHEN occ < 0.6 THEN 2 WHEN occ < 1.01 THEN 3 END AS INT) AS bin FROM pp)"""


@query("matched_rows", f"WITH {PAIRED} SELECT target, scene_index, frame_index, occ AS occlusion_fraction, round(CAST(p_base AS DOUBLE), 6) AS p_base, round(CAST(p_occ AS DOUBLE), 6) AS p_occ FROM pp")
def matched_rows(spark, d):
    p = S.paired_rows(V.transfer_predictions(spark, d, ("strong",)), "strong", ("value", "alert"))
    return p.select("target", "scene_index", "frame_index", "occlusion_fraction", R6("p_base"), R6("p_occ"))


@query("occlusion_bins", f"WITH {PAIRED} SELECT target, bin, count(*) AS n_rows, count(DISTINCT scene_index) AS n_scenes FROM binned GROUP BY target, bin")
def occlusion_bins(spark, d):
    p = S.paired_rows(V.transfer_predictions(spark, d, ("strong",)), "strong", ("value", "alert"))
    return p.withColumn("bin", S.bin_of(F.col("occlusion_fraction"))).groupBy("target", "bin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("scene_index").alias("n_scenes"))


def _score(s: str, times: str = "1") -> str:
    hit = lambda v: f"sum({times} * tp{v}_{s}) / nullif(sum({times} * n{v}_{s}), 0)"
    return f"CASE WHEN target = 'alert' THEN coalesce(({hit(1)} + {hit(0)}) / 2, {hit(1)}, {hit(0)}) ELSE 1 - sum({times} * rss_{s}) / sum({times} * n) / any_value(var) END"


_SIDES = ", ".join(f"sum((y_{s} - p_{s}) ** 2) AS rss_{s}, " + ", ".join(f"sum(CASE WHEN y_{s} = {v} AND p_{s} = {v} THEN 1.0 ELSE 0 END) AS tp{v}_{s}, sum(CASE WHEN y_{s} = {v} THEN 1.0 ELSE 0 END) AS n{v}_{s}" for v in (0, 1)) for s in ("base", "occ"))


RATIO = "(o - CASE WHEN target = 'alert' THEN 0.5 ELSE 0 END) / (b0 - CASE WHEN target = 'alert' THEN 0.5 ELSE 0 END)"


@query("retained_skill", f"""WITH {PAIRED}, {draws('(SELECT DISTINCT target, bin, scene_index FROM binned)', CURVE_N, 'target, bin')},
per AS (SELECT target, bin, scene_index, any_value(var) AS var, count(*) AS n, {_SIDES} FROM binned GROUP BY target, bin, scene_index),
pt AS (SELECT target, bin, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS ns, {_score('base')} AS b0, {_score('occ')} AS o FROM per GROUP BY target, bin),
bt AS (SELECT target, bin, b, {_score('base', 'times')} AS b0, {_score('occ', 'times')} AS o FROM (SELECT r.*, d.b, d.times FROM per r JOIN drawn d ON r.target = d.target AND r.bin = d.bin AND r.scene_index = d.scene_index) GROUP BY target, bin, b),
ci AS (SELECT target, bin, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM (SELECT target, bin, {RATIO} AS s, b0 FROM bt) WHERE abs(b0 - CASE WHEN target = 'alert' THEN 0.5 ELSE 0 END) > 1e-9 GROUP BY target, bin)
SELECT target, bin, n_rows, round(CASE WHEN n_rows >= 30 AND ns >= 8 THEN {RATIO} ELSE 'nan'::DOUBLE END, 5) AS value, round(lo, 5) AS ci_low, round(hi, 5) AS ci_high, round(b0, 5) AS base_value FROM pt JOIN ci USING (target, bin)""")
def retained_skill(spark, d):
    p = S.paired_rows(V.transfer_predictions(spark, d, ("strong",)), "strong", ("value", "alert"))
    c = S.retained_skill(p, ["exp", "seed", "target"], classes=V.CLASSES, n_boot=CURVE_N)
    return c.select("target", "bin", "n_rows", *[F.round(x, 5).alias(x) for x in ("value", "ci_low", "ci_high", "base_value")])


@query("headline_metrics", f"""WITH {PREDICTIONS} SELECT target, CASE WHEN target = 'alert' THEN 'balanced_accuracy' ELSE 'r2' END AS metric,
CAST(CASE WHEN target = 'alert' THEN 0.5 ELSE 0 END AS DOUBLE) AS chance, count(*) AS n_rows FROM predictions GROUP BY target""")
def headline_metrics(spark, d):
    p = V.predictions(spark, d).withColumn("metric", S.headline(F.col("target"), V.CLASSES))
    return p.groupBy("target", "metric", S.chance(F.col("metric")).alias("chance")).agg(F.count(F.lit(1)).alias("n_rows"))
