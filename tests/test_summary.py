import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heldout.operators import bootstrap as B, dynamics as Dy, summary as S


def predictions(spark, rng, encoders=(("good", 8, 0.3), ("good", 11, 0.6), ("bad", 0, 2.0)), seeds=(0, 1), scenes=40, exp="D", task="real", conditions=("base",)):
    rows = []
    for s in seeds:
        y = rng.normal(size=(scenes, 10))
        c = (y > 0).astype(float)
        for enc, layer, noise in encoders:
            for cond in conditions:
                p = y + rng.normal(size=y.shape) * noise * (2 if cond == "occluded" else 1)
                for i in range(scenes):
                    for f in range(10):
                        occ = float(rng.random()) if cond == "occluded" else 0.0
                        rows.append((exp, s, enc, "base", layer, "cls", task, cond, "obj_pos_x", i, f, y[i, f], p[i, f], None, occ))
                        rows.append((exp, s, enc, "base", layer, "cls", task, cond, "contact_state", i, f, c[i, f], float(p[i, f] > 0), p[i, f], occ))
    return spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows],
        "exp string, seed int, encoder string, train_condition string, layer int, view string, task string, eval_condition string, target string, "
        "scene_index int, frame_index int, y_true double, y_pred double, y_score double, occlusion_fraction double").cache()


def test_seed_aggregate_skips_nan(spark):
    nan = float("nan")
    cols = "exp string, seed int, encoder string, train_condition string, layer int, view string, task string, eval_condition string, target string, metric string, value double, ci_low double, ci_high double, trivial double, majority_rate double"
    key = ("D", "e", "base", 8, "cls", "real", "base", "t", "r2")
    rows = [(key[0], s, *key[1:], v, lo, hi, 0.0, m) for s, v, lo, hi, m in ((0, 0.5, 0.4, 0.6, 0.7), (1, 0.7, 0.5, 0.9, 0.8), (2, nan, nan, 0.95, 0.9))]
    r = S.aggregate_seeds(spark.createDataFrame(rows, cols)).first()
    assert (r.value, r.ci_low, r.ci_high, r.n_seeds, r.trivial, r.majority_rate) == (pytest.approx(0.6), 0.4, 0.95, 3, 0.0, 0.7)
    assert r.seed_sd == pytest.approx(np.std([0.5, 0.7]))


def test_best_cells_prefers_finite_and_first(spark):
    df = spark.createDataFrame([("e", "t", 8, "cls", 0.5), ("e", "t", 5, "mean", 0.5), ("e", "t", 2, "cls", float("nan")), ("e", "t", 11, "cls", 0.1)],
                               "encoder string, target string, layer int, view string, value double")
    r = S.best_cells(df, ["encoder", "target"]).collect()
    assert [(x.layer, x.view, x.value) for x in r] == [(5, "mean", 0.5)]


def test_summary_and_comparison(spark):
    rng = np.random.default_rng(0)
    p = predictions(spark, rng)
    s = S.summarize(p, 60).cache()
    assert s.count() == 2 * 3 * 3 and s.where("ci_low > value or value > ci_high").count() == 0
    row = s.where("metric = 'balanced_accuracy'").first()
    assert row.n_rows == 400 and row.n_scenes == 40 and row.trivial == 0.5 and 0.5 <= row.majority_rate < 0.7
    t = S.compare_to_baseline(p, "good", "bad", n_boot=60).cache()
    assert t.count() == 4 and t.where("p_superiority > 0 or observed_difference < 0.05").count() == 0
    obs = {(r.seed, r.target): r.observed_difference for r in t.collect()}
    v = {(r.seed, r.encoder, r.layer, r.target): r.value for r in s.where("metric <> 'auroc'").collect()}
    for (seed, target), d in obs.items():
        assert d == pytest.approx(max(v[(seed, "good", 8, target)], v[(seed, "good", 11, target)]) - v[(seed, "bad", 0, target)])
    h = S.hypothesis_table(t).collect()
    assert {r.verdict for r in h} == {"above baseline"} and h[0].holm_family.startswith("seeds tested for target=")
    same = S.compare_to_baseline(p.withColumn("encoder", F.when(F.col("encoder") == "bad", F.lit("bad")).otherwise(F.col("encoder"))), "good", "good", n_boot=40)
    assert S.hypothesis_table(same).where("verdict <> 'equivalent to baseline'").count() == 0
    with pytest.raises(RuntimeError, match="different rows"):
        S.compare_to_baseline(p.where("not (encoder = 'bad' and scene_index = 3 and frame_index = 2)"), "good", "bad", n_boot=5)


def test_paired_difference_equals_literal_resampling(spark):
    rng = np.random.default_rng(7)
    p = predictions(spark, rng, (("good", 8, 0.3), ("bad", 0, 2.0)), seeds=(3,), scenes=12)
    t = {r.target: r for r in S.compare_to_baseline(p, "good", "bad", n_boot=30).collect()}
    pdf = p.toPandas()
    table = B.numbered(p.select("scene_index").distinct(), [], "scene_index", 3)
    times = B.multiplicities(table.select("seed", "n_scenes").distinct(), 30).join(table, ["seed", "n_scenes", "drawn"]).toPandas()
    w = pdf[pdf.target == "obj_pos_x"].pivot(index=["scene_index", "frame_index"], columns="encoder", values=["y_true", "y_pred"]).reset_index()
    gaps = []
    for _, g in times.groupby("b"):
        m = dict(zip(g.scene_index, g.times))
        k = np.repeat(np.arange(len(w)), [m.get(v, 0) for v in w["scene_index"]])
        y, a, b = w[("y_true", "good")].values[k], w[("y_pred", "good")].values[k], w[("y_pred", "bad")].values[k]
        tot = ((y - y.mean()) ** 2).sum()
        gaps.append((((y - b) ** 2).sum() - ((y - a) ** 2).sum()) / tot)
    assert [t["obj_pos_x"].tost_ci_low, t["obj_pos_x"].tost_ci_high] == pytest.approx(list(np.percentile(gaps, [5, 95])), abs=1e-9)


def test_curve(spark):
    rng = np.random.default_rng(1)
    p = predictions(spark, rng, (("good", 8, 0.3),), seeds=(0,), exp="E", task="transfer", conditions=("base", "occluded"))
    pairs = S.paired_rows(p, "good", ("obj_pos_x", "contact_state")).cache()
    assert pairs.count() == 800
    c = S.retained_skill(pairs, ["exp", "seed", "target"], n_boot=40, bins=(0.0, 0.2, 0.4, 0.6, 1.01)).toPandas()
    w = pairs.where("target = 'obj_pos_x'").toPandas()
    var = w.y_occ.var(ddof=0)
    for b, (lo, hi) in enumerate(((0, .2), (.2, .4), (.4, .6), (.6, 1.01))):
        q = w[(w.occlusion_fraction >= lo) & (w.occlusion_fraction < hi)]
        base, occ = (1 - ((q[f"y_{k}"] - q[f"p_{k}"]) ** 2).mean() / var for k in ("base", "occ"))
        r = c[(c.target == "obj_pos_x") & (c.bin == b)].iloc[0]
        assert r.n_rows == len(q) and r.value == pytest.approx(occ / base) and r.base_value == pytest.approx(base)
        assert r.ci_low <= r.value <= r.ci_high
    thin = S.retained_skill(pairs, ["exp", "seed", "target"], n_boot=5, min_scenes=1000).toPandas()
    assert thin.value.isna().all() and thin.ci_low.isna().all() and (thin.n_rows > 0).all()
    lost = p.where("not (eval_condition = 'base' and target = 'obj_pos_x' and scene_index = 0 and frame_index = 0)")
    assert {r.target for r in S.paired_rows(lost, "good", ("obj_pos_x", "contact_state")).select("target").distinct().collect()} == {"contact_state"}


def test_chance_and_headline(spark):
    df = spark.createDataFrame([("r2",), ("auroc",), ("balanced_accuracy",), ("other",)], "m string")
    assert [r.c for r in df.select(S.chance(F.col("m")).alias("c")).collect()] == [0.0, 0.5, 0.5, None]
    t = spark.createDataFrame([("contact_state",), ("log_mass",), ("unknown",)], "t string")
    assert [r.h for r in t.select(S.headline(F.col("t")).alias("h")).collect()] == ["balanced_accuracy", "r2", "r2"]


def test_transitions_stay_within_scenes(spark):
    df = spark.createDataFrame([(s, f, [float(s * 10 + f)], float(f), 0.0, f * 0.5) for s in range(3) for f in (0, 1, 3)], "s long, f long, z array<double>, x double, y double, t double")
    m = Dy.transitions(df, "s", "f", "z", "x", "y", "t").collect()
    assert {(r.s, r.f, r.z_next[0] - r.z_now[0], tuple(r.action)) for r in m} == {(s, f, d, (d, 0.0, d / 2, 1.0)) for s in range(3) for f, d in ((0, 1.0), (1, 2.0))}
    c = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (2.0, 3.0)], "a double, b double")
    r = Dy.correlation_over_cells(c, "a", "b").first()
    assert r.n_cells == 2 and math.isnan(r.pearson)


def test_best_cells_with_scores_that_differ_between_evaluations(spark):
    """Sums of doubles are not alike to the last bit when they are taken twice."""
    noise = F.udf(lambda v: v + np.random.default_rng().normal() * 1e-12, "double").asNondeterministic()
    rows = spark.createDataFrame([(g, k, "m", float(k % 3)) for g in range(20) for k in range(6)], "g int, layer int, view string, value double").withColumn("value", noise("value"))
    found = S.best_cells(rows, ["g"]).collect()
    assert sorted(r.g for r in found) == list(range(20)) and {r.layer for r in found} <= {2, 5}


def test_paired_rows_leaves_untreated_scenes_and_refuses_lonely_rows(spark):
    cols = "exp string, seed int, target string, encoder string, layer int, view string, task string, eval_condition string, scene_index int, frame_index int, y_true double, y_pred double, occlusion_fraction double"
    row = lambda t, cond, scene, frame, layer=8, p=1.0: ("E", 0, t, "e", layer, "mean", "transfer", cond, scene, frame, 1.0, p, 0.1)
    rows = [row(t, cond, 1, f, layer) for t in "abc" for cond in ("base", "occluded") for f in (0, 1) for layer in (8, 11)]
    rows += [row("a", "base", 2, 0), row("b", "base", 1, 2), row("c", "occluded", 3, 0)]      # untreated scene; base row alone; treated row alone
    got = S.paired_rows(spark.createDataFrame(rows, cols), "e", ("a", "b", "c"))
    assert sorted((r.target, r.scene_index, r.frame_index) for r in got.collect()) == [("a", 1, 0), ("a", 1, 1)]
    assert got.columns == ["exp", "seed", "target", "scene_index", "frame_index", "y_base", "p_base", "y_occ", "p_occ", "occlusion_fraction"]
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()         # no shuffle of the rows is left to each reader


def test_halves_meet_by_scene_and_views_name_encoders(spark):
    from heldout.plans import views as V
    folder = "/root/testdata/sf0.001"
    a, b = V.halves(spark, folder)
    keys = lambda df: {(r.scene_index, r.frame_index) for r in df.collect()}
    whole = [keys(x) for x in V.whole_halves(spark, folder)]
    assert keys(a) == keys(b) == whole[0] & whole[1]
    assert "LeftSemi" not in a._jdf.queryExecution().optimizedPlan().toString()               # joined by scene, not row by row
    of = lambda df: sorted(map(repr, df.where("encoder = 'strong'").collect()))
    some = V.transfer_predictions(spark, folder, ("strong",))
    assert {r.encoder for r in some.select("encoder").distinct().collect()} == {"strong"} and of(some) == of(V.transfer_predictions(spark, folder))


def test_low_nodes_of_the_tree_share_their_distributions():
    from heldout.functions import multinomial as M
    M._kept_distribution.cache_clear()
    found = M.Resamples(0, 3000, np.arange(200)).counts(0, 3000)
    kept = M._kept_distribution.cache_info()
    assert kept.hits > kept.misses and (found.sum(1) == 3000).all()


def test_metrics_of_a_summary_share_one_stage_of_counts(spark):
    df = predictions(spark, np.random.default_rng(4), seeds=(0,), scenes=12)
    is_class = F.col("target") == "contact_state"
    plans = {"r2": (df.where(~is_class), "y_true", "y_pred"), "balanced_accuracy": (df.where(is_class), "y_true", "y_pred"), "auroc": (df.where(is_class), "y_true", "y_score")}
    plan = B.samples(plans, S.CELL, "scene_index", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan                          # the counts are made and written; no metric makes them again


def test_layer_curve_summarises_the_cells_it_shows(spark, monkeypatch):
    from heldout.plans.catalog import summaries
    seen, whole = [], S.summarize
    monkeypatch.setattr(summaries.S, "summarize", lambda p, *a, **k: seen.append(p) or whole(p, *a, **k))
    summaries.layer_curve(spark, "/root/testdata/sf0.001")
    assert {tuple(r) for r in seen[0].select("seed", "encoder", "view").distinct().collect()} == {(0, "strong", "mean")}
