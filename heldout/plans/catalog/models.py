"""Moments, probes, patch probe and dynamics over the embeddings and lineitem tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import audit as A, dynamics as Dy, metrics as M, moments as Mo, probes as P, spatial as S, splits as Sp
from ...operators.common import cut
from .. import views as V
from ..cells import Cell, Corpus, run_cells
from .registry import FEATURES, FRAMES, cells, query, split

R6 = lambda c: (F.round(F.col(c), 6) + 0.0).alias(c)


def _long(m, name):
    return m.select(*[c for c in m.columns if c != "row"], F.posexplode("row").alias("j", name))


@query("feature_moments", f"""WITH {FEATURES}, {cells()} SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) AS v FROM cells a JOIN cells b USING (scene_index, frame_index) GROUP BY 1, 2""")
def feature_moments(spark, d):
    return _long(Mo.scatter(V.features(spark, d), "x"), "v").select("i", "j", R6("v"))


FOLDED = f"{FEATURES}, {split('features', 2)}, {cells()}, f AS (SELECT c.*, CAST(pos % 5 AS INT) AS fold FROM cells c JOIN split USING (scene_index))"


@query("fold_moments", f"""WITH {FOLDED}, h AS (SELECT a.fold, a.i, b.i AS j, sum(a.v * b.v) AS held FROM f a JOIN f b USING (scene_index, frame_index) GROUP BY 1, 2, 3)
SELECT fold, i, j, round(held, 6) AS held, round(sum(held) OVER (PARTITION BY i, j) - held, 6) AS train FROM h""")
def fold_moments(spark, d):
    """Held-out moments per fold and the training moments by subtraction."""
    x = V.features(spark, d)
    rows = Sp.mark(x, Sp.grouped_folds(x, "scene_index", 5, 2), "scene_index")
    held = cut(_long(Mo.scatter(rows, "x", ["fold"]), "held"))
    total = held.groupBy("i", "j").agg(F.sum("held").alias("total"))
    return held.join(F.broadcast(total), ["i", "j"]).select("fold", "i", "j", R6("held"), (F.round(F.col("total") - F.col("held"), 6) + 0.0).alias("train"))


@query("standardiser", f"""WITH {FEATURES}, {split('features', 0)}, {cells()} SELECT i, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS scale FROM cells JOIN split USING (scene_index) WHERE is_train GROUP BY i""")
def standardiser(spark, d):
    x = V.features(spark, d)
    train = Sp.mark(x, Sp.scene_split(x, "scene_index", 0), "scene_index").where("is_train")
    mean, scale = Mo.standardiser(train, "x")
    return spark.createDataFrame([(i, float(m), float(s)) for i, (m, s) in enumerate(zip(mean, scale))], "i int, mean double, scale double") \
        .select("i", R6("mean"), R6("scale"))


@query("scalar_moments", """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s_l_quantity, round(sum(l_discount), 2) AS s_l_discount, round(sum(l_quantity * l_quantity), 2) AS p_l_quantity_l_quantity,
round(sum(l_quantity * l_discount), 2) AS p_l_quantity_l_discount, round(sum(l_discount * l_discount), 2) AS p_l_discount_l_discount FROM lineitem GROUP BY 1""")
def scalar_moments(spark, d):
    m = Mo.scalar_moments(V.table(spark, d, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"])
    return m.select("l_returnflag", "n", *[F.round(c, 2).alias(c) for c in m.columns[2:]])


@query("scene_pool", f"""WITH {FEATURES}, {cells(64)}, t AS (SELECT scene_index, arg_min(label, frame_index) AS label FROM features GROUP BY 1)
SELECT c.scene_index, label, i, round(avg(v), 6) AS v FROM cells c JOIN t USING (scene_index) GROUP BY 1, 2, 3""".replace("SELECT scene_index, frame_index, label, cls,", "SELECT scene_index, frame_index,"))
def scene_pool(spark, d):
    p = Mo.mean_vector(V.features(spark, d), "x", ["scene_index"], [F.min_by("label", "frame_index").alias("label")])
    return p.select("scene_index", "label", F.posexplode("x").alias("i", "v")).select("scene_index", "label", "i", R6("v"))


# ---- ridge in closed form on one standardised feature -------------------------

RIDGE = f"""li AS (SELECT l_orderkey AS scene_index, l_quantity AS x0, l_extendedprice AS y FROM lineitem), {split('li', 0)},
tr AS (SELECT li.*, pos % 5 AS fold FROM li JOIN split USING (scene_index) WHERE is_train),
st AS (SELECT avg(x0) AS mx, stddev_pop(x0) AS sx FROM tr), z AS (SELECT fold, (x0 - mx) / sx AS x, y FROM tr, st),
al AS (SELECT CAST(a AS INT) AS a, 10 ** (-3 + 0.5 * a) AS alpha FROM range(17) r(a)),
ft AS (SELECT f.fold, avg(x) AS xb, avg(y) AS yb, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM z, range(5) f(fold) WHERE z.fold <> f.fold GROUP BY f.fold),
fit AS (SELECT a, ft.fold, sxy / (sxx + alpha) AS b, yb - xb * sxy / (sxx + alpha) AS c FROM ft, al),
hm AS (SELECT fold, avg(y) AS m FROM z GROUP BY fold),
sc AS (SELECT a, z.fold, 1 - sum((y - b * x - c) ** 2) / sum((y - m) ** 2) AS s FROM z JOIN fit ON fit.fold = z.fold JOIN hm ON hm.fold = z.fold GROUP BY a, z.fold),
cv AS (SELECT a, avg(s) AS score FROM sc GROUP BY a),
best AS (SELECT a FROM cv ORDER BY round(score, 12) DESC, a LIMIT 1),
fin AS (SELECT alpha, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + alpha) AS b, avg(y) AS yb, avg(x) AS xb FROM z, al JOIN best USING (a) GROUP BY alpha)"""


def _line(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene_index"), "l_linenumber", F.array(F.col("l_quantity")).alias("x"), F.col("l_extendedprice").alias("y"))
    return cut(P.with_folds(li, "scene_index", [0]))


@query("ridge_path", f"WITH {RIDGE} SELECT a, round(score, 6) AS cv_r2 FROM cv")
def ridge_path(spark, d):
    fit = P.fit_ridge(_line(spark, d), "x", ["y"], [0])[0]
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(fit.cv_scores[:, 0])], "a int, cv_r2 double")


@query("ridge_predict", f"""WITH {RIDGE}, p AS (SELECT li.scene_index, y, (x0 - mx) / sx * b + yb - xb * b AS y_pred FROM li JOIN split USING (scene_index), st, fin WHERE NOT is_train)
SELECT scene_index, count(*) AS n, round(sum(y_pred), 2) AS total_pred FROM p GROUP BY 1""")
def ridge_predict(spark, d):
    rows = _line(spark, d)
    fit = P.fit_ridge(rows, "x", ["y"], [0])
    test = rows.where(F.col("folds")[0] < 0).withColumn("y_pred", P.linear_scores(F.col("x"), fit)[0])
    return test.groupBy("scene_index").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y_pred"), 2).alias("total_pred"))


def _ridge_sql(name: str, source: str, seed: int) -> str:
    """CTE ``{name}_fin`` (alpha, b, c): the ridge of y on x0 over the training scenes of ``source`` with the penalty of the best mean fold score."""
    n = name
    return f"""{split(source, seed, n)}, {n}_tr AS (SELECT r.*, pos % 5 AS fold FROM {source} r JOIN {n} USING (scene_index) WHERE is_train),
{n}_st AS (SELECT avg(x0) AS mx, stddev_pop(x0) AS sx FROM {n}_tr), {n}_z AS (SELECT fold, (x0 - mx) / sx AS x, y FROM {n}_tr, {n}_st),
{n}_al AS (SELECT CAST(a AS INT) AS a, 10 ** (-3 + 0.5 * a) AS alpha FROM range(17) r(a)),
{n}_ft AS (SELECT f.fold, avg(x) AS xb, avg(y) AS yb, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM {n}_z z, range(5) f(fold) WHERE z.fold <> f.fold GROUP BY f.fold),
{n}_sc AS (SELECT a, z.fold, 1 - sum((y - sxy / (sxx + alpha) * x - yb + xb * sxy / (sxx + alpha)) ** 2) / (var_pop(y) * count(*)) AS s FROM {n}_z z JOIN {n}_ft t ON t.fold = z.fold, {n}_al GROUP BY a, z.fold),
{n}_best AS (SELECT a FROM (SELECT a, avg(s) AS score FROM {n}_sc GROUP BY a) ORDER BY round(score, 12) DESC, a LIMIT 1),
{n}_fin AS (SELECT alpha, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + alpha) AS b, avg(y) - avg(x) * covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + alpha) AS c FROM {n}_z, {n}_al JOIN {n}_best USING (a) GROUP BY alpha)"""


def _cells_sql() -> str:
    parts, out = [], []
    for source, told in (("base", (("real", "base", "base"), ("transfer", "base", "base"), ("transfer", "occluded", "occluded"))), ("pooled", (("scene_pooled", "base", "pooled"),))):
        for seed in (0, 1):
            n = f"{source}{seed}"
            parts.append(_ridge_sql(n, source, seed))
            out += [f"""SELECT {seed} AS seed, '{task}' AS task, '{condition}' AS eval_condition, count(*) AS n_rows, round(sum(y), 4) AS total_true, round(sum((x0 - mx) / sx * b + c), 4) AS total_pred,
round(sum(((x0 - mx) / sx * b + c) * (r.scene_index + 1)), 2) AS weighted_pred, round(max(log10(alpha)), 6) AS log_penalty FROM {rows} r JOIN {n} USING (scene_index), {n}_st, {n}_fin WHERE NOT is_train""" for task, condition, rows in told]
    return f"""WITH {FRAMES}, base AS (SELECT scene_index, frame_index, k AS x0, 0.05 * value + 0.5 * k + sin(scene_index) AS y FROM frames), occluded AS (SELECT scene_index, frame_index, 0.9 * x0 + 3 AS x0, y FROM base),
pooled AS (SELECT scene_index, avg(x0) AS x0, arg_min(y, frame_index) AS y FROM base GROUP BY 1), {', '.join(parts)} {' UNION ALL '.join(out)}"""


@query("cell_predictions", _cells_sql())
def cell_predictions(spark, d):
    """Three cells of one design, two seeds: frames, a transfer to treated frames, scenes pooled; against closed forms."""
    base = cut(V.frames(spark, d).select("scene_index", "frame_index", "k", (0.05 * F.col("value") + 0.5 * F.col("k") + F.sin("scene_index")).alias("obj_pos_x")))

    def features(encoder, condition, layer, view):
        x = F.col("k") if condition == "base" else F.col("k") * 0.9 + 3
        return base.select("scene_index", "frame_index", F.array(x).alias("x"))

    cells = [Cell("k", "base", 0, "mean", ("obj_pos_x",)), Cell("k", "base", 0, "mean", ("obj_pos_x",), "transfer", label="paired", also=("occluded",)), Cell("k", "base", 0, "mean", ("obj_pos_x",), "scene_pooled", pool=True)]
    told = run_cells(Corpus(features, lambda condition: base.select("scene_index", "frame_index", "obj_pos_x")), cells, "D", [0, 1])
    return told.groupBy("seed", "task", "eval_condition").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("y_true"), 4).alias("total_true"), F.round(F.sum("y_pred"), 4).alias("total_pred"),
        F.round(F.sum(F.col("y_pred") * (F.col("scene_index") + 1)), 2).alias("weighted_pred"), F.round(F.log10(F.max("penalty")), 6).alias("log_penalty"))


@query("ridge_probe")
def ridge_probe(spark, d):
    """64 features, two targets, three seeds from one scan."""
    seeds = [0, 1, 2]
    rows = cut(P.with_folds(V.features(spark, d), "scene_index", seeds))
    fits = P.fit_ridge(rows, "x", ["label", "cls"], seeds)
    scored = rows.withColumn("p", P.linear_scores(F.col("x"), fits))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(t).alias("target"), F.col("folds")[i].alias("fold"), F.col(t).cast("double").alias("y_true"),
                                        F.col("p")[i * 2 + k].alias("y_pred")) for i, s in enumerate(seeds) for k, t in enumerate(("label", "cls"))]))
    return M.r2(scored.select(each.alias("r")).select("r.*").where("fold = -1"), ["seed", "target"])


@query("logistic_path")
def logistic_path(spark, d):
    rows = cut(P.with_folds(V.features(spark, d), "scene_index", [0]))
    fit = P.fit_logistic(rows, "x", "cls", [0])[0]
    return spark.createDataFrame([(i, float(c), float(s), float(c) == float(fit.penalty[0]), fit.iterations) for i, (c, s) in enumerate(zip(P.LOGISTIC_CS, fit.cv_scores[:, 0]))],
                                 "i int, c double, cv_balanced_accuracy double, chosen boolean, worst_steps int")


@query("logistic_predict")
def logistic_predict(spark, d):
    rows = cut(P.with_folds(V.features(spark, d), "scene_index", [0]))
    fit = P.fit_logistic(rows, "x", "cls", [0])
    score = P.linear_scores(F.col("x"), fit)[0]
    return rows.where(F.col("folds")[0] < 0).select("scene_index", "frame_index", "cls", score.alias("y_score")).withColumn("y_pred", (F.col("y_score") > 0).cast("int"))


WEIGHTS = [((i % 7) - 3) / 10 for i in range(64)]


@query("spatial_scores", f"""WITH {FEATURES}, {cells(64)} SELECT scene_index, frame_index // 5 AS frame, round(max(s), 6) AS y_score FROM
(SELECT scene_index, frame_index, sum(v * ((i % 7) - 3) / 10) + 0.25 AS s FROM cells GROUP BY 1, 2) GROUP BY 1, 2""")
def spatial_scores(spark, d):
    import numpy as np
    fit = P.LinearFit(np.zeros(64), np.ones(64), np.array(WEIGHTS)[:, None], np.array([0.25]), np.zeros(1), np.zeros((1, 1)))
    patches = V.features(spark, d).withColumn("frame", F.floor(F.col("frame_index") / 5))
    return S.pooled_scores(patches, "x", ["scene_index", "frame"], fit).select("scene_index", "frame", R6("y_score"))


@query("spatial_maxpool")
def spatial_maxpool(spark, d):
    """Trains on 80% of the scenes and scores the others' frames of five patches."""
    patches = V.features(spark, d).withColumn("frame", F.floor(F.col("frame_index") / 5))
    key = ["scene_index", "frame"]
    label = patches.groupBy(*key).agg(F.max("cls").alias("y"))
    rows = cut(Sp.mark(patches.join(label, key), Sp.scene_split(patches, "scene_index", 0), "scene_index"))
    fit = S.fit_max_pooled(rows.where("is_train"), "x", "y", key)
    scores = S.pooled_scores(rows.where("not is_train"), "x", key, fit)
    return scores.join(label, key).select(*key, "y", "y_score", (F.col("y_score") > 0).cast("int").alias("y_pred"))


# ---- dynamics -----------------------------------------------------------------

def _moves(spark, d):
    x = V.features(spark, d).withColumn("time", F.col("frame_index") * 0.1).withColumn("ex", F.col("x")[0]).withColumn("ey", F.col("x")[1])
    return Dy.transitions(x, "scene_index", "frame_index", "x", "ex", "ey", "time")


MOVES = f"""{FEATURES}, nx AS (SELECT *, lead(x) OVER w AS x2, lead(frame_index) OVER w AS f2 FROM features WINDOW w AS (PARTITION BY scene_index ORDER BY frame_index)),
moves AS (SELECT scene_index, frame_index, x AS z_now, x2 AS z_next, CAST(x2[1] AS DOUBLE) - CAST(x[1] AS DOUBLE) AS a0, CAST(x2[2] AS DOUBLE) - CAST(x[2] AS DOUBLE) AS a1, (f2 - frame_index) * 0.1::DOUBLE AS a2 FROM nx WHERE x2 IS NOT NULL)"""


@query("transitions", f"WITH {MOVES} SELECT scene_index, frame_index, round(a0, 6) AS a0, round(a1, 6) AS a1, round(a2, 6) AS a2, 1.0::DOUBLE AS a3, round(CAST(z_next[64] AS DOUBLE), 6) AS z63 FROM moves")
def transitions(spark, d):
    m = _moves(spark, d)
    return m.select("scene_index", "frame_index", *[(F.round(F.col("action")[i], 6) + 0.0).alias(f"a{i}") for i in range(4)], F.round(F.col("z_next")[63], 6).alias("z63"))


@query("stationary_mse", f"""WITH {MOVES}, {split('features', 0)}, c AS (SELECT m.*, is_train, CAST(i AS INT) AS i, CAST(z_now[i + 1] AS DOUBLE) AS p, CAST(z_next[i + 1] AS DOUBLE) AS q FROM moves m JOIN split USING (scene_index), range(64) r(i)),
s AS (SELECT i, stddev_pop(p) AS sd FROM c WHERE is_train GROUP BY i) SELECT CAST(count(*) / 64 AS BIGINT) AS n_test, round(avg(((q - p) / sd) ** 2), 6) AS stationary_mse FROM c JOIN s USING (i) WHERE NOT is_train""")
def stationary_mse(spark, d):
    m = _moves(spark, d)
    rows = cut(Sp.mark(m, Sp.scene_split(V.features(spark, d), "scene_index", 0), "scene_index"))
    _, scale = Mo.standardiser(rows.where("is_train"), "z_now", floor=1e-8)
    return Dy.stationary_mse(rows.where("not is_train"), scale).select("n_test", R6("stationary_mse"))


@query("action_scale", f"""WITH {MOVES}, {split('features', 0)} SELECT round(max(abs(a0)), 6) AS a0, round(max(abs(a1)), 6) AS a1, round(max(abs(a2)), 6) AS a2, 1.0::DOUBLE AS a3 FROM moves JOIN split USING (scene_index) WHERE is_train""")
def action_scale(spark, d):
    rows = Sp.mark(_moves(spark, d), Sp.scene_split(V.features(spark, d), "scene_index", 0), "scene_index").where("is_train")
    return spark.createDataFrame([tuple(round(float(v), 6) for v in Dy.action_scale(rows))], "a0 double, a1 double, a2 double, a3 double")


@query("next_latent")
def next_latent(spark, d):
    m = cut(P.with_folds(_moves(spark, d), "scene_index", [0]))
    return spark.createDataFrame(Dy.predictability(m, "scene_index", "folds", [0]),
                                 "seed int, n_test long, latent_dim int, model_mse double, stationary_mse double, r2_vs_stationary double")


@query("dynamics_corr", """WITH c AS (SELECT user_id, avg(value) AS a, CASE WHEN user_id % 9 = 0 THEN 'nan'::DOUBLE ELSE stddev_pop(value) END AS b FROM events GROUP BY 1)
SELECT count(*) AS n_cells, round(corr(a, b), 6) AS pearson FROM c WHERE NOT isnan(b)""")
def dynamics_corr(spark, d):
    f = V.plain_frames(spark, d).groupBy("scene_index").agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("s"))
    c = f.withColumn("b", F.when(F.col("scene_index") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("s")))
    return Dy.correlation_over_cells(c, "a", "b").select("n_cells", R6("pearson"))


@query("learning_curve")
def learning_curve(spark, d):
    """R2 on the same held-out scenes as the training set grows."""
    x = V.features(spark, d)
    n = x.select("scene_index").distinct().count()
    sizes = [max(5, int(n * f)) for f in (0.2, 0.4, 0.6, 0.8)]
    rows = cut(x.join(F.broadcast(P.growing_membership(x, "scene_index", 0, sizes)), "scene_index"))
    fits = P.fit_ridge(rows, "x", ["label"], sizes)
    test = rows.where(F.col("folds")[0] == -1).withColumn("p", P.linear_scores(F.col("x"), fits))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("n_train"), F.col("label").alias("y_true"), F.col("p")[i].alias("y_pred")) for i, s in enumerate(sizes)]))
    return M.r2(test.select(each.alias("r")).select("r.*"), ["n_train"])
