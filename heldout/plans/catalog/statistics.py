"""Metrics, bootstrap, splits and control."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import bootstrap as B, metrics as M, splits as S, testing as T
from ...operators.ordering import hash_positions
from ...operators.common import cut
from .. import views as V
from .registry import FRAMES, PLAIN, SCORED, draws, query, split, u

R6 = lambda c: F.round(F.col(c), 6).alias(c)


@query("metric_r2", f"""WITH {SCORED} SELECT event_type, round(1 - sum((value - y_pred) ** 2) / sum((value - m) ** 2), 6) AS value
FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM scored) GROUP BY event_type""")
def metric_r2(spark, d):
    rows = V.scored(V.plain_frames(spark, d))
    return M.r2(rows, ["event_type"], "value", "y_pred").select("event_type", R6("value"))


BACC = """(sum(CASE WHEN cls = 1 AND guess = 1 THEN 1.0 ELSE 0 END) / sum(cls) + sum(CASE WHEN cls = 0 AND guess = 0 THEN 1.0 ELSE 0 END) / sum(1 - cls)) / 2"""
WEIGHTED_BACC = "(sum(times * tp) / nullif(sum(times * p), 0) + sum(times * tn) / nullif(sum(times * q), 0)) / 2"


@query("metric_balanced_accuracy", f"WITH {SCORED} SELECT cell, round({BACC}, 6) AS value FROM scored GROUP BY cell")
def metric_balanced_accuracy(spark, d):
    rows = V.scored(V.plain_frames(spark, d))
    return M.balanced_accuracy(rows, ["cell"], "cls", "guess").select("cell", R6("value"))


def auc_sql(source: str, by: str, weight: str = "1") -> str:
    return f"""SELECT {by}, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM
(SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
 (SELECT {by}, score, CAST(sum(cls * {weight}) AS DOUBLE) AS pos, CAST(sum((1 - cls) * {weight}) AS DOUBLE) AS neg FROM {source} GROUP BY {by}, score)) GROUP BY {by}"""


@query("metric_auroc", f"WITH {SCORED}, a AS ({auc_sql('scored', 'cell')}) SELECT cell, round(auc, 6) AS value FROM a")
def metric_auroc(spark, d):
    rows = V.scored(V.plain_frames(spark, d))
    return M.auroc(rows, ["cell"], "cls", "score").select("cell", R6("value"))


N = 2000


@query("bootstrap_multiplicity", f"""WITH scenes AS (SELECT DISTINCT user_id AS scene_index FROM events), {draws('scenes', N)}
SELECT b, scene_index, times FROM drawn""")
def bootstrap_multiplicity(spark, d):
    scenes = V.plain_frames(spark, d).select("scene_index").distinct()
    table = B.numbered(scenes, [], "scene_index", 0).transform(cut)
    return B.drawn_scenes(table, ["scene_index"], N)


def interval_sql(sample_cte: str, by: str, value: str) -> str:
    return f"""{sample_cte}, ci AS (SELECT {by}, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi, count(s) AS n FROM samples WHERE isfinite(s) GROUP BY {by})
SELECT {by}, round(v.value, 6) AS value, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, n AS n_boot FROM ({value}) v JOIN ci USING ({by})"""


R2_SAMPLES = f"""WITH {SCORED}, stats AS (SELECT event_type, scene_index, count(*) AS n, sum((value - y_pred) ** 2) AS rss, sum(value - c) AS sy, sum((value - c) ** 2) AS syy
 FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS c FROM scored) GROUP BY event_type, scene_index),
{draws('stats', N, 'event_type')},
samples AS (SELECT d.event_type, d.b, 1 - sum(times * rss) / (sum(times * syy) - sum(times * sy) ** 2 / sum(times * n)) AS s FROM drawn d JOIN stats t ON t.event_type = d.event_type AND t.scene_index = d.scene_index GROUP BY d.event_type, d.b)"""


def _with_interval(kind, rows, by, y, p):
    spread = B.interval(B.bootstrap(kind, rows, by, "scene_index", N, 0, y, p), by)
    return M.metric(kind, rows, by, y, p).join(spread, by).select(*by, R6("value"), R6("ci_low"), R6("ci_high"), "n_boot")


@query("bootstrap_r2_ci", interval_sql(R2_SAMPLES, "event_type",
       "SELECT event_type, 1 - sum((value - y_pred) ** 2) / sum((value - c) ** 2) AS value FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS c FROM scored) GROUP BY event_type"))
def bootstrap_r2_ci(spark, d):
    return _with_interval("r2", V.scored(V.plain_frames(spark, d)), ["event_type"], "value", "y_pred")


@query("bootstrap_bacc_ci", interval_sql(f"""WITH {SCORED}, {draws('(SELECT DISTINCT cell, scene_index FROM scored)', N, 'cell')},
per AS (SELECT cell, scene_index, sum(CASE WHEN cls = 1 AND guess = 1 THEN 1.0 ELSE 0 END) AS tp, sum(cls) AS p, sum(CASE WHEN cls = 0 AND guess = 0 THEN 1.0 ELSE 0 END) AS tn, sum(1 - cls) AS q FROM scored GROUP BY ALL),
samples AS (SELECT d.cell, d.b, {WEIGHTED_BACC} AS s FROM drawn d JOIN per t ON t.cell = d.cell AND t.scene_index = d.scene_index GROUP BY d.cell, d.b)""",
       "cell", f"SELECT cell, {BACC} AS value FROM scored GROUP BY cell"))
def bootstrap_bacc_ci(spark, d):
    return _with_interval("balanced_accuracy", V.scored(V.plain_frames(spark, d)), ["cell"], "cls", "guess")


@query("bootstrap_auroc_ci", interval_sql(f"""WITH {SCORED}, {draws('(SELECT DISTINCT cell, scene_index FROM scored)', N, 'cell')},
per AS (SELECT cell, scene_index, score, cls, count(*) AS n FROM scored GROUP BY ALL),
w AS (SELECT d.cell, d.b, t.score, t.cls, d.times * t.n AS times FROM drawn d JOIN per t ON t.cell = d.cell AND t.scene_index = d.scene_index),
samples AS (SELECT cell, b, auc AS s FROM ({auc_sql('w', 'cell, b', 'times')}))""",
       "cell", f"SELECT cell, auc AS value FROM ({auc_sql('scored', 'cell')})"))
def bootstrap_auroc_ci(spark, d):
    return _with_interval("auroc", V.scored(V.plain_frames(spark, d)), ["cell"], "cls", "score")


@query("holm_by_family", """WITH t AS (SELECT o_custkey, o_orderkey, (CAST(round(o_totalprice * 100) AS BIGINT) % 10007) / 10007.0 AS p FROM orders),
r AS (SELECT *, (count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY p, o_orderkey) + 1) * p AS c FROM t)
SELECT o_custkey, o_orderkey, round(p, 6) AS p, round(least(1.0, max(c) OVER (PARTITION BY o_custkey ORDER BY p, o_orderkey ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM r""")
def holm_by_family(spark, d):
    t = V.table(spark, d, "orders").select("o_custkey", "o_orderkey",
        ((F.round(F.col("o_totalprice") * 100).cast("long") % 10007) / F.lit(10007.0)).alias("p"))
    return T.holm(t, "p", ["o_custkey"]).select("o_custkey", "o_orderkey", R6("p"), R6("p_holm"))


@query("scene_split", f"WITH {PLAIN}, {split('plain', 0)} SELECT scene_index, is_train FROM split")
def scene_split(spark, d):
    return S.scene_split(V.plain_frames(spark, d), "scene_index", 0)


@query("split_rows", f"""WITH {PLAIN}, {split('plain', 3)} SELECT p.event_type, s.is_train, count(*) AS n_rows, count(DISTINCT p.scene_index) AS n_scenes
FROM plain p JOIN split s USING (scene_index) GROUP BY 1, 2""")
def split_rows(spark, d):
    rows = V.plain_frames(spark, d)
    return S.mark(rows, S.scene_split(rows, "scene_index", 3), "scene_index").groupBy("event_type", "is_train").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("scene_index").alias("n_scenes"))


@query("scene_filter", f"""WITH {PLAIN}, {split('plain', 1)} SELECT event_id, scene_index FROM plain WHERE scene_index IN (SELECT scene_index FROM split WHERE NOT is_train)""")
def scene_filter(spark, d):
    rows = V.plain_frames(spark, d)
    held = S.scene_split(rows, "scene_index", 1).where("not is_train")
    return S.only_scenes(rows, held, "scene_index").select("event_id", "scene_index")


@query("grouped_folds", f"WITH {PLAIN}, {split('plain', 2)} SELECT scene_index, CAST(pos % 5 AS INT) AS fold FROM split")
def grouped_folds(spark, d):
    return S.grouped_folds(V.plain_frames(spark, d), "scene_index", 5, 2)


@query("strided_shard", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INT) AS shard FROM (SELECT DISTINCT o_orderkey FROM orders)")
def strided_shard(spark, d):
    return S.strided_shards(V.table(spark, d, "orders"), "o_orderkey", 7)


CONTROL = f"""WITH {FRAMES}, sc AS (SELECT DISTINCT scene_index FROM frames),
taker AS (SELECT scene_index, row_number() OVER (ORDER BY scene_index) - 1 AS turn FROM sc),
giver AS (SELECT scene_index AS donor, row_number() OVER (ORDER BY {u('9973', 'scene_index')}, scene_index) - 1 AS turn FROM sc),
sz AS (SELECT scene_index AS donor, count(*) AS size FROM frames GROUP BY 1),
want AS (SELECT f.scene_index, f.frame_index, g.donor, (row_number() OVER (PARTITION BY f.scene_index ORDER BY {u('9973', 'f.scene_index', 'f.frame_index')}, f.frame_index) - 1) % sz.size AS at
 FROM frames f JOIN taker t ON t.scene_index = f.scene_index JOIN giver g ON g.turn = t.turn JOIN sz ON sz.donor = g.donor),
control AS (SELECT w.scene_index, w.frame_index, d.value, d.cls FROM want w JOIN frames d ON d.scene_index = w.donor AND d.frame_index = w.at)"""


@query("label_control", CONTROL + " SELECT scene_index, frame_index, value, cls FROM control")
def label_control(spark, d):
    return S.shuffled_labels(cut(V.frames(spark, d)), "scene_index", "frame_index", ["value", "cls"], 0)


@query("selectivity", CONTROL + """, j AS (SELECT f.scene_index % 5 AS cell, f.value AS real_y, c.value AS control_y, 0.8 * f.value + 0.3 * f.k AS p FROM frames f JOIN control c USING (scene_index, frame_index)),
m AS (SELECT *, avg(real_y) OVER (PARTITION BY cell) AS rm, avg(control_y) OVER (PARTITION BY cell) AS cm FROM j)
SELECT CAST(cell AS INT) AS cell, round(1 - sum((real_y - p) ** 2) / sum((real_y - rm) ** 2), 6) AS real, round(1 - sum((control_y - p) ** 2) / sum((control_y - cm) ** 2), 6) AS control,
round(sum((control_y - p) ** 2) / sum((control_y - cm) ** 2) - sum((real_y - p) ** 2) / sum((real_y - rm) ** 2), 6) AS selectivity FROM m GROUP BY cell""")
def selectivity(spark, d):
    rows = cut(V.frames(spark, d))
    key = ["scene_index", "frame_index"]
    control = S.shuffled_labels(rows, *key, ["value"], 0).withColumnRenamed("value", "control_y")
    both = V.scored(rows).join(control, key)
    real = M.r2(both, ["cell"], "value", "y_pred")
    fake = M.r2(both, ["cell"], "control_y", "y_pred")
    return S.selectivity(real, fake, ["cell"]).select("cell", R6("real"), R6("control"), R6("selectivity"))
