"""Sampled factors, paired conditions and the decorrelation audit."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ...operators import decorrelation as D, sampling as P
from ...operators.common import spread
from .. import views as V
from .registry import erfc, query, u

SEED = 0
R = lambda c, n=9: F.round(F.col(c), n).alias(c)

# name -> (kind, arguments) for the SQL twin; the Spark side has its own table.
RANGES = {
    "mass": ("log", 0.05, 2.0), "friction_slide": ("uniform", 0.05, 1.2), "spawn_height": ("mixture", 0.35, 0.02, 0.20),
    "obj_radius": ("uniform", 0.26, 0.36), "approach_angle": ("uniform", -0.52, 0.52), "push_dist": ("uniform", 0.08, 0.18),
    "obj_yaw": ("uniform", 0.0, math.pi / 2), "distractor_angle": ("uniform", 0.90, 1.40), "distractor_side": ("coin", 0.5),
    "distractor_radius": ("uniform", 0.22, 0.42), "obj_size": ("uniform", 0.03, 0.09), "obj_hue": ("uniform", 0.0, 1.0),
    "obj_geom_type": ("choice", "box", "sphere", "cylinder"), "floor_gray": ("uniform", 0.62, 0.86),
    "light_x": ("uniform", -0.35, 0.35), "light_y": ("uniform", -0.35, 0.35), "light_z": ("uniform", 1.60, 2.40),
    "cam_daz": ("uniform", -2.0, 2.0), "cam_del": ("uniform", -2.0, 2.0), "cam_ddist": ("uniform", -0.03, 0.03),
    "distractor_present": ("coin", 0.5), "distractor_size": ("uniform", 0.03, 0.09), "distractor_hue": ("uniform", 0.0, 1.0),
    "distractor_geom_type": ("choice", "box", "sphere", "cylinder"),
}


def factor_sql(name: str) -> str:
    kind, *a = RANGES[name]
    key = (SEED, "scene_index", f"'{name}'")
    lin = lambda lo, hi, *k: f"({lo!r}::DOUBLE + {hi - lo!r}::DOUBLE * {u(*k)})"
    if kind == "uniform":
        return lin(*a, *key)
    if kind == "log":
        return f"exp({lin(math.log(a[0]), math.log(a[1]), *key)})"
    if kind == "mixture":
        return f"CASE WHEN {u(*key, 0)} < {a[0]} THEN 0.0 ELSE {lin(a[1], a[2], *key, 1)} END"
    if kind == "coin":
        return f"CASE WHEN {u(*key)} < {a[0]} THEN 1 ELSE 0 END"
    return f"(['box', 'sphere', 'cylinder'])[CAST(floor({u(*key)} * {len(a)}) AS INT) + 1]"


SCENES = "s AS (SELECT DISTINCT o_orderkey AS scene_index FROM orders)"
FACTORS = f"{SCENES}, factors AS (SELECT scene_index, {', '.join(f'{factor_sql(n)} AS {n}' for n in RANGES)} FROM s)"
DOUBLES = [n for n, (k, *_) in RANGES.items() if k in ("uniform", "log", "mixture")]


def _shown(n: str) -> str:
    return f"round({n}, 9) AS {n}" if n in DOUBLES else n


def tested(rho: str) -> str:
    """CTE ``tests``: p and adjusted p of a ``rho`` CTE with (a, b, rho, considered, n)."""
    z = "abs(atanh(greatest(-0.999999, least(0.999999, rho))) * sqrt((n - 3) / 1.06)) / sqrt(2)"
    return f"""{rho}, zs AS (SELECT *, {z} AS x FROM rho), ps AS (SELECT zs.*, least(1.0, {erfc('zs.x')}) AS p FROM zs),
ks AS (SELECT *, count(*) OVER (PARTITION BY considered) AS m, row_number() OVER (PARTITION BY considered ORDER BY p, a, b) AS k FROM ps),
tests AS (SELECT *, CASE WHEN considered THEN least(1.0, max((m - k + 1) * p) OVER (PARTITION BY considered ORDER BY p, a, b ROWS UNBOUNDED PRECEDING)) ELSE 1.0 END AS p_holm FROM ks)"""


VERDICT = """SELECT max(n) AS n_scenes, round(max(abs(rho)) FILTER (considered), 6) AS max_abs_rho, arg_max(a, abs(rho)) FILTER (considered) AS worst_a,
arg_max(b, abs(rho)) FILTER (considered) AS worst_b, count(*) FILTER (considered) AS n_pairs_considered, count(*) FILTER (considered AND p_holm < 0.01) AS n_significant_after_holm,
max(abs(rho)) FILTER (considered) <= 0.10 AND count(*) FILTER (considered AND p_holm < 0.01) = 0 AS passed FROM tests"""


def _factors(spark, d):
    return P.sample_factors(spread(V.table(spark, d, "orders").select("o_orderkey"), "o_orderkey").distinct(), "o_orderkey", SEED)


@query("factor_table", f"WITH {FACTORS} SELECT scene_index, {', '.join(map(_shown, RANGES))} FROM factors")
def factor_table(spark, d):
    return _factors(spark, d).select("scene_index", *[R(n) if n in DOUBLES else n for n in RANGES])


@query("paired_conditions", f"""WITH {FACTORS}, c AS (SELECT 'base' AS condition, * FROM factors UNION ALL SELECT 'occluded', * FROM factors WHERE scene_index < (SELECT count(*) FROM customer))
SELECT condition, printf('%s_%05d', condition, scene_index) AS scene_id, scene_index, round(mass, 9) AS mass, obj_geom_type FROM c""")
def paired_conditions(spark, d):
    both = P.with_conditions(_factors(spark, d), {"base": None, "occluded": V.table(spark, d, "customer").count()})
    return both.select("condition", "scene_id", "scene_index", R("mass"), "obj_geom_type")


@query("hue_rgb", f"""WITH {FACTORS}, h AS (SELECT scene_index, obj_hue * 6 AS t, floor(obj_hue * 6) AS s FROM factors),
v AS (SELECT scene_index, s, 0.85 AS hi, 0.85 * 0.25 AS lo, 0.85 * (1 - 0.75 * (t - s)) AS down, 0.85 * (1 - 0.75 * (1 - (t - s))) AS up FROM h)
SELECT scene_index, round(CASE s WHEN 0 THEN hi WHEN 1 THEN down WHEN 2 THEN lo WHEN 3 THEN lo WHEN 4 THEN up ELSE hi END, 9) AS r,
round(CASE s WHEN 0 THEN up WHEN 1 THEN hi WHEN 2 THEN hi WHEN 3 THEN down ELSE lo END, 9) AS g,
round(CASE s WHEN 0 THEN lo WHEN 1 THEN lo WHEN 2 THEN up WHEN 3 THEN hi WHEN 4 THEN hi ELSE down END, 9) AS b FROM v""")
def hue_rgb(spark, d):
    f = _factors(spark, d)
    return f.select("scene_index", *[F.round(c, 9).alias(n) for n, c in P.hue_rgb(F.col("obj_hue")).items()])


@query("clearance_audit", f"""WITH {FACTORS} SELECT count(*) AS n_scenes, round(min(abs(distractor_radius * sin(distractor_angle)) - distractor_size * sqrt(2.0) - 0.012), 9) AS min_clearance,
min(abs(distractor_radius * sin(distractor_angle)) - distractor_size * sqrt(2.0) - 0.012) > 0.01 AS passed FROM factors WHERE distractor_present = 1""")
def clearance_audit(spark, d):
    return P.clearance_audit(_factors(spark, d)).select("n_scenes", R("min_clearance"), "passed")


# ---- ranks and correlation on lineitem ---------------------------------------

ROWS = """rows AS (SELECT l_quantity, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_extendedprice,
 CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0 END AS fa, CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0 END AS fn, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS fr,
 (dayofyear(l_shipdate) + 0.3::DOUBLE) / 367.0::DOUBLE AS hue FROM lineitem)"""
# column number, name, factor, group, expression
AUDIT = [(0, "l_quantity", "l_quantity", "physical", "l_quantity"), (1, "l_discount", "l_discount", "physical", "l_discount"),
         (2, "l_tax", "l_tax", "layout", "l_tax"), (3, "l_linenumber", "l_linenumber", "layout", "l_linenumber"),
         (4, "l_extendedprice", "l_extendedprice", "appearance", "l_extendedprice"), (5, "l_returnflag=A", "l_returnflag", "appearance", "fa"),
         (6, "l_returnflag=N", "l_returnflag", "appearance", "fn"), (7, "l_returnflag=R", "l_returnflag", "appearance", "fr"),
         (8, "l_dayhue", "l_dayhue", "appearance", "hue"), (9, "l_dayhue_sin", "l_dayhue", "appearance", "sin(2 * pi() * hue)"),
         (10, "l_dayhue_cos", "l_dayhue", "appearance", "cos(2 * pi() * hue)")]
RANKED = ROWS + ", ranked AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {e}) + (count(*) OVER (PARTITION BY {e}) - 1) / 2.0 AS r{i}" for i, _, _, _, e in AUDIT) + " FROM rows)"
SPEARMAN = RANKED + ", rho AS (" + " UNION ALL ".join(
    f"SELECT '{a[1]}' AS a, '{b[1]}' AS b, '{a[3]}' AS group_a, '{b[3]}' AS group_b, corr(r{a[0]}, r{b[0]}) AS rho, {str(a[2] != b[2] and a[3] != b[3]).lower()} AS considered, count(*) AS n FROM ranked"
    for a in AUDIT for b in AUDIT if a[0] < b[0]) + ")"


@query("midranks", "WITH " + ROWS + ", m AS (" + " UNION ALL ".join(
    f"SELECT {i} AS col, {e} AS value FROM rows" for i, _, _, _, e in AUDIT) + """), t AS (SELECT col, value, count(*) AS ties FROM m GROUP BY col, value)
SELECT CAST(col AS INT) AS col, round(value, 9) AS value, ties, CAST(sum(ties) OVER (PARTITION BY col ORDER BY value) AS BIGINT) - ties + (ties + 1) / 2.0 AS rank FROM t""")
def midranks(spark, d):
    cols = V.FACTOR_COLUMNS()
    rows = V.factor_rows(spark, d).select(*[c.column.alias(c.name) for c in cols])
    t = D.average_ranks(rows, [c.name for c in cols])
    return t.select(F.col("column").alias("col"), F.round("value", 9).alias("value"), "ties", "rank")


@query("spearman_pairs", f"WITH {SPEARMAN} SELECT a, b, group_a, group_b, round(rho, 6) AS rho, considered FROM rho")
def spearman_pairs(spark, d):
    p = D.audit_pairs(V.factor_rows(spark, d), V.FACTOR_COLUMNS())
    return p.select("a", "b", "group_a", "group_b", (F.round("rho", 6) + 0.0).alias("rho"), "considered")


@query("decorrelation_size", f"""WITH {SPEARMAN} SELECT max(n) AS n_scenes, round(max(abs(rho)) FILTER (considered), 6) AS max_abs_rho, arg_max(a, abs(rho)) FILTER (considered) AS worst_a,
arg_max(b, abs(rho)) FILTER (considered) AS worst_b, count(*) FILTER (considered) AS n_pairs_considered FROM rho""")
def decorrelation_size(spark, d):
    v = D.verdict(D.audit_pairs(V.factor_rows(spark, d), V.FACTOR_COLUMNS()))
    return v.select("n_scenes", R("max_abs_rho", 6), "worst_a", "worst_b", "n_pairs_considered")


@query("decorrelation_gate", f"WITH {tested(SPEARMAN)} {VERDICT}")
def decorrelation_gate(spark, d):
    v = D.verdict(D.audit_pairs(V.factor_rows(spark, d), V.FACTOR_COLUMNS()))
    return v.withColumn("max_abs_rho", F.round("max_abs_rho", 6))


@query("decorrelation_tests", f"WITH {tested(SPEARMAN)} SELECT a, b, round(rho, 6) AS rho, round(p, 6) AS p, round(p_holm, 6) AS p_holm, considered FROM tests")
def decorrelation_tests(spark, d):
    return D.audit_pairs(V.factor_rows(spark, d), V.FACTOR_COLUMNS()).select(
        "a", "b", *[(F.round(c, 6) + 0.0).alias(c) for c in ("rho", "p", "p_holm")], "considered")


@query("correlation_heat_map", f"""WITH {SPEARMAN}, sq AS (SELECT a, b, rho FROM rho UNION ALL SELECT b, a, rho FROM rho UNION ALL {' UNION ALL '.join(f"SELECT '{x[1]}', '{x[1]}', 1.0" for x in AUDIT)})
SELECT a, {', '.join(f"round(max(rho) FILTER (b = '{x[1]}'), 6) AS c{x[0]}" for x in AUDIT)} FROM sq GROUP BY a""")
def correlation_heat_map(spark, d):
    cols = V.FACTOR_COLUMNS()
    names = [c.name for c in cols]
    rho = D.spearman(V.factor_rows(spark, d).select(*[c.column.alias(c.name) for c in cols]), names)
    m = D.heat_map(rho, names)
    return m.select("a", *[(F.round(F.col(f"`{n}`"), 6) + 0.0).alias(f"c{i}") for i, n in enumerate(names)])


def _sampler_sql(source: str = "factors", before: str = "", measured: tuple[str, ...] = ()) -> str:
    """CTE ``rho`` of the 24 factors of ``source``, and of measured columns beside them."""
    groups = {**dict.fromkeys(list(RANGES)[:3], "physical"), **dict.fromkeys(list(RANGES)[3:10], "layout")}
    cols = []
    for n, (kind, *_) in RANGES.items():
        g = groups.get(n, "appearance")
        if kind == "choice":
            cols += [(f"{n}={v}", n, g, f"CAST({n} = '{v}' AS INT)") for v in ("box", "sphere", "cylinder")]
        else:
            cols.append((n, n, g, n))
            if n.endswith("hue"):
                cols += [(f"{n}_sin", n, g, f"sin(2 * pi() * {n})"), (f"{n}_cos", n, g, f"cos(2 * pi() * {n})")]
    cols += [(m, m, "physical", m) for m in measured]
    ranked = ", ".join(f"rank() OVER (ORDER BY {e}) + (count(*) OVER (PARTITION BY {e}) - 1) / 2.0 AS r{i}" for i, (_, _, _, e) in enumerate(cols))
    melted = " UNION ALL ".join(f"SELECT scene_index, {i} AS c, r{i} AS r FROM rk" for i in range(len(cols)))
    names = ", ".join(f"({i}, '{n}', '{f}', '{g}')" for i, (n, f, g, _) in enumerate(cols))
    return f"""{FACTORS}, {before} rk AS (SELECT scene_index, {ranked} FROM {source}), ml AS ({melted}), nm(c, name, factor, grp) AS (VALUES {names}),
cr AS (SELECT x.c AS i, y.c AS j, corr(x.r, y.r) AS rho, count(*) AS n FROM ml x JOIN ml y ON x.scene_index = y.scene_index AND x.c < y.c GROUP BY 1, 2),
rho AS (SELECT p.name AS a, q.name AS b, rho, p.factor <> q.factor AND p.grp <> q.grp AS considered, n FROM cr JOIN nm p ON p.c = i JOIN nm q ON q.c = j)"""


SAMPLER = f"WITH {tested(_sampler_sql())} {VERDICT}"


@query("sampler_gate", SAMPLER)
def sampler_gate(spark, d):
    """All 24 sampled factors, 32 columns, for the scenes of the orders table."""
    v = D.verdict(D.audit_pairs(_factors(spark, d), D.expand_factors(P.FACTORS), "scene_index"))
    return v.withColumn("max_abs_rho", F.round("max_abs_rho", 6))


MEASURED = ("mean_quantity", "mean_price")
DERIVED = _sampler_sql("derived", "m AS (SELECT l_orderkey AS scene_index, avg(l_quantity) AS mean_quantity, avg(l_extendedprice) AS mean_price FROM lineitem GROUP BY 1), derived AS (SELECT * FROM factors JOIN m USING (scene_index)),", MEASURED)


@query("derived_audit", f"""WITH {tested(DERIVED)}, said AS ({VERDICT}) SELECT a, b, round(rho, 6) AS rho, t.considered, round(p_holm, 6) AS p_holm, (SELECT passed FROM said) AS passed FROM tests t WHERE starts_with(b, 'mean_') AND NOT starts_with(a, 'mean_')""")
def derived_audit(spark, d):
    """Advisory: scene means of measured columns against all sampled factors, with the verdict over all pairs."""
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene_index"), F.col("l_quantity").alias("mean_quantity"),
                                              F.col("l_extendedprice").alias("mean_price"))
    joined, extra = D.derived_columns(li, _factors(spark, d), "scene_index", list(MEASURED))
    pairs = D.audit_pairs(joined, D.expand_factors(P.FACTORS) + extra, "scene_index")
    said = D.verdict(pairs).select("passed").scalar()
    mixed = pairs.where(F.col("b").startswith("mean_") & ~F.col("a").startswith("mean_"))
    return mixed.select("a", "b", (F.round("rho", 6) + 0.0).alias("rho"), "considered", (F.round("p_holm", 6) + 0.0).alias("p_holm"), said.alias("passed"))
