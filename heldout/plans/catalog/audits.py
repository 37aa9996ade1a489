"""Integrity and label audits, sources and manifest."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import audit as A, metrics as M
from ...operators.common import cut, parallelism, shared_folder
from ...operators.probes import fit_ridge, linear_scores, with_folds
from ...operators.sampling import sample_factors
from ...operators.splits import scene_split
from ...sources import manifest, tables
from .. import views as V
from .registry import FEATURES, FRAMES, HALVES, PLAIN, PREDICTIONS, query, split, u
from .sampling import DOUBLES, FACTORS, RANGES, SPEARMAN, tested

R6 = lambda c: F.round(F.col(c), 6).alias(c)


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return A.duplicate_keys(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("alignment", """WITH a AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1),
j AS (SELECT coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM a FULL JOIN b USING (doc_id))
SELECT CAST(sum(a) AS BIGINT) AS feature_rows, CAST(sum(b) AS BIGINT) AS target_rows, count(*) FILTER (b = 0) AS features_only, count(*) FILTER (a = 0) AS targets_only,
count(*) FILTER (a <> b) AS unequal_keys, count(*) FILTER (a <> b) = 0 AS passed FROM j""")
def alignment(spark, d):
    return A.correspondence(V.table(spark, d, "documents"), V.table(spark, d, "labels"), ["doc_id"])


@query("first_frames", f"WITH {PLAIN} SELECT scene_index, arg_min(value, event_id) AS value, arg_min(event_type, event_id) AS event_type FROM plain GROUP BY 1")
def first_frames(spark, d):
    return A.first_frames(V.plain_frames(spark, d), "scene_index", "event_id", ["value", "event_type"])


def _missing(spark, d):
    """Order keys below the largest that are absent or were held by one dead shard."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("scene_index"))
    top = o.agg(F.max("scene_index")).first()[0]
    return A.missing_ids(o.where("scene_index % 7 <> 3"), "scene_index", int(top) + 1)


MISSING = """missing AS (SELECT k AS scene_index FROM range((SELECT max(o_orderkey) + 1 FROM orders)) r(k) WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 3))"""


@query("missing_ids", f"WITH {MISSING} SELECT scene_index FROM missing")
def missing_ids(spark, d):
    return _missing(spark, d)


@query("missing_report", f"""WITH {MISSING} SELECT count(*) AS n_missing, array_to_string(list_slice(list(scene_index ORDER BY scene_index), 1, 20), ',') AS examples, greatest(count(*) - 20, 0) AS n_more FROM missing""")
def missing_report(spark, d):
    r = A.missing_report(_missing(spark, d), "scene_index")
    return r.select("n_missing", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"), "n_more")


@query("dead_shard", f"""WITH {MISSING}, g AS (SELECT lead(scene_index) OVER (ORDER BY scene_index) - scene_index AS stride FROM missing),
t AS (SELECT stride, count(*) AS gaps FROM g WHERE stride IS NOT NULL GROUP BY 1 ORDER BY gaps DESC, stride LIMIT 1)
SELECT stride, gaps, n AS n_missing, first % stride AS shard FROM t, (SELECT count(*) AS n, min(scene_index) AS first FROM missing) WHERE n > 2 AND gaps > 0.8 * n""")
def dead_shard(spark, d):
    return A.dead_shard(_missing(spark, d), "scene_index")


@query("unpaired", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unpaired(spark, d):
    return A.unpaired(V.table(spark, d, "documents"), V.table(spark, d, "labels"), "doc_id")


@query("complete_scenes", "SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def complete_scenes(spark, d):
    return tables.complete_scenes(V.table(spark, d, "labels"), V.table(spark, d, "documents").where("lang = 'en'"), "doc_id")


ROLLUP = f"""{PLAIN}, q AS (SELECT scene_index, max(value) > 450 AS distractor_touched, max(value) < 300 AS all_frames_in_frame, max_by(value, event_id) < 10 AS settled_by_end, avg(cls) * 10 AS n_contact_frames,
 CASE WHEN scene_index % 10 = 0 THEN 'nan'::DOUBLE ELSE avg(k / 100) END AS mean_occlusion, CASE WHEN scene_index % 9 = 1 THEN 'x' END AS bad FROM plain GROUP BY 1),
roll AS (SELECT count(*) AS n_found, count(bad) AS unreadable, count(*) FILTER (distractor_touched) AS distractor_touched, count(*) FILTER (all_frames_in_frame) AS all_frames_in_frame, count(*) FILTER (settled_by_end) AS settled_by_end,
 avg(n_contact_frames) AS mean_n_contact_frames, avg(mean_occlusion) FILTER (NOT isnan(mean_occlusion)) AS mean_mean_occlusion, avg(n_contact_frames) / 10 AS contact_positive_rate FROM q)"""


def _rollup(spark, d):
    q = V.plain_frames(spark, d).groupBy("scene_index").agg(
        (F.max("value") > 450).alias("distractor_touched"), (F.max("value") < 300).alias("all_frames_in_frame"),
        (F.max_by("value", "event_id") < 10).alias("settled_by_end"), (F.avg("cls") * 10).alias("n_contact_frames"), F.avg(F.col("k") / 100).alias("o"))
    s = q.withColumn("mean_occlusion", F.when(F.col("scene_index") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("o"))) \
        .withColumn("bad", F.when(F.col("scene_index") % 9 == 1, F.lit("x")))
    return A.quality_rollup(s, ["distractor_touched", "all_frames_in_frame", "settled_by_end"], ["n_contact_frames", "mean_occlusion"], "bad")


@query("quality_rollup", f"""WITH {ROLLUP} SELECT n_found, unreadable, distractor_touched, all_frames_in_frame, settled_by_end, round(mean_n_contact_frames, 6) AS mean_n_contact_frames,
round(mean_mean_occlusion, 6) AS mean_mean_occlusion, round(contact_positive_rate, 6) AS contact_positive_rate FROM roll""")
def quality_rollup(spark, d):
    r = _rollup(spark, d)
    return r.select(*[R6(c) if k == "double" else c for c, k in r.dtypes])


@query("rule_problems", f"""WITH {ROLLUP} SELECT rule, violated FROM roll, LATERAL (SELECT unnest(['no_scenes', 'scenes_missing', 'scenes_unpaired', 'distractor_touched', 'left_the_frame', 'contact_rate_outside_band', 'unreadable_records']) AS rule,
unnest([n_found = 0, (SELECT max(scene_index) + 1 - count(*) FROM q) > 0, (SELECT count(*) FROM q WHERE scene_index NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 3)) > 0, distractor_touched > 0, all_frames_in_frame < n_found - unreadable, contact_positive_rate NOT BETWEEN 0.25 AND 0.55, unreadable > 0]) AS violated)""")
def rule_problems(spark, d):
    scenes = V.plain_frames(spark, d).select("scene_index").distinct()
    last = scenes.agg(F.max("scene_index")).first()[0]
    partner = V.table(spark, d, "customer").where("c_custkey % 7 <> 3").select(F.col("c_custkey").alias("scene_index"))
    report = A.completeness(_rollup(spark, d), A.missing_ids(scenes, "scene_index", last + 1), A.unpaired(scenes, partner, "scene_index"))
    return A.rule_problems(report, A.corpus_rules())


@query("label_checks", f"""WITH {PLAIN} SELECT 'cls_rate' AS name, round(avg(cls), 6) AS value, avg(cls) BETWEEN 0.25 AND 0.55 AS passed FROM plain
UNION ALL SELECT 'cls_not_constant', round(avg(cls), 6), avg(cls) > 0 AND avg(cls) < 1 FROM plain UNION ALL SELECT 'all_targets_finite', 0.0, true FROM (SELECT count(*) AS n FROM plain WHERE isnan(value) OR isinf(value) OR value IS NULL) WHERE n = 0""")
def label_checks(spark, d):
    f = V.plain_frames(spark, d)
    checks = A.rate_band(f, "cls", 0.25, 0.55).unionByName(A.not_constant(f, "cls")).unionByName(A.finite_checks(f))
    return checks.select("name", R6("value"), "passed")


@query("finite_check", f"""WITH {PLAIN} SELECT 'finite:ratio' AS name, CAST(count(*) FILTER (k = 0) AS DOUBLE) AS value, false AS passed FROM plain
UNION ALL SELECT 'finite:gap', CAST(count(*) FILTER (k < 3) AS DOUBLE), false FROM plain""")
def finite_check(spark, d):
    f = V.plain_frames(spark, d)
    f = f.select("value", F.when(F.col("k") == 0, F.lit(float("inf"))).otherwise(F.col("value") / F.col("k")).alias("ratio"),
                 F.when(F.col("k") < 3, F.lit(float("nan"))).otherwise(F.col("k")).alias("gap"))
    return A.finite_checks(f)


def ks_sql(table: str, column: str, cdf: str) -> str:
    return f"""WITH v AS (SELECT {column} AS v, count(*) AS t FROM {table} GROUP BY 1), r AS (SELECT v, t, sum(t) OVER (ORDER BY v) AS c, sum(t) OVER () AS n, {cdf} AS f FROM v)
SELECT round(max(greatest(c / n - f, f - (c - t) / n)), 6) AS statistic, CAST(max(n) AS BIGINT) AS n FROM r"""


@query("ks_statistic", ks_sql("customer", "c_acctbal", "greatest(0, least(1, (v + 999.99) / 10999.98))"))
def ks_statistic(spark, d):
    c = V.table(spark, d, "customer")
    return A.ks_statistic(c, "c_acctbal", lambda x: A.uniform_cdf(x, -999.99, 9999.99)).select(R6("statistic"), "n")


@query("ks_log_uniform", ks_sql("orders", "o_totalprice", "greatest(0, least(1, (ln(greatest(v, 1e-12)) - ln(1000)) / (ln(500000) - ln(1000))))"))
def ks_log_uniform(spark, d):
    o = V.table(spark, d, "orders")
    return A.ks_statistic(o, "o_totalprice", lambda x: A.log_uniform_cdf(x, 1000.0, 500000.0)).select(R6("statistic"), "n")


@query("label_gate")
def label_gate(spark, d):
    f = V.plain_frames(spark, d).drop("ts", "event_type")
    f = f.join(sample_factors(f.select("scene_index").distinct(), "scene_index", 0).select("scene_index", "mass", "friction_slide"), "scene_index")
    return A.label_gate(f, "scene_index", "event_id", "cls", "cls", {
        "mass": lambda x: A.log_uniform_cdf(x, 0.05, 2.0), "friction_slide": lambda x: A.uniform_cdf(x, 0.05, 1.2)})


@query("precision_audit")
def precision_audit(spark, d):
    """Probe R2 on the same vectors at single and at half precision."""
    rows = with_folds(V.features(spark, d), "scene_index", [0])
    out = []
    for name, x in (("float32", F.col("x")), ("float16", A.half_precision(F.col("x")))):
        own = rows.withColumn("x", x)
        fit = fit_ridge(own, "x", ["label", "cls"], [0])
        test = own.where(F.col("folds")[0] < 0).withColumn("p", linear_scores(F.col("x"), fit))
        scores = [M.r2(test.withColumn("p1", F.col("p")[i]), [], t, "p1").select(F.lit(name).alias("precision"), F.lit(t).alias("target"), "value")
                  for i, t in enumerate(("label", "cls"))]
        out += scores
    both = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    mean = both.groupBy("precision").agg(F.avg("value").alias("v"))
    return mean.agg(F.max(F.when(F.col("precision") == "float32", F.col("v"))).alias("r2_float32"),
                    F.max(F.when(F.col("precision") == "float16", F.col("v"))).alias("r2_float16")) \
        .withColumn("abs_difference", F.abs(F.col("r2_float32") - F.col("r2_float16"))).withColumn("passed", F.col("abs_difference") < 0.01)


@query("gate_verdicts", f"""WITH {PLAIN}, c AS (SELECT 's' || scene_index AS gate, CASE WHEN k = 0 THEN NULL ELSE value < 250 END AS passed FROM plain)
SELECT gate, count(*) AS n_checks, CASE WHEN count(*) FILTER (passed = false) > 0 THEN false WHEN count(*) FILTER (passed IS NULL) > 0 THEN NULL ELSE true END AS passed,
CASE WHEN count(*) FILTER (passed = false) > 0 THEN 'fail' WHEN count(*) FILTER (passed IS NULL) > 0 THEN 'needs human' ELSE 'pass' END AS verdict FROM c GROUP BY gate""")
def gate_verdicts(spark, d):
    c = V.plain_frames(spark, d).select(F.concat(F.lit("s"), F.col("scene_index").cast("string")).alias("gate"),
                                        F.when(F.col("k") == 0, F.lit(None).cast("boolean")).otherwise(F.col("value") < 250).alias("passed"))
    return A.gate_verdicts(c)


@query("review_sample", f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_index ORDER BY {u("'5|review'", 'scene_index', 'frame_index')}, scene_index, frame_index) AS rn, {u("5", "'review'", 'scene_index', 'frame_index')} AS uu FROM frames)
SELECT scene_index, frame_index, printf('s%05d f%d %s', scene_index, frame_index, event_type) AS caption FROM r WHERE rn <= 2 ORDER BY uu, scene_index, frame_index LIMIT 20""")
def review_sample(spark, d):
    r = A.review_sample(V.frames(spark, d), "scene_index", "frame_index", 20, 2, 5)
    return r.select("scene_index", "frame_index", F.format_string("s%05d f%d %s", "scene_index", "frame_index", "event_type").alias("caption"))


@query("pair_equality", f"""WITH {HALVES}, j AS (SELECT a.event_type AS e1, b.event_type AS e2, a.cls AS c1, b.cls AS c2 FROM base_half a JOIN other_half b USING (scene_index, frame_index))
SELECT 'event_type' AS factor, count(*) AS n_pairs, count(*) FILTER (e1 IS DISTINCT FROM e2) AS n_unequal, 0::BIGINT AS n_one_sided, count(*) FILTER (e1 IS DISTINCT FROM e2) = 0 AS passed FROM j
UNION ALL SELECT 'cls', count(*), count(*) FILTER (c1 IS DISTINCT FROM c2), 0, count(*) FILTER (c1 IS DISTINCT FROM c2) = 0 FROM j""")
def pair_equality(spark, d):
    a, b = V.halves(spark, d)
    return A.pair_equality(a, b, ["scene_index", "frame_index"], ["event_type", "cls"])


@query("pair_divergence", f"""WITH {HALVES} SELECT scene_index, count(*) AS n_rows, round(max(greatest(abs(a.value - b.value), abs(a.k - b.k))), 6) AS max_divergence, 0::BIGINT AS n_uncompared,
max(greatest(abs(a.value - b.value), abs(a.k - b.k))) > 300 AS diverged FROM base_half a JOIN other_half b USING (scene_index, frame_index) GROUP BY scene_index""")
def pair_divergence(spark, d):
    a, b = V.halves(spark, d)
    out = A.divergence(a, b, ["scene_index", "frame_index"], ["value", "k"], "scene_index", 300.0)
    return out.select("scene_index", "n_rows", R6("max_divergence"), "n_uncompared", "diverged")


NUMERIC = [n for n in RANGES if n in DOUBLES]


NAMED = [n for n in RANGES if n not in DOUBLES]


def _determinism(again: str) -> str:
    gap = "greatest(0, " + ", ".join(f"abs(a.{c} - b.{c})" for c in NUMERIC) + ")"
    pair = "a.scene_index IS NOT NULL AND b.scene_index IS NOT NULL"
    other = " + ".join([*[f"CAST((a.{c} IS NULL) <> (b.{c} IS NULL) AS INT)" for c in NUMERIC], *[f"CAST(a.{c} IS DISTINCT FROM b.{c} AS INT)" for c in NAMED]])
    return f"""(SELECT *, one_sided = 0 AND n_unequal = 0 AND n > 0 AND max_difference <= 1e-6 AS passed FROM (SELECT count(*) FILTER (NOT ({pair})) AS one_sided, CAST(max({gap}) FILTER ({pair}) AS DOUBLE) AS max_difference,
CAST(coalesce(sum({other}) FILTER ({pair}), 0) AS BIGINT) AS n_unequal, count(*) FILTER ({pair}) AS n FROM factors a FULL JOIN {again} b ON a.scene_index = b.scene_index))"""


DETERMINISM = "one_sided, round(max_difference, 9) AS max_difference, n_unequal, passed"


def _compared(first, again):
    return A.determinism(first, again, ["scene_index"], NUMERIC, exact=NAMED).select("one_sided", F.round("max_difference", 9).alias("max_difference"), "n_unequal", "passed")


def moved(rows, key):
    """The same rows in other tasks and another order, evenly: tasks grow with the shuffle partitions."""
    return rows.repartition(parallelism(rows.sparkSession) + 1, F.xxhash64(key))


@query("determinism", f"WITH {FACTORS} SELECT {DETERMINISM} FROM {_determinism('factors')}")
def determinism(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey").distinct()
    again = sample_factors(moved(o, "o_orderkey"), "o_orderkey", 0)
    return _compared(sample_factors(o, "o_orderkey", 0), again)


@query("determinism_broken", f"""WITH {FACTORS}, again AS (SELECT * REPLACE (CASE WHEN scene_index % 97 = 0 THEN mass + 0.5 WHEN scene_index % 89 = 0 THEN NULL ELSE mass END AS mass) FROM factors WHERE scene_index % 101 <> 0)
SELECT {DETERMINISM} FROM {_determinism('again')}""")
def determinism_broken(spark, d):
    """The same check where some scenes are missing from the second run, some have another mass and some none."""
    o = V.table(spark, d, "orders").select("o_orderkey").distinct()
    first = cut(sample_factors(moved(o, "o_orderkey"), "o_orderkey", 0))
    key = F.col("scene_index")
    mass = F.when(key % 97 == 0, F.col("mass") + 0.5).when(key % 89 == 0, F.lit(None).cast("double")).otherwise(F.col("mass"))
    return _compared(first, first.where(key % 101 != 0).withColumn("mass", mass))


@query("determinism_nulls", f"""WITH {FACTORS}, again AS (SELECT * REPLACE (CASE WHEN scene_index % 89 = 0 THEN NULL ELSE mass END AS mass) FROM factors) SELECT {DETERMINISM} FROM {_determinism('again')}""")
def determinism_nulls(spark, d):
    """The same check where the only fault is a value turned null."""
    first = cut(sample_factors(moved(V.table(spark, d, "orders").select("o_orderkey").distinct(), "o_orderkey"), "o_orderkey", 0))
    return _compared(first, first.withColumn("mass", F.when(F.col("scene_index") % 89 != 0, F.col("mass"))))


@query("applied_equals_sampled", """WITH j AS (SELECT abs(p_retailprice - r) AS gap FROM part FULL JOIN (SELECT l_partkey AS p_partkey, min(l_extendedprice / l_quantity) AS r FROM lineitem GROUP BY 1) USING (p_partkey))
SELECT count(*) AS n_scenes, round(max(gap), 6) AS max_difference, count(*) FILTER (gap > 1e-6) AS n_wrong, count(*) FILTER (gap IS NULL) AS n_missing,
count(*) FILTER (gap > 1e-6) = 0 AND count(*) FILTER (gap IS NULL) = 0 AS passed FROM j""")
def applied_equals_sampled(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    r = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return A.applied_equals_sampled(p, r, "p_partkey", "price").select("n_scenes", R6("max_difference"), "n_wrong", "n_missing", "passed")


@query("applied_broken", """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'nan'::DOUBLE ELSE p_retailprice END AS a FROM part),
r AS (SELECT p_partkey, CASE WHEN p_partkey % 19 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS b FROM part WHERE p_partkey % 23 <> 0),
j AS (SELECT abs(a - b) AS gap FROM s FULL JOIN r USING (p_partkey))
SELECT count(*) AS n_scenes, round(max(gap) FILTER (NOT isnan(gap)), 6) AS max_difference, count(*) FILTER (gap > 1e-6 AND NOT isnan(gap)) AS n_wrong, count(*) FILTER (gap IS NULL OR isnan(gap)) AS n_missing, false AS passed FROM j""")
def applied_broken(spark, d):
    """The same check with missing records, null and NaN values and wrong ones."""
    p, key = V.table(spark, d, "part"), F.col("p_partkey")
    s = p.select("p_partkey", F.when(key % 13 == 0, F.lit(None).cast("double")).when(key % 17 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("price"))
    r = p.where(key % 23 != 0).select("p_partkey", F.when(key % 19 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")).alias("price"))
    return A.applied_equals_sampled(s, r, "p_partkey", "price").select("n_scenes", R6("max_difference"), "n_wrong", "n_missing", "passed")


WHOLE = PLAIN + f""",
hh AS (SELECT *, ts < TIMESTAMP '{V.HALF_MONTH}' AS early, row_number() OVER (PARTITION BY scene_index, ts < TIMESTAMP '{V.HALF_MONTH}' ORDER BY ts, event_id) - 1 AS frame_index FROM plain),
wj AS (SELECT coalesce(a.scene_index, b.scene_index) AS scene_index, a.value AS v1, b.value AS v2, a.event_type AS e1, b.event_type AS e2, a.scene_index IS NOT NULL AND b.scene_index IS NOT NULL AS pair
 FROM (SELECT * FROM hh WHERE early) a FULL JOIN (SELECT * FROM hh WHERE NOT early) b ON a.scene_index = b.scene_index AND a.frame_index = b.frame_index)"""


@query("pair_equality_whole", f"""WITH {WHOLE} SELECT 'event_type' AS factor, count(*) FILTER (pair) AS n_pairs, count(*) FILTER (pair AND e1 IS DISTINCT FROM e2) AS n_unequal, count(*) FILTER (NOT pair) AS n_one_sided,
count(*) FILTER (pair) > 0 AND count(*) FILTER (pair AND e1 IS DISTINCT FROM e2) = 0 AND count(*) FILTER (NOT pair) = 0 AS passed FROM wj""")
def pair_equality_whole(spark, d):
    """Both halves as they are: frames without a partner are counted, not cut away."""
    a, b = V.whole_halves(spark, d)
    return A.pair_equality(a, b, ["scene_index", "frame_index"], ["event_type"])


@query("pair_divergence_whole", f"""WITH {WHOLE} SELECT scene_index, count(*) AS n_rows, round(max(abs(v1 - v2)), 6) AS max_divergence, count(*) FILTER (v1 - v2 IS NULL) AS n_uncompared,
count(*) FILTER (v1 - v2 IS NULL) > 0 OR max(abs(v1 - v2)) > 300 AS diverged FROM wj GROUP BY scene_index""")
def pair_divergence_whole(spark, d):
    a, b = V.whole_halves(spark, d)
    out = A.divergence(a, b, ["scene_index", "frame_index"], ["value"], "scene_index", 300.0)
    return out.select("scene_index", "n_rows", R6("max_divergence"), "n_uncompared", "diverged")


# ---- sources and manifest -----------------------------------------------------

HASHED = """units AS (SELECT o_orderkey AS unit, substr(sha256('{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'), 1, 12) AS config_hash, CAST(round(o_totalprice * 100) AS BIGINT) AS size, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"""


def _units(spark, d):
    o = V.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("unit"), tables.row_hash("o_orderpriority", "o_orderstatus").alias("config_hash"),
                    F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


@query("config_hash", f"WITH {HASHED} SELECT config_hash, count(*) AS n FROM units GROUP BY 1")
def config_hash(spark, d):
    return _units(spark, d).groupBy("config_hash").agg(F.count(F.lit(1)).alias("n"))


@query("manifest_pending", f"""WITH {HASHED}, m AS (SELECT unit, CASE WHEN priority = '1-URGENT' THEN 'stale' ELSE config_hash END AS config_hash, CASE WHEN size > 40000000 THEN size + 1 ELSE size END AS size FROM units WHERE status <> 'O')
SELECT u.unit, u.config_hash FROM units u LEFT JOIN m ON m.unit = u.unit AND m.config_hash = u.config_hash AND m.size = u.size WHERE m.unit IS NULL""")
def manifest_pending(spark, d):
    units = _units(spark, d)
    held = units.where("status <> 'O'").select(
        "unit", F.when(F.col("priority") == "1-URGENT", F.lit("stale")).otherwise(F.col("config_hash")).alias("config_hash"),
        F.when(F.col("size") > 40_000_000, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return manifest.pending(units, held, ["unit"]).select("unit", "config_hash")


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_features", f"WITH {FEATURES} SELECT scene_index, frame_index, CAST(x[1] AS DOUBLE) AS x1, CAST(x[64] AS DOUBLE) AS x64 FROM features")
def scan_features(spark, d):
    path = _scratch(spark, "features")
    f = V.features(spark, d).select("scene_index", "frame_index", "x")
    cell = lambda layer, x: f.select(F.lit("embed").alias("encoder"), F.lit("base").alias("condition"), F.lit(layer).alias("layer"),
                                     F.lit("mean").alias("view"), "scene_index", "frame_index", x.alias("x"))
    tables.write_features(cell(8, F.col("x")).unionByName(cell(2, F.reverse("x"))), path)
    back = tables.features(spark, path, "embed", "base", 8, "mean")
    return back.select("scene_index", "frame_index", F.col("x")[0].alias("x1"), F.col("x")[63].alias("x64"))


@query("scan_patches", f"WITH {FEATURES} SELECT scene_index, frame_index, CAST(p AS INT) AS patch_index, round(CAST(x[p * 16 + 1] AS DOUBLE), 6) AS x1 FROM features, range(4) r(p)")
def scan_patches(spark, d):
    path = _scratch(spark, "patches")
    pieces = [F.struct(F.lit(p).alias("patch_index"), F.slice("x", p * 16 + 1, 16).alias("x")) for p in range(4)]
    f = V.features(spark, d).select(F.lit("embed").alias("encoder"), F.lit("base").alias("condition"), F.lit(8).alias("layer"),
                                    "scene_index", "frame_index", F.explode(F.array(*pieces)).alias("p")).select("encoder", "condition", "layer", "scene_index", "frame_index", "p.*")
    f.write.partitionBy("encoder", "condition", "layer").parquet(path)
    return tables.patches(spark, path, "embed", "base", 8).select("scene_index", "frame_index", "patch_index", F.round(F.col("x")[0], 6).alias("x1"))


@query("scan_targets", f"WITH {HALVES}, {split('plain', 1)} SELECT scene_index, frame_index, value FROM base_half WHERE scene_index IN (SELECT scene_index FROM split WHERE NOT is_train)")
def scan_targets(spark, d):
    a, b = V.halves(spark, d)
    path = _scratch(spark, "targets")
    rows = a.withColumn("condition", F.lit("base")).unionByName(b.withColumn("condition", F.lit("occluded")))
    rows.withColumn("phase", F.lit("approach")).write.partitionBy("condition").parquet(path)
    wanted = scene_split(V.plain_frames(spark, d), "scene_index", 1).where("not is_train")
    return tables.targets(spark, path, "base", wanted).select("scene_index", "frame_index", "value")


@query("scan_predictions", f"WITH {PREDICTIONS} SELECT seed, target, count(*) AS n_rows, round(sum(y_true), 2) AS total FROM predictions GROUP BY 1, 2")
def scan_predictions(spark, d):
    """Writes both seeds, replaces one of them, reads the experiment back."""
    p = cut(V.predictions(spark, d))
    path = _scratch(spark, "predictions")
    tables.write_predictions(p.withColumn("y_true", F.when(F.col("seed") == 1, F.lit(-1.0)).otherwise(F.col("y_true"))), path)
    tables.write_predictions(p.where("seed = 1"), path)
    back = tables.predictions(spark, path, "D", [0, 1])
    return back.groupBy("seed", "target").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("y_true"), 2).alias("total"))


@query("scan_scene_json", f"WITH {PLAIN} SELECT count(DISTINCT scene_index) AS n_found, count(DISTINCT scene_index) FILTER (scene_index % 9 = 1) AS unreadable, count(DISTINCT scene_index) FILTER (scene_index % 9 <> 1 AND scene_index % 2 = 0) AS settled_by_end FROM plain")
def scan_scene_json(spark, d):
    path = _scratch(spark, "scenes")
    s = V.plain_frames(spark, d).select("scene_index").distinct()
    text = F.to_json(F.struct("scene_index", F.struct((F.col("scene_index") % 2 == 0).alias("settled_by_end")).alias("quality")))
    s.select(F.when(F.col("scene_index") % 9 == 1, F.lit("{broken")).otherwise(text).alias("value")).write.text(path)
    r = tables.scene_records(spark, path).select("scene_index", "unreadable", "quality.settled_by_end")
    return A.quality_rollup(r, ["settled_by_end"], [], "unreadable").select("n_found", "unreadable", "settled_by_end")


@query("csv_summary", f"WITH {PLAIN} SELECT event_type, count(*) AS n_rows, CASE WHEN event_type <> 'view' THEN round(max(value), 6) END AS majority_rate FROM plain GROUP BY 1")
def csv_summary(spark, d):
    path = _scratch(spark, "csv")
    s = V.plain_frames(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.max("value").alias("m"))
    s = s.select("event_type", "n_rows", F.when(F.col("event_type") != "view", F.round("m", 6)).alias("majority_rate"))
    tables.write_csv(s, path)
    return spark.read.schema("event_type string, n_rows long, majority_rate double").csv(path, header=True)


@query("json_report", f"""WITH {PLAIN} SELECT '{{"event_type":"' || event_type || '","n_rows":' || count(*) || ',"n_scenes":' || count(DISTINCT scene_index) || '}}' AS value FROM plain GROUP BY event_type""")
def json_report(spark, d):
    s = V.plain_frames(spark, d).groupBy("event_type").agg(F.countDistinct("scene_index").alias("n_scenes"), F.count(F.lit(1)).alias("n_rows"))
    return tables.json_rows(s)


@query("pair_csv", f"WITH {tested(SPEARMAN)} SELECT a, b, group_a, group_b, printf('%.6f', rho) AS rho, format('{{:.6g}}', p_holm) AS p_holm, CAST(considered AS INT) AS considered FROM tests")
def pair_csv(spark, d):
    from ...operators import decorrelation as D
    return tables.pair_lines(D.audit_pairs(V.factor_rows(spark, d), V.FACTOR_COLUMNS()))
