import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heldout.functions import pvalues
from heldout.functions.pvalues import fisher_z_p, kolmogorov_p, two_sided_normal
from heldout.operators import audit as A, decorrelation as D
from heldout.operators.sampling import FACTORS, factor_table
from heldout.sources import tables


def test_duplicates_and_correspondence(spark):
    a = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (0, 1)], "s int, f int")
    assert [tuple(r) for r in A.duplicate_keys(a, ["s", "f"]).collect()] == [(0, 1, 2)]
    with pytest.raises(RuntimeError, match="duplicate"):
        A.refuse_duplicates(a, ["s", "f"])
    b = a.dropDuplicates()
    assert A.correspondence(b, b, ["s", "f"]).first().passed
    r = A.correspondence(b, b.where("s = 0"), ["s", "f"]).first()
    assert not r.passed and r.features_only == 1 and r.targets_only == 0


def test_dead_shard(spark):
    found = spark.range(200).where("id % 8 <> 5").withColumnRenamed("id", "k")
    missing = A.missing_ids(found, "k", 200)
    r = A.dead_shard(missing, "k").first()
    assert (r.stride, r.shard, r.n_missing) == (8, 5, 25)
    rep = A.missing_report(missing, "k", 3).first()
    assert (rep.n_missing, list(rep.examples), rep.n_more) == (25, [5, 13, 21], 22)
    assert A.dead_shard(A.missing_ids(found.where("k < 190"), "k", 12), "k").count() == 0


def test_ks(spark):
    rng = np.random.default_rng(0)
    v = rng.random(400)
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    r = A.ks_statistic(df, "v", lambda x: A.uniform_cdf(x, 0.0, 1.0)).first()
    s, i = np.sort(v), np.arange(1, 401)
    assert r.statistic == pytest.approx(max((i / 400 - s).max(), (s - (i - 1) / 400).max())) and r.n == 400
    assert A.ks_check(df, "v", lambda x: A.uniform_cdf(x, 0.0, 1.0), "v").first().passed
    assert not A.ks_check(df, "v", lambda x: A.uniform_cdf(x, 0.0, 1.3), "v").first().passed


def test_kolmogorov_tail():
    # n = 1: P(D >= d) = 2 (1 - d) for d >= 1/2; n = 2, 1/2 <= d: 2 (1 - d)^2
    assert kolmogorov_p(0.7, 1) == pytest.approx(0.6)
    assert kolmogorov_p(0.7, 2) == pytest.approx(0.18)
    assert kolmogorov_p(0.274, 10) == pytest.approx(1 - 0.6284796154565, abs=1e-6)    # published value of the exact method
    assert kolmogorov_p(1.3581 / math.sqrt(10000), 10000, "limit") == pytest.approx(0.05, abs=2e-3)
    for n in (500, 5000, 20000):                                # the methods agree where one hands over to the next
        assert kolmogorov_p(2.0 / math.sqrt(n), n) == pytest.approx(1 - pvalues._exact_cdf(2.0 / math.sqrt(n), n), abs=1e-10)
    for x in (0.5, 0.8, 1.0, 1.3, 1.9):
        assert kolmogorov_p(x / math.sqrt(20001), 20001) == pytest.approx(kolmogorov_p(x / math.sqrt(20000), 20000), abs=2e-6)
        assert 1 - pvalues._pelz_good(x / math.sqrt(20000), 20000) == pytest.approx(kolmogorov_p(x / math.sqrt(20000), 20000), abs=1e-8)
        assert kolmogorov_p(x / 1000, 10**6) == pytest.approx(kolmogorov_p(x / 1000, 10**6, "limit"), abs=1e-3)
    assert kolmogorov_p(0.04, 500) == pytest.approx(kolmogorov_p(0.04, 500, "limit"), abs=0.01)
    with pytest.raises(ValueError):
        kolmogorov_p(0.1, 10, "auto")


def test_normal_tails(spark):
    r = spark.createDataFrame([(0.0, 100), (0.3, 100), (1.0, 100), (0.9, 3)], "rho double, n int").select(
        fisher_z_p(F.col("rho"), F.col("n")).alias("p"), two_sided_normal(F.lit(1.959964)).alias("q")).collect()
    z = math.atanh(0.3) * math.sqrt(97 / 1.06)
    assert [x.p for x in r] == pytest.approx([1.0, math.erfc(z / math.sqrt(2)), 0.0, 1.0], abs=1e-12)
    assert r[0].q == pytest.approx(0.05, abs=1e-6)


def test_finite_and_three_valued_gates(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1), (float("nan"), 3.0, 2), (float("inf"), 4.0, None)], "a double, b double, c int")
    assert {(r.name, r.value, r.passed) for r in A.finite_checks(df).collect()} == {("finite:a", 2.0, False), ("finite:c", 1.0, False)}
    assert [tuple(r) for r in A.finite_checks(df, ["b"]).collect()] == [("all_targets_finite", 0.0, True)]
    g = spark.createDataFrame([("x", True), ("x", None), ("y", False), ("y", None), ("z", True)], "gate string, passed boolean")
    assert {r.gate: (r.passed, r.verdict) for r in A.gate_verdicts(g).collect()} == {"x": (None, "needs human"), "y": (False, "fail"), "z": (True, "pass")}


def test_rollup_skips_nan_and_counts_corrupt_json(spark, tmp_path):
    lines = ['{"scene_id":"base_00000","scene_index":0,"quality":{"n_contact_frames":4,"settled_by_end":true,"distractor_touched":false,"all_frames_in_frame":true,"mean_occlusion":0.5}}',
             '{"scene_id": broken', '{"scene_id":"base_00002","scene_index":2,"quality":{"n_contact_frames":6,"settled_by_end":false,"distractor_touched":true,"all_frames_in_frame":true}}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    r = tables.scene_records(spark, str(tmp_path)).select("unreadable", "quality.*").cache()
    q = A.quality_rollup(r, ["distractor_touched", "all_frames_in_frame", "settled_by_end"], ["n_contact_frames", "mean_occlusion"], "unreadable")
    v = q.first()
    assert (v.n_found, v.unreadable, v.settled_by_end, v.mean_mean_occlusion, v.contact_positive_rate) == (3, 1, 1, 0.5, 0.5)
    p = {x.rule: x.violated for x in A.rule_problems(q, A.corpus_rules()).collect()}
    assert p == {"no_scenes": False, "scenes_missing": False, "scenes_unpaired": False, "distractor_touched": True, "left_the_frame": False, "contact_rate_outside_band": False, "unreadable_records": True}


def test_half_precision(spark):
    v = np.random.default_rng(0).normal(size=(20, 5))
    df = spark.createDataFrame([([float(a) for a in r],) for r in v], "x array<double>").coalesce(1)
    got = np.array([r.h for r in df.select(A.half_precision(F.col("x")).alias("h")).collect()])
    assert np.array_equal(got, v.astype(np.float32).astype(np.float16).astype(float))


def test_review_sample_limits(spark):
    f = spark.createDataFrame([(s, i) for s in range(30) for i in range(10)], "scene long, frame long")
    r = A.review_sample(f, "scene", "frame", 20, 2, 1).toPandas()
    assert len(r) == 20 and r.groupby("scene").size().max() <= 2
    assert len(A.review_sample(f.where("scene < 4"), "scene", "frame", 20, 2, 1).collect()) == 8


def np_ranks(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


@pytest.mark.parametrize("key", [None, "id"])
def test_spearman_with_ties_and_constants(spark, key):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 5))
    m[:, 1] = np.round(m[:, 0] + 0.5 * m[:, 1])
    m[:, 4] = 2.0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id long, a double, b double, c double, d double, e double")
    got = {(r.i, r.j): r.rho for r in D.spearman(df, list("abcde"), key).collect()}
    rk = np.array([np_ranks(m[:, k]) for k in range(5)])
    for i in range(5):
        for j in range(i, 5):
            want = 1.0 if i == j else 0.0 if 4 in (i, j) else np.corrcoef(rk[i], rk[j])[0, 1]
            assert got[(i, j)] == pytest.approx(want, abs=1e-10)


def test_gate_on_the_sampler(spark):
    cols = D.expand_factors(FACTORS)
    assert len(cols) == 32
    big = D.audit_pairs(factor_table(spark, 3000, 0), cols, "scene_index").cache()
    assert big.count() == 496 and big.where("considered").count() == 241
    v = D.verdict(big).first()
    assert v.passed and v.n_scenes == 3000 and v.n_significant_after_holm == 0
    small = D.verdict(D.audit_pairs(factor_table(spark, 50, 0), cols, "scene_index")).first()
    assert not small.passed and small.max_abs_rho > 0.10 and small.n_significant_after_holm == 0


def test_gate_catches_a_leak(spark):
    t = factor_table(spark, 1500, 0).withColumn("mass", F.col("obj_size") * 20)
    v = D.verdict(D.audit_pairs(t, D.expand_factors(FACTORS[:1] + FACTORS[10:11]), "scene_index")).first()
    assert not v.passed and {v.worst_a, v.worst_b} == {"mass", "obj_size"} and v.max_abs_rho > 0.99


def test_pair_lines_and_hash(spark):
    df = spark.createDataFrame([("a", "b", "x", "y", 0.1234567, 1.0, True), ("a", "c", "x", "x", -0.5, 0.000123456789, False), ("a", "d", "x", "x", 0.0, 1.23456789e-7, True),
                                ("a", "e", "x", "y", 0.25, 0.5, True)], "a string, b string, group_a string, group_b string, rho double, p_holm double, considered boolean")
    r = tables.pair_lines(df).collect()
    assert [(x.rho, x.p_holm, x.considered) for x in r] == [(f"{a:.6f}", f"{p:.6g}", c) for a, p, c in
            [(0.1234567, 1.0, 1), (-0.5, 0.000123456789, 0), (0.0, 1.23456789e-7, 1), (0.25, 0.5, 1)]]
    assert tables.config_hash({"a": 1, "b": [np.float64(2.0)]}) == tables.config_hash({"b": [2.0], "a": np.int64(1)})
    assert tables.config_hash({"a": 1}) != tables.config_hash({"a": 2})
    with pytest.raises(TypeError):
        tables.config_hash({"a": object()})


def test_applied_check_fails_on_missing_null_and_nan(spark):
    s = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id long, v double")
    for rows in ([(1, 1.0)], [(1, 1.0), (2, None), (3, 3.0)], [(1, 1.0), (2, float("nan")), (3, 3.0)], []):
        got = A.applied_equals_sampled(s, spark.createDataFrame(rows, "id long, v double"), "id", "v").first()
        assert not got.passed and got.n_missing > 0 and got.n_wrong == 0
    assert A.applied_equals_sampled(s, s, "id", "v").first().passed


def test_pair_audits_count_rows_without_a_partner(spark):
    a = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0)], "scene long, frame int, v double")
    got = A.pair_equality(a, a.where("frame = 0"), ["scene", "frame"], ["v"]).first()
    assert (got.n_pairs, got.n_unequal, got.n_one_sided, got.passed) == (1, 0, 1, False)
    got = A.divergence(a, a.where("frame = 0"), ["scene", "frame"], ["v"], "scene", 1.0).first()
    assert (got.max_divergence, got.n_uncompared, got.diverged) == (0.0, 1, True)


def test_empty_corpus_is_a_problem(spark):
    roll = A.quality_rollup(spark.createDataFrame([], "distractor_touched boolean, all_frames_in_frame boolean, n_contact_frames double"), ["distractor_touched", "all_frames_in_frame"], ["n_contact_frames"])
    found = {r.rule: r.violated for r in A.rule_problems(A.completeness(roll), A.corpus_rules()).collect()}
    assert found["no_scenes"] and not found["scenes_missing"]


def test_spearman_leaves_out_nulls(spark):
    rows = [(float(i), float(i * i)) for i in range(40)] + [(None, 1.0), (2.0, None), (float("nan"), 3.0)]
    got = {(r.i, r.j): r for r in D.spearman(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    assert got[(0, 1)].rho == pytest.approx(1.0) and got[(0, 1)].n == 40


def test_ranks_by_ranges_with_heavy_values(spark, monkeypatch):
    """Ranges are small however many rows there are, heavy values do not travel, and rows of one key all count."""
    for name, size in (("BLOCK_ROWS", 256), ("RANGE_ROWS", 100), ("PART_CELLS", 500)):
        monkeypatch.setattr(D, name, size)
    rng = np.random.default_rng(5)
    m = np.column_stack([rng.normal(size=3000), rng.integers(0, 2, 3000), rng.integers(0, 40, 3000), np.where(rng.random(3000) < 0.7, 0.0, rng.normal(size=3000)), np.full(3000, 2.0)])
    m[:5, 0], m[5:9, 0] = np.inf, -np.inf
    df = spark.createDataFrame([(i // 2, *map(float, r)) for i, r in enumerate(m)], "id long, a double, b double, c double, d double, e double").repartition(3)
    names = list("abcde")
    got = {(r.i, r.j): (r.rho, r.n) for r in D.spearman(df, names, "id").collect()}
    rk = np.array([np_ranks(m[:, k]) for k in range(5)])
    for i in range(5):
        for j in range(i + 1, 5):
            assert got[(i, j)] == (pytest.approx(0.0 if j == 4 else np.corrcoef(rk[i], rk[j])[0, 1], abs=1e-10), 3000)
    rows = D.numbered_rows(df.select(*names))
    cuts = D.counted_cuts(rows, names, D.value_cuts(rows, names, 30))
    assert max(c.held[::2].max() for c in cuts) < 300
    assert sum(c.held[1::2].sum() for c in cuts[1:2] + cuts[4:]) == 6000
    assert D.rank_pieces(rows, names, cuts).agg(F.sum(F.size("at"))).first()[0] == 15000


def test_gate_raises_small_requests():
    assert D.gate_scenes(50) == 1000 and D.gate_scenes(3000) == 3000


def test_label_report(spark):
    f = spark.createDataFrame([(i // 10, i % 10, float(i % 3 == 0), 0.05 + 1.15 * (i // 10) / 30) for i in range(300)], "scene long, frame int, contact double, friction double")
    checks = A.label_gate(f, "scene", "frame", "contact", "contact", {"friction": lambda x: A.uniform_cdf(x, 0.05, 1.2)})
    row = A.label_report(checks, f, "scene").first()
    assert (row.n_frames, row.n_scenes) == (300, 30) and row.passed == all(c.passed for c in row.checks)
    ks = next(c for c in row.checks if c.name == "ks:friction")
    assert ks.n == 30 and 0 < ks.statistic < 0.1


def test_determinism_sees_values_that_vanish(spark):
    rows = lambda *v: spark.createDataFrame([(i, x, "k") for i, x in enumerate(v)], "scene long, v double, name string")
    said = lambda a, b: A.determinism(a, b, ["scene"], ["v"], exact=["name"]).first()
    nan = float("nan")
    assert said(rows(1.0, None, nan), rows(1.0, None, nan)).passed
    for a, b in (((1.0, 2.0), (1.0, None)), ((1.0, nan), (1.0, 2.0)), ((None, 1.0), (nan, 1.0))):
        r = said(rows(*a), rows(*b))
        assert not r.passed and r.n_unequal == 1 and r.one_sided == 0
    assert not said(rows(), rows()).passed and not said(rows(1.0), rows(1.0, 2.0)).passed
    assert not said(rows(1.0), rows(1.0).withColumn("name", F.lit("other"))).passed


def test_second_run_of_determinism_is_spread_evenly(spark):
    from heldout.plans.catalog import audits as C
    rows = spark.range(0, 2000).withColumnRenamed("id", "k")
    held = [r["count"] for r in C.moved(rows, "k").groupBy(F.spark_partition_id()).count().collect()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    assert len(held) == n and max(held) < 1.3 * sum(held) / n
    plan = C.determinism(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [xxhash64(" in plan and "% 11" not in plan
