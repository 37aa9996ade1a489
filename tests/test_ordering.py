import numpy as np
import pytest
from pyspark.sql import functions as F

from heldout.functions import keyed
from heldout.operators import ordering as O
from heldout.operators.sampling import FACTORS, factor_table, sample_factors, with_conditions, clearance_audit


def test_positions_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    g = np.where(rng.random(900) < 0.5, 1, rng.integers(2, 20, 900))
    t = rng.permutation(900)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(g, t)], "g int, t int").repartition(7)
    got = {(r.g, r.t): (r.position, r.position_total) for r in O.positions(df, ["t"], ["g"]).collect()}
    for a in set(g):
        ordered = sorted(t[g == a])
        for i, b in enumerate(ordered):
            assert got[(a, b)] == (i, len(ordered))


def test_global_positions_and_equal_order_values(spark):
    df = spark.createDataFrame([(5, i) for i in range(50)], "v int, id int")
    got = sorted(r.position for r in O.positions(df, ["v", "id"]).collect())
    assert got == list(range(50))


@pytest.mark.parametrize("values,ranks", [([3, 1, 2], [3, 1, 2]), ([7] * 7, [4] * 7), ([1, 1, 2, 2, 2], [1.5, 1.5, 4, 4, 4])])
def test_average_ranks(spark, values, ranks):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.v: r["rank"] for r in O.value_ranks(df, "v").collect()}
    assert [got[float(v)] for v in values] == ranks


def test_draws_do_not_depend_on_partitions(spark):
    a = spark.range(300).repartition(3).select("id", keyed.uniform(1, F.col("id")).alias("u"))
    b = spark.range(300).coalesce(1).select("id", keyed.uniform(1, F.col("id")).alias("u"))
    assert sorted(a.collect()) == sorted(b.collect())
    u = np.array([r.u for r in a.collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05


def test_factors_are_pure_in_seed_scene_and_name(spark):
    full = sample_factors(spark.range(40), "id", 0)
    some = sample_factors(spark.range(40).where("id % 3 = 0").repartition(5), "id", 0, FACTORS[5:9])
    names = [f.name for f in FACTORS[5:9]]
    whole = {r.scene_index: tuple(r[n] for n in names) for r in full.collect()}
    for r in some.collect():
        assert whole[r.scene_index] == tuple(r[n] for n in names)
    other = {r.scene_index: r.mass for r in sample_factors(spark.range(40), "id", 1).collect()}
    assert any(other[r.scene_index] != r.mass for r in full.collect())


def test_factor_ranges_and_mixture(spark):
    t = factor_table(spark, 10, 0, minimum=2000).toPandas()
    assert len(t) == 2000 and len(FACTORS) == 24
    assert t.mass.between(0.05, 2.0).all() and abs(np.log(t.mass).mean() - (np.log(0.05) + np.log(2)) / 2) < 0.1
    zero = (t.spawn_height == 0).mean()
    assert 0.30 < zero < 0.40 and t.spawn_height[t.spawn_height > 0].between(0.02, 0.20).all()
    assert set(t.obj_geom_type) == {"box", "sphere", "cylinder"} and set(t.distractor_side) == {0, 1}


def test_conditions_share_factors_and_respect_limits(spark):
    both = with_conditions(factor_table(spark, 30, 0), {"base": None, "occluded": 10}).toPandas()
    assert (both.condition == "occluded").sum() == 10 and (both.condition == "base").sum() == 30
    a, b = (both[both.condition == c].set_index("scene_index") for c in ("base", "occluded"))
    for f in FACTORS:
        assert (a.loc[b.index, f.name] == b[f.name]).all()
    assert a.scene_id[7] == "base_00007"


def test_distractor_stays_clear(spark):
    r = clearance_audit(factor_table(spark, 400, 0)).first()
    assert r.passed and r.min_clearance > 0.01
