import numpy as np
import pytest
from pyspark.sql import functions as F

from heldout.operators import probes as P, splits as S


@pytest.fixture(scope="module")
def frames(spark):
    profile = [0, 0, 0, 1, 1, 1, 1, 0, 0, 0]
    return spark.createDataFrame([(s, f, profile[f], float(s)) for s in range(150) for f in range(10)], "scene long, frame int, contact int, mass double").cache()


def test_split_is_by_scene_and_ignores_order(spark, frames):
    a = {r.scene: r.is_train for r in S.scene_split(frames, "scene", 4).collect()}
    b = {r.scene: r.is_train for r in S.scene_split(frames.orderBy(F.desc("scene")).repartition(9), "scene", 4).collect()}
    assert a == b and sum(a.values()) == 120 and len(a) == 150
    assert a != {r.scene: r.is_train for r in S.scene_split(frames, "scene", 5).collect()}


@pytest.mark.parametrize("n,train", [(1, 1), (2, 1), (3, 2), (10, 8)])
def test_split_sizes(spark, n, train):
    got = S.scene_split(spark.range(n), "id", 0).collect()
    assert sum(r.is_train for r in got) == train


def test_folds_cover_and_balance(frames):
    f = S.grouped_folds(frames, "scene", 7, 0).toPandas()
    assert len(f) == 150 and f.scene.is_unique and set(f.fold) == set(range(7))
    assert f.fold.value_counts().max() - f.fold.value_counts().min() <= 1


def test_too_few_scenes_for_folds(spark):
    with pytest.raises(Exception, match="cannot make"):
        S.grouped_folds(spark.range(3), "id", 5, 0).collect()


def test_membership_agrees_with_split_and_folds(frames):
    m = {r.scene: r.folds for r in P.membership(frames, "scene", [4, 9]).collect()}
    a = {r.scene: r.is_train for r in S.scene_split(frames, "scene", 4).collect()}
    f = {r.scene: r.fold for r in S.grouped_folds(frames, "scene", 5, 4).collect()}
    for s, (x, _) in m.items():
        assert (x >= 0) == a[s] and (x == f[s] or x == -1)


def test_growing_training_sets_nest(frames):
    m = P.growing_membership(frames, "scene", 0, [20, 60, 120]).collect()
    for r in m:
        assert r.folds[0] < 0 or r.folds[1] == r.folds[0]
        assert (r.folds[0] == -1) == (r.folds[2] == -1)
    assert [sum(r.folds[k] >= 0 for r in m) for k in range(3)] == [20, 60, 120]


def test_control_keeps_marginals_and_scene_constancy_but_moves_labels(frames):
    out = S.shuffled_labels(frames, "scene", "frame", ["contact", "mass"], 0)
    got = out.toPandas().sort_values(["scene", "frame"])
    was = frames.toPandas().sort_values(["scene", "frame"])
    assert len(got) == len(was) and sorted(got.mass) == sorted(was.mass) and got.contact.sum() == was.contact.sum()
    assert (got.groupby("scene").mass.nunique() == 1).all()
    assert (got.contact.values != was.contact.values).mean() > 0.2
    assert (got.mass.values != was.mass.values).mean() > 0.9
    again = S.shuffled_labels(frames.repartition(11), "scene", "frame", ["contact", "mass"], 0).toPandas().sort_values(["scene", "frame"])
    assert (again.mass.values == got.mass.values).all() and (again.contact.values == got.contact.values).all()


def test_control_with_ragged_scenes(spark):
    df = spark.createDataFrame([(s, f, float(s * 100 + f)) for s in range(20) for f in range(1 + s % 5)], "scene long, frame int, v double")
    out = S.shuffled_labels(df, "scene", "frame", ["v"], 1).toPandas()
    assert len(out) == df.count()
    for _, g in out.groupby("scene"):
        assert len(set(g.v // 100)) == 1                      # one donor
        donor_size = 1 + int(g.v.iloc[0] // 100) % 5
        counts = g.v.value_counts()
        assert len(counts) == min(len(g), donor_size) and counts.max() - counts.min() <= 1


def test_shards_and_filters(spark, frames):
    s = {r.id: r.shard for r in S.strided_shards(spark.range(5, 40), "id", 4).collect()}
    assert all(s[i] == (i - 5) % 4 for i in range(5, 40))
    kept = S.only_scenes(frames, spark.createDataFrame([(3,), (5,)], "scene long"), "scene")
    assert kept.count() == 20
