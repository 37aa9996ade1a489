import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heldout.operators import labels as L


def flags(spark, *sequences):
    return spark.createDataFrame([(s, i, bool(v)) for s, q in enumerate(sequences) for i, v in enumerate(q)], "scene long, step long, flag boolean")


def test_debounce_known_sequences(spark):
    df = flags(spark, [0, 1, 0], [1] * 5, [0, 1, 1, 1, 0, 1, 0], [1, 1, 1, 0])
    for chunk in (2, 3, 4096):
        got = {(r.scene, r.step) for r in L.debounce(df, "scene", "step", "flag", chunk=chunk).where("flag_clean").collect()}
        assert got == {(1, i) for i in range(5)} | {(2, 2)} | {(3, 0), (3, 1)}
    assert L.debounce(df, "scene", "step", "flag", 1).where("flag <> flag_clean").count() == 0
    with pytest.raises(ValueError):
        L.debounce(df, "scene", "step", "flag", 2)


@pytest.mark.parametrize("width", [3, 5])
def test_debounce_equals_edge_replication(spark, width):
    rng = np.random.default_rng(width)
    q = [(rng.random(rng.integers(1, 40)) < 0.7).astype(int) for _ in range(30)]
    got = {(r.scene, r.step): r.flag_clean for r in L.debounce(flags(spark, *q), "scene", "step", "flag", width, chunk=8).collect()}
    for s, v in enumerate(q):
        p = np.pad(v, width // 2, mode="edge")
        for i in range(len(v)):
            assert got[(s, i)] == bool(p[i:i + width].all())


def repaired(idx, n):
    idx = [min(max(i, 0), n - 1) for i in idx]
    up = [idx[0]]
    for i in idx[1:]:
        up.append(max(i, up[-1] + 1))
    up[-1] = min(up[-1], n - 1)
    down = [up[-1]]
    for i in reversed(up[:-1]):
        down.append(min(i, down[-1] - 1))
    return down[::-1]


def test_repair_equals_the_walk(spark):
    rng = np.random.default_rng(0)
    cases = []
    for s in range(400):
        n = int(rng.integers(6, 40))
        cases.append((s, n, [int(v) for v in rng.integers(-3, n + 4, 10)]))
    df = spark.createDataFrame([(s, k, v, n) for s, n, q in cases for k, v in enumerate(q)], "scene long, slot int, wanted long, n_steps long")
    got = {(r.scene, r.slot): (r.step_index, r.ok) for r in L.strictly_increasing(df, ["scene"]).collect()}
    seen = set()
    for s, n, q in cases:
        want = repaired(q, n)
        assert [got[(s, k)][0] for k in range(10)] == want
        assert {got[(s, k)][1] for k in range(10)} == {want[0] >= 0}
        assert all(a < b for a, b in zip(want, want[1:]))
        seen.add(want[0] >= 0)
    assert seen == {True, False}


def test_capture_steps_by_hand(spark):
    rng = np.random.default_rng(4)
    dt, rows, want = 0.01, [], {}
    for s in range(40):
        n = int(rng.integers(30, 300))
        on = np.zeros(n, bool)
        if s % 8:
            a = int(rng.integers(0, n))
            on[a:a + int(rng.integers(1, 60))] = rng.random(len(on[a:a + 60]))[:len(on[a:])].size >= 0
            on &= rng.random(n) < 0.8
        speed = rng.random(n) * 0.05
        rows += [(s, i, bool(on[i]), float(speed[i])) for i in range(n)]
        act = np.flatnonzero(on)
        if len(act):
            first, last = int(act[0]), int(act[-1])
            i0, i7 = min(2, n - 1), min(last + 5, n - 1)
            still = np.flatnonzero(speed[i7:] < 0.01)
            settle = i7 + int(still[0]) if len(still) else n - 1
            want[s] = [i0, i0 + min(9, max(int(0.5 * (first - i0)), 1)), i0 + int(0.75 * (first - i0)), first, int(act[len(act) // 3]),
                       int(act[2 * len(act) // 3]), last, i7, (i7 + settle) // 2, n - 1]
    df = spark.createDataFrame(rows, "scene long, step long, flag boolean, speed double").repartition(6)
    got = {}
    for r in L.capture_steps(df, "scene", "step", "flag", "speed", dt).collect():
        got.setdefault(r.scene, {})[r.slot] = r.wanted
    assert {s: [v[k] for k in range(10)] for s, v in got.items()} == want
    check = L.dropped_share(df, df.where(F.col("scene").isin(list(want))), "scene").first()
    assert check.n_dropped == 40 - len(want)
    with pytest.raises(RuntimeError, match="dropped"):
        L.refuse(L.dropped_share(df, df.where("scene < 20"), "scene"), "too many scenes dropped")


def test_point_behind_the_camera(spark):
    df = spark.createDataFrame([(0.0, 0.0, -2.0), (0.0, 0.0, 2.0), (0.5, 0.25, -1.0)], "x double, y double, z double")
    one, zero = F.lit(1.0), F.lit(0.0)
    p = L.project([F.col("x"), F.col("y"), F.col("z")], [zero, zero, zero], [one, zero, zero, zero, one, zero, zero, zero, one],
                  F.lit(90.0), F.lit(200.0), F.lit(100.0))
    a, b, c = df.select(*[v.alias(k) for k, v in p.items()]).collect()
    assert (round(a.u), round(a.v), a.depth, a.in_frame) == (100, 50, 2.0, True)
    assert math.isnan(b.u) and math.isnan(b.v) and b.depth == -2.0 and b.in_frame is False
    assert c.u == pytest.approx(100 + 50 * 0.5) and c.v == pytest.approx(50 - 50 * 0.25)


def test_touch_needs_force_and_the_right_pair(spark):
    steps = spark.createDataFrame([(0, i) for i in range(5)], "scene long, step long")
    c = spark.createDataFrame([(0, 0, 1, 2, 1.0, 0.0, 0.0), (0, 1, 2, 1, 0.0, 0.0, 1.0), (0, 2, 1, 2, 1e-4, 0.0, 0.0), (0, 3, 2, 3, 9.0, 0.0, 0.0)],
                              "scene long, step long, geom1 int, geom2 int, fx double, fy double, fz double")
    got = {r.step: r.flag for r in L.touch_flags(steps, c, ["scene", "step"], 1, [2]).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False}


def test_hidden_and_covered_shares(spark):
    s = spark.createDataFrame([(0, 1.0, 2.0, 1.0), (0, 0.5, 1.0, -1.0), (0, -0.5, 1.0, 0.1), (1, -1.0, 1.0, 0.5)], "k int, cosine double, distance double, hit double")
    got = {r.k: r.occlusion_fraction for r in L.hidden_share(s, ["k"]).collect()}
    assert got[0] == pytest.approx(0.25 / 0.75) and got[1] == 0.0
    px = spark.createDataFrame([(0, 7, 7), (0, 3, 7), (0, 7, 7), (0, 7, 7), (1, 3, 3), (2, 7, 3)], "k int, full_id int, solo_id int")
    got = {r.k: r.occlusion_fraction for r in L.covered_share(px, ["k"], F.lit(7)).collect()}
    assert got == {0: 0.25, 1: 0.0, 2: 0.0}


@pytest.mark.parametrize("t,n", [(10, 16), (5, 3), (1, 4), (16, 16), (6, 5)])
def test_clip_resample(spark, t, n):
    df = spark.createDataFrame([(0, i) for i in range(t)], "scene long, frame long")
    got = [r.frame for r in L.resample_clip(df, "scene", "frame", n).orderBy("slot").collect()]
    assert got == list(np.clip(np.round(np.linspace(0, t - 1, n)), 0, t - 1).astype(int))


def test_block_means(spark):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (8, 12, 3))
    df = spark.createDataFrame([(0, 0, y, x, *map(int, img[y, x])) for y in range(8) for x in range(12)], "scene_index long, frame_index long, y int, x int, r int, g int, b int")
    got = L.block_means(df, ["scene_index", "frame_index"], 8, 12, 4).first().x
    grey = (img @ np.array([0.299, 0.587, 0.114]) / 255).reshape(4, 2, 4, 3).mean(axis=(1, 3)).ravel()
    assert np.allclose(got, grey)
    with pytest.raises(ValueError):
        L.block_means(df, ["scene_index"], 9, 12, 4)
