import numpy as np
import pytest
from pyspark.sql import functions as F

from heldout.operators import moments
from heldout.plans import cells as C, experiments as X
from heldout.plans.report import report_tables, write_report
from heldout.sources import encoders, manifest, tables


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(60):
        mass = float(rng.normal())
        for f in range(10):
            v = rng.normal(size=8)
            v[7] += 2 * mass
            rows.append((s, f, [float(a) for a in v], mass, float(v[0] - v[1]), float(v[2]), int(v[3] + v[4] > 0), float(rng.random())))
    df = spark.createDataFrame(rows, "scene_index long, frame_index long, x array<double>, log_mass double, obj_pos_x double, obj_pos_y double, contact_state int, occlusion_fraction double").cache()

    def features(encoder, condition, layer, view):
        if encoder == "missing" or encoder in X.VIDEO_LAYERS:
            raise FileNotFoundError(encoder)
        if encoder == "video":
            return moments.mean_vector(df, "x", ["scene_index"]).withColumn("frame_index", F.lit(-1).cast("long"))
        if encoder == "short":
            return df.where("scene_index < 59")
        x = F.transform("x", lambda v: v * -1) if encoder == "random_b" else F.col("x")
        x = F.transform(x, lambda v, i: F.when(i == 0, F.lit(0.0)).otherwise(v)) if condition == "occluded" else x
        return df.select("scene_index", "frame_index", x.alias("x"))

    keep = ("scene_index", "frame_index", "log_mass", "obj_pos_x", "obj_pos_y", "contact_state", "occlusion_fraction")
    return C.Corpus(features, lambda condition: df.select(*keep))


TARGETS = ("log_mass", "obj_pos_x", "obj_pos_y", "contact_state")


def test_positive_control_resumes_with_its_verdict(spark, corpus, tmp_path):
    root, g = str(tmp_path), X.grid("A", targets=TARGETS)
    first = X.run_experiment(spark, corpus, "A", [0, 1], root, g).collect()
    assert len(first) == 2 and all(r.passed and r.score > 0.99 for r in first)
    files = sorted(str(p) for p in tmp_path.rglob("*.parquet"))
    again = X.run_experiment(spark, corpus, "A", [0, 1], root, g).collect()
    assert sorted(str(p) for p in tmp_path.rglob("*.parquet")) == files
    assert sorted(again) == sorted(first)
    X.run_experiment(spark, corpus, "A", [0], root, g, force=True).collect()
    assert sorted(str(p) for p in tmp_path.rglob("*.parquet")) != files
    wide = X.grid("A", targets=TARGETS, layers=(5,))
    pending = X._pending(spark, spark.createDataFrame([("A", 0, "other")], "exp string, seed int, config_hash string"), root, False)
    assert pending.count() == 1 and wide != g


def test_failed_control_stops_the_run(spark, corpus, tmp_path):
    hard = {"A": [C.Cell("dinov2_b", "occluded", 8, "cls", ("obj_pos_x", "obj_pos_y"))], "B": X.grid("B", targets=("obj_pos_x",))}
    v = X.run_all(spark, corpus, [0], str(tmp_path / "a"), ("A", "B"), hard).collect()
    assert [(r.exp, r.passed) for r in v] == [("A", False)]
    v = X.run_all(spark, corpus, [0], str(tmp_path / "b"), ("A", "B"), hard, keep_going=True).collect()
    assert {r.exp: r.passed for r in v} == {"A": False, "B": True}
    again = X.run_all(spark, corpus, [0], str(tmp_path / "a"), ("A", "B"), hard).collect()
    assert [(r.exp, r.passed) for r in again] == [("A", False)]


def test_misaligned_tables_are_refused(corpus):
    with pytest.raises(RuntimeError, match="do not correspond"):
        C.run_cell(corpus, C.Cell("short", "base", 8, "cls", ("obj_pos_x",)), "D", [0])


def test_pooled_video_and_transfer_cells(spark, corpus):
    pooled = C.run_cell(corpus, C.Cell("dinov2_b", "base", 8, "cls", ("log_mass",), "scene_pooled", pool=True), "F", [0, 1])
    video = C.run_cell(corpus, C.Cell("video", "base", 8, "mean", ("log_mass",)), "F", [0, 1])
    assert pooled.count() == video.count() == 2 * 12
    a = pooled.select("seed", "scene_index", F.round("y_pred", 8).alias("p")).collect()
    b = video.select("seed", "scene_index", F.round("y_pred", 8).alias("p")).collect()
    assert sorted(a) == sorted(b)
    t = C.run_cell(corpus, C.Cell("dinov2_b", "base", 8, "cls", ("obj_pos_x", "contact_state"), "transfer", label="paired", also=("occluded",)), "E", [0]).cache()
    assert t.groupBy("eval_condition", "target").count().where("count <> 120").count() == 0
    sides = t.where("target = 'obj_pos_x'").groupBy("eval_condition").agg(F.collect_set("scene_index").alias("s")).collect()
    assert set(sides[0].s) == set(sides[1].s)
    assert t.where("occlusion_fraction is null").count() == 0 and t.where("train_condition <> 'paired'").count() == 0
    from heldout.operators.metrics import r2
    v = {r.eval_condition: r.value for r in r2(t.where("target = 'obj_pos_x'"), ["eval_condition"]).collect()}
    assert v["base"] > 0.99 and v["occluded"] < 0.7


def test_other_conditions_are_scored_off_written_rows(corpus):
    cell = C.Cell("dinov2_b", "base", 8, "cls", ("obj_pos_x", "contact_state"), "transfer", label="paired", also=("occluded",))
    told = C.run_cells(corpus, [cell], "E", [0, 1])
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "Join" not in plan and "InMemory" not in plan
    assert {(r.seed, r.eval_condition, r.target): r["count"] for r in told.groupBy("seed", "eval_condition", "target").count().collect()} \
        == {(s, c, t): 120 for s in (0, 1) for c in ("base", "occluded") for t in cell.targets}


def test_pooling_unsorted_scenes(spark):
    df = spark.createDataFrame([(s, f, [float(s), float(f), 1.0], v) for s, v in ((5, 1.0), (2, 2.0), (9, 3.0)) for f in range(4)], "scene_index long, frame_index long, x array<double>, log_mass double")
    p = moments.mean_vector(df, "x", ["scene_index"], [F.min_by("log_mass", "frame_index").alias("log_mass")]).orderBy("scene_index").collect()
    assert [(r.scene_index, r.log_mass, list(r.x)) for r in p] == [(2, 2.0, [2.0, 1.5, 1.0]), (5, 1.0, [5.0, 1.5, 1.0]), (9, 3.0, [9.0, 1.5, 1.0])]


def test_grid_report_and_missing_results(spark, corpus, tmp_path):
    root = str(tmp_path)
    X.run_experiment(spark, corpus, "D", [0, 1], root, X.grid("D", targets=("obj_pos_x", "contact_state"), layers=(8,), views=("cls",))).collect()
    X.run_experiment(spark, corpus, "E", [0], root, X.grid("E", targets=("obj_pos_x", "contact_state"), layers=(8,), views=("cls",))).collect()
    found = report_tables(spark, root, ("A", "D", "E"), (0, 1), n_boot=30, curve_boot=20)
    assert set(found) == {"exp_D_per_seed", "exp_D_summary", "exp_E_per_seed", "exp_E_summary", "hypothesis_tests", "occlusion_curve"}
    h = found["hypothesis_tests"].collect()
    assert len(h) == 4 and {r.verdict for r in h} == {"equivalent to baseline"}      # a sign flip carries the same information
    write_report(found, root)
    back = spark.read.csv(f"{root}/tables/exp_D_summary", header=True)
    assert back.count() == found["exp_D_summary"].count() and "majority_rate" in back.columns
    with pytest.raises(FileNotFoundError):
        X._stored(spark, root, "A").count() and X.verdicts(spark, corpus, "A", [0], str(tmp_path / "nothing"))
        X._stored(spark, str(tmp_path / "nothing"), "A")


def test_absent_video_encoders_are_skipped(spark, corpus, tmp_path):
    X.run_experiment(spark, corpus, "F", [0], str(tmp_path), X.grid("F", targets=("log_mass",), encoders=("dinov2_b",), layers=(8,), views=("cls",))).collect()
    assert {r.encoder for r in X._stored(spark, str(tmp_path), "F").select("encoder").distinct().collect()} == {"dinov2_b"}
    with pytest.raises(FileNotFoundError):
        X.run_experiment(spark, corpus, "D", [0], str(tmp_path), X.grid("D", encoders=("missing",), targets=TARGETS))


def test_manifest(spark):
    w = spark.createDataFrame([("a", "h1", 3), ("b", "h1", 3), ("c", "h1", None), ("d", "h2", 3)], "unit string, config_hash string, size long")
    m = spark.createDataFrame([("a", "h1", 3), ("b", "h1", 4), ("c", "h1", 3), ("d", "h1", 3)], "unit string, config_hash string, size long")
    assert sorted(r.unit for r in manifest.pending(w, m, ["unit"]).collect()) == ["b", "c", "d"]
    assert manifest.pending(w, m, ["unit"], force=True).count() == 4


def test_encoder_registry(spark):
    assert encoders.known() == ["precomputed", "random_b", "raw_pixel"]
    with pytest.raises(KeyError):
        encoders.make("nobody", None)
    df = spark.createDataFrame([(0, 0, [1.0, 2.0])], "scene_index long, frame_index long, x array<double>")
    a, b = (encoders.make("random_b", df, dim=5, seed=1).first().x for _ in range(2))
    assert a == b and len(a) == 5


def test_feature_scan(spark, tmp_path):
    df = spark.createDataFrame([("e", "base", 8, "cls", 0, 0, [1.0])], "encoder string, condition string, layer int, view string, scene_index long, frame_index long, x array<double>")
    tables.write_features(df, str(tmp_path))
    assert tables.features(spark, str(tmp_path), "e", "base", 8, "cls").count() == 1
    plan = tables.features(spark, str(tmp_path), "e", "base", 8, "cls")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(encoder" in plan
    with pytest.raises(FileNotFoundError):
        tables.features(spark, str(tmp_path), "e", "base", 9, "cls")


def test_a_write_is_seen_whole_or_not_at_all(spark, tmp_path):
    """A write that dies half-way leaves the old rows; empty results replace too."""
    path = str(tmp_path / "predictions")
    rows = lambda v, seeds: spark.createDataFrame([("D", s, v, i) for s in seeds for i in range(20)], "exp string, seed int, y double, i int")
    seen = lambda: {(r.seed, r.y): r["count"] for r in tables.predictions(spark, path, "D").groupBy("seed", "y").count().collect()}
    tables.write_predictions(rows(1.0, (0, 1)), path)
    with pytest.raises(Exception, match="dies"):
        dies = F.when(F.col("i") == 19, F.raise_error(F.lit("dies"))).otherwise(F.col("y"))
        tables.write_predictions(rows(2.0, (0, 1)).repartition(4, "i").withColumn("y", dies.cast("double")), path)
    assert seen() == {(0, 1.0): 20, (1, 1.0): 20}
    tables.write_predictions(rows(3.0, (1,)), path)
    assert seen() == {(0, 1.0): 20, (1, 3.0): 20}
    tables.write_predictions(rows(4.0, ()), path, [("D", 0)])
    assert seen() == {(1, 3.0): 20}


def test_digests_are_of_the_rows_whatever_their_order(spark):
    df = spark.createDataFrame([(0, i % 7, None if i == 3 else 0.1 * i) for i in range(50)], "seed int, k int, v double")
    told = lambda d: manifest.digest(d, ["seed"]).first()
    base = told(df)
    assert told(df.repartition(5, "k")) == base and told(df.orderBy(F.desc("v"))) == base
    assert told(df.withColumn("v", F.when(F.col("v") == 0.1, 0.2).otherwise(F.col("v")))).sha256 != base.sha256          # as many rows, another value
    assert told(df.unionByName(df.limit(1))).size == base.size + 1


def test_an_absent_table_is_a_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.features(spark, str(tmp_path / "none"), "dinov2_b", "base", 8, "cls")


def test_dynamics_of_cells_in_shared_scans_equal_those_of_one_cell(spark):
    from heldout.operators import dynamics as Dy, metrics as M, probes as P
    from heldout.plans import experiments as X
    from heldout.plans.catalog.experiments import corpus
    from heldout.plans.cells import Corpus, aligned
    given = corpus(spark, "/root/testdata/sf0.001")
    cells, seeds = [X.Cell("dinov2_b", "base", 8, "cls", ("contact_state",)), X.Cell("random_b", "base", 2, "mean", ("contact_state",))], [0, 3]
    found = {(r.encoder, r.seed): r for r in X.run_dynamics(spark, given, cells, "G", seeds).collect()}
    assert len(found) == 4
    cell = cells[1]
    rows = aligned(Corpus(given.features, given.targets, given.patches, extra=("ee_pos_x", "ee_pos_y", "time")), cell, "base").cache()
    moves = P.with_folds(Dy.transitions(rows, "scene_index", "frame_index", "x", "ee_pos_x", "ee_pos_y", "time"), "scene_index", seeds).cache()
    for want in Dy.predictability(moves, "scene_index", "folds", seeds):
        got = found["random_b", want["seed"]]
        assert got.latent_dim == want["latent_dim"]
        assert abs(got.model_mse - want["model_mse"]) < 1e-8 and abs(got.r2_vs_stationary - want["r2_vs_stationary"]) < 1e-8
    design = P.with_folds(rows, "scene_index", seeds).cache()
    fits = P.fit_logistic(design, "x", "contact_state", seeds)
    for i, s in enumerate(seeds):
        test = design.where(F.col("folds")[i] < 0).select(F.col("contact_state").alias("y_true"), (P.linear_scores(F.col("x"), [fits[i]])[0] > 0).cast("int").alias("y_pred"))
        assert abs(M.balanced_accuracy(test, []).first()["value"] - found["random_b", s].contact_balanced_accuracy) < 1e-9


def test_a_task_of_the_design_reads_one_cell(spark):
    from heldout.operators.common import plain_unions
    from heldout.plans import cells
    name, before = "spark.sql.unionOutputPartitioning", spark.conf.get("spark.sql.unionOutputPartitioning")
    part = lambda k: spark.range(400).select("id", F.lit(k).alias("k")).repartition(3, "id")
    with plain_unions(spark):
        assert spark.conf.get(name) == "false" and cells._union([part(k) for k in range(4)]).rdd.getNumPartitions() == 12
    assert spark.conf.get(name) == before
    rows = cells._written([part(k) for k in range(4)])
    assert rows.count() == 1600 and len(rows.inputFiles()) == 12         # a file for each task: 3 of each part, not 3 for all
