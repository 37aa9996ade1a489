"""A spread of registered queries beside their SQL twins on the smallest tables."""
import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = ["metric_auroc", "bootstrap_r2_ci", "holm_by_family", "grouped_folds", "label_control", "seed_aggregate", "verdicts", "retained_skill",
         "factor_table", "spearman_pairs", "debounce", "monotone_repair", "projection", "clip_resample", "dead_shard", "ks_statistic",
         "manifest_pending", "scan_features", "fold_moments", "ridge_path", "transitions", "stationary_mse"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    r = duck.execute(entry.oracle_sql()[name])
    cols, rows = [c[0] for c in r.description], r.fetchall()
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    a = sorted((tuple(norm(x[c]) for c in order) for x in df.collect()), key=repr)
    b = sorted((tuple(norm(x[cols.index(c)]) for c in order) for x in rows), key=repr)
    assert a == b
