import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[8]").appName("heldout-tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def probe_data(spark):
    """200 scenes x 10 frames, 12 features on different scales, two linear targets and a class."""
    import numpy as np
    rng = np.random.default_rng(3)
    n, d = 2000, 12
    scene = np.repeat(np.arange(200), 10)
    x = rng.normal(size=(n, d)) * np.linspace(0.5, 3, d) + np.linspace(-50, 50, d)
    y = (x - x.mean(0)) @ rng.normal(size=(d, 2)) + rng.normal(size=(n, 2)) * 2
    c = ((x - x.mean(0)) / x.std(0) @ rng.normal(size=d) + rng.normal(size=n) > 1.4).astype(int)
    rows = [(int(s), int(i % 10), [float(v) for v in xi], float(a), float(b), int(k)) for i, (s, xi, (a, b), k) in enumerate(zip(scene, x, y, c))]
    df = spark.createDataFrame(rows, "scene_index long, frame_index int, x array<double>, y1 double, y2 double, c int").cache()
    return df, scene, x, y, c
