"""Small helpers shared by the operators."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a private one only in local mode without any."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write once as a table in the shared folder and go on from its files.

    Ends the lineage, keeps plans small where a result is used several times, and
    survives lost executors.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def plain_unions(spark: SparkSession):
    """Unions run in here keep the tasks of their branches.

    Spark otherwise gives branches that are partitioned alike to the same tasks, one
    partition of every branch each, so a task's input grows with their number.
    """
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows over the shuffle partitions and keep it so.

    For work that is heavy per small row: adaptive merging by bytes would leave it
    to few tasks.
    """
    return df.repartition(parallelism(df.sparkSession), *keys)


def finite(c: Column) -> Column:
    """Null in place of NaN and infinities, so that aggregates skip them."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null where a column is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

