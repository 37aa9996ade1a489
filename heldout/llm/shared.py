"""Helpers of the corpus operators."""
from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from heldout.operators.common import parallelism, shared_folder  # noqa: F401

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write once to the shared folder, compressed hard, and go on from the files.

    The schema is kept as it was, so a table without rows reads back too.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def words_in(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unsigned32(c: Column) -> Column:
    """Spark's crc32 is already unsigned; null texts count as empty."""
    return F.crc32(F.coalesce(c, F.lit("")).cast("binary"))



def slices(batches, name: str = "text", most: int = 1 << 22):
    """The Arrow batches in runs of rows whose values of ``name`` have about ``most`` bytes together, so that a task holds few texts as objects."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, z - a)
            a = z
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, and pools would keep what the largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):                           # another C library
        pass
