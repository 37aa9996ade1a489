"""Second moments of a vector column, summed where the rows are.

A task multiplies whole Arrow batches (BLAS) and emits one small matrix per
group; rows themselves never move.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a 2-d array; refuses nulls and ragged rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) % len(column):
        raise ValueError("vectors must be non-null and of one length")
    lengths = np.diff(column.offsets.to_numpy())
    if lengths.min() != lengths.max():
        raise ValueError("vectors must be of one length")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sum_rows(partials: DataFrame, by: list[str], vector: str = "row") -> DataFrame:
    """Adds array columns element by element per group, with map-side sums."""
    summed = partials.groupBy(*by).agg(Summarizer.sum(array_to_vector(F.col(vector))).alias("__s"))
    return summed.select(*by, vector_to_array("__s").alias(vector))


def scatter(df: DataFrame, z: str, by: list[str] = (), center=None, scale=None) -> DataFrame:
    """Z'Z per group as rows (by..., i, row) of the vectors in column ``z``.

    With a leading 1 in ``z`` the first row holds count and sums.  ``center`` and
    ``scale`` are model-sized and applied in the task, which keeps sums of squares
    from cancelling.
    """
    by = list(by)
    c = None if center is None else np.asarray(center, float)
    s = None if scale is None else np.asarray(scale, float)
    source = df.select(*by, z)
    fields = [source.schema[k] for k in by]
    schema = T.StructType([*fields, T.StructField("i", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            m = matrix_of(batch.column(len(by)))
            if not len(m):
                continue
            if c is not None:
                m = m - c
            if s is not None:
                m = m / s
            if by:
                groups = {}
                for at, key in enumerate(zip(*[batch.column(g).to_pylist() for g in range(len(by))])):
                    groups.setdefault(key, []).append(at)
                parts = [(key, m[at]) for key, at in groups.items()]
            else:
                parts = [((), m)]
            for key, rows in parts:
                product = rows.T @ rows
                sums[key] = sums[key] + product if key in sums else product
        for key, total in sums.items():
            d = total.shape[0]
            columns = [pa.array([v] * d, type=T_arrow[k]) for k, v in enumerate(key)]
            columns.append(pa.array(np.arange(d, dtype=np.int32)))
            columns.append(pa.array(list(total), type=pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "i", "row"])

    from pyspark.sql.pandas.types import to_arrow_type
    T_arrow = [to_arrow_type(f.dataType) for f in fields]
    return sum_rows(source.mapInArrow(partial, schema), [*by, "i"])


def gather(moments: DataFrame, by: list[str] = ()) -> dict[tuple, np.ndarray]:
    """Moment matrices on the driver: one d-by-d matrix per group, independent of rows."""
    out: dict[tuple, list] = {}
    for r in moments.collect():
        out.setdefault(tuple(r[k] for k in by), []).append((r["i"], r["row"]))
    return {k: np.array([row for _, row in sorted(v, key=lambda t: t[0])]) for k, v in out.items()}


def scalar_moments(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """n, sums and products of a few scalar columns in one generated-code aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(a).cast("double")).alias(f"s_{a}") for a in columns],
        *[F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"p_{a}_{b}") for a, b in pairs])


def standardiser(df: DataFrame, x: str, floor: float = 1e-12, ddof: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of a vector column in one pass; a dead dimension gets scale 1."""
    row = df.agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(x))).alias("s")).first()["s"]
    n = int(row["count"])
    if n == 0:
        raise ValueError("no training rows")
    mean = np.array(row["mean"].toArray())
    var = np.array(row["variance"].toArray()) * ((n - 1) / (n - ddof) if n > 1 else 0.0)
    scale = np.sqrt(np.clip(var, 0, None))
    scale[scale < floor] = 1.0
    return mean, scale


def mean_vector(df: DataFrame, x: str, by: list[str], extra: list[Column] = ()) -> DataFrame:
    """Mean vector per group, combined map-side so a hot group is spread."""
    out = df.groupBy(*by).agg(Summarizer.mean(array_to_vector(F.col(x))).alias("__m"), *extra)
    rest = [c for c in out.columns if c not in {*by, "__m"}]
    return out.select(*by, vector_to_array("__m").alias(x), *rest)
