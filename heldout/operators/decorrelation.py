"""Are factors of different groups uncorrelated?  Ranks, Spearman, Fisher-z, Holm, verdict."""
from __future__ import annotations

from dataclasses import dataclass

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.pvalues import fisher_z_p
from .common import cut, parallelism
from .moments import sum_rows
from .ordering import value_ranks
from .testing import holm

MIN_SCENES = 1000                    # fixed value: fewest scenes that make the bound meaningful
BLOCK_ROWS = 1 << 16                 # rows whose ranks are brought together
RANGE_ROWS = 1 << 19                 # rows of a column that are ranked together
PART_CELLS = 1 << 22                 # values that a task takes from a shuffle


@dataclass(frozen=True)
class Expanded:
    """A numeric column of the audit, and the factor and group it stands for."""
    name: str
    factor: str
    group: str
    column: Column


def expand(name: str, group: str, kind: str = "continuous", levels=(), circular: bool | None = None, source: Column | None = None) -> list[Expanded]:
    """One-hot columns for a categorical factor; sine and cosine beside a circular one."""
    c = source if source is not None else F.col(name)
    if kind == "categorical":
        return [Expanded(f"{name}={v}", name, group, F.when(c == v, F.lit(1.0)).otherwise(F.lit(0.0))) for v in levels]
    out = [Expanded(name, name, group, c.cast("double"))]
    if name.endswith("hue") if circular is None else circular:
        turn = F.lit(2 * math.pi) * c.cast("double")
        out += [Expanded(f"{name}_sin", name, group, F.sin(turn)), Expanded(f"{name}_cos", name, group, F.cos(turn))]
    return out


def expand_factors(factors) -> list[Expanded]:
    return [e for f in factors for e in expand(f.name, f.group, f.kind, f.levels)]


def average_ranks(rows: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, ties, below, n, rank) of all columns, from one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(names)])
    melted = rows.select(F.explode(cells).alias("c")).select("c.*")
    return value_ranks(melted, "value", ["column"])


def numbered_rows(rows: DataFrame) -> DataFrame:
    return cut(rows.withColumn("__row", F.monotonically_increasing_id()))


@dataclass(frozen=True)
class Cuts:
    """The value ranges of a column: bounds, which of them are heavy values, and the rows below each range.

    Range 2k lies above bound k - 1, up to bound k; a heavy bound k is a range of its own, 2k + 1.
    """
    bounds: np.ndarray
    heavy: np.ndarray
    below: np.ndarray | None = None
    held: np.ndarray | None = None

    def ranges(self, v: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.bounds, v)
        if not len(self.bounds):
            return k
        at = np.minimum(k, len(self.bounds) - 1)
        return 2 * k + (self.heavy[at] & (self.bounds[at] == v))

    def counted(self, held: np.ndarray) -> "Cuts":
        return Cuts(self.bounds, self.heavy, np.cumsum(held) - held, held)


def value_cuts(rows: DataFrame, names: list[str], parts: int) -> list[Cuts]:
    """Bounds of each column at its quantiles; a quantile met twice is a heavy value."""
    probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    if parts < 2:
        return [Cuts(np.array([]), np.array([], bool)) for _ in names]
    row = rows.agg(*[F.percentile_approx(F.col(f"`{c}`"), probs, F.lit(20 * parts)).alias(f"q{i}") for i, c in enumerate(names)]).first()
    out = []
    for q in row:
        bounds, times = np.unique(np.array(q or [], float), return_counts=True)
        out.append(Cuts(bounds, times > 1))
    return out


def counted_cuts(rows: DataFrame, names: list[str], cuts: list[Cuts]) -> list[Cuts]:
    """The same with the rows in and below every range: columns x ranges numbers reach the driver."""
    def count(batches):
        held = [np.zeros(2 * len(c.bounds) + 2, np.int64) for c in cuts]
        for batch in batches:
            for i, c in enumerate(cuts):
                held[i] += np.bincount(c.ranges(batch.column(i).to_numpy(zero_copy_only=False)), minlength=len(held[i]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array(list(held), pa.list_(pa.int64()))], ["column", "held"])

    found = rows.select(*[f"`{c}`" for c in names]).mapInArrow(count, "column int, held array<long>") \
        .select("column", F.posexplode("held").alias("range", "n")).groupBy("column", "range").agg(F.sum("n").alias("n")).where("n > 0").collect()
    held = [np.zeros(2 * len(c.bounds) + 2, np.int64) for c in cuts]
    for r in found:
        held[r["column"]][r["range"]] = r["n"]
    return [c.counted(h) for c, h in zip(cuts, held)]


_PIECE = "column int, range int, block long, at array<int>, {} array<double>"


def _pieces(rows: DataFrame, names: list[str], cuts: list[Cuts], heavy: bool) -> DataFrame:
    """Rows of a block with values in one range of a column: their places, and their values, or their one rank in a heavy range."""
    name = "ranks" if heavy else "values"

    def lay(batches):
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield from cells(pa.Table.from_batches(kept))
                kept, n = [], 0
        if kept:
            yield from cells(pa.Table.from_batches(kept))

    def cells(table):
        key = table.column(0).to_numpy()
        values = [table.column(i + 1).to_numpy() for i in range(len(cuts))]
        edges = np.flatnonzero(np.diff(key // BLOCK_ROWS, prepend=-1, append=-1))
        for a, z in zip(edges[:-1], edges[1:]):
            at, out = (key[a:z] % BLOCK_ROWS).astype(np.int32), []
            for i, c in enumerate(cuts):
                v = values[i][a:z]
                code = c.ranges(v)
                order = np.argsort(code, kind="stable")
                ends = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1))
                for s, e in zip(ends[:-1], ends[1:]):
                    r, which = int(code[order[s]]), order[s:e]
                    if r % 2 == heavy:
                        out.append((i, r, at[which], np.array([c.below[r] + (c.held[r] + 1) / 2.0]) if heavy else v[which]))
            if out:
                column, ranges, places, found = zip(*out)
                yield pa.RecordBatch.from_arrays([
                    pa.array(column, pa.int32()), pa.array(ranges, pa.int32()), pa.array([int(key[a]) // BLOCK_ROWS] * len(out), pa.int64()),
                    pa.array(places, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.float64()))], ["column", "range", "block", "at", name])

    return rows.select("__row", *[f"`{c}`" for c in names]).mapInArrow(lay, _PIECE.format(name))


def midranks(v: np.ndarray) -> np.ndarray:
    """Average ranks of some values, from 1."""
    order = np.argsort(v)
    s = v[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    held = np.diff(np.append(first, len(s)))
    out = np.empty(len(v))
    out[order] = np.repeat(first + (held + 1) / 2.0, held)
    return out


def rank_pieces(rows: DataFrame, names: list[str], cuts: list[Cuts]) -> DataFrame:
    """(column, range, block, at, ranks) of all rows: a range is ranked in one task, heavy values need none.

    A range holds about RANGE_ROWS rows whatever the table's size and values, and the
    partitions grow with the cells that travel.
    """
    def rank(table):
        values = table.column("values").combine_chunks()
        below = cuts[table.column("column")[0].as_py()].below[table.column("range")[0].as_py()]
        ranks = midranks(values.flatten().to_numpy(zero_copy_only=False)) + below
        ranks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())]), pa.int32()), pa.array(ranks))
        return table.drop_columns(["values"]).append_column("ranks", ranks)

    cells = sum(int(c.held[::2].sum()) for c in cuts)
    n = max(parallelism(rows.sparkSession), -(-cells // PART_CELLS))
    travel = _pieces(rows, names, cuts, False).repartition(n, "column", "range")
    return travel.groupBy("column", "range").applyInArrow(rank, _PIECE.format("ranks")).unionByName(_pieces(rows, names, cuts, True))


def rank_gram(rows: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
    """Sums of products of the centred average ranks as (i, row), and the number of rows.

    ``rows`` is a table of numbered rows without null or NaN. Average ranks have mean
    (n + 1) / 2 exactly, so centring costs no pass. Ranks come back to blocks of
    BLOCK_ROWS rows, which a task multiplies.
    """
    parts = -(-rows.count() // RANGE_ROWS)
    cuts = counted_cuts(rows, names, value_cuts(rows, names, parts))
    n, d = int(cuts[0].held.sum()), len(names)

    def multiply(table):
        z = np.zeros((BLOCK_ROWS, d))                           # rows left out add nothing
        for i, at, ranks in zip(table.column("column").to_pylist(), table.column("at"), table.column("ranks")):
            z[at.values.to_numpy(), i] = ranks.values.to_numpy() - (n + 1) / 2.0
        return pa.table({"i": pa.array(np.arange(d, dtype=np.int32)), "row": pa.array(list(z.T @ z), pa.list_(pa.float64()))})

    tasks = max(parallelism(rows.sparkSession), -(-n * d // PART_CELLS))
    back = rank_pieces(rows, names, cuts).repartition(tasks, "block")
    return sum_rows(back.groupBy("block").applyInArrow(multiply, "i int, row array<double>"), ["i"]), n


def spearman(rows: DataFrame, names: list[str], key: str | None = None) -> DataFrame:
    """(i, j, a, b, rho, n) for i <= j.  A constant column has rho 0, and 1 with itself.

    Rows with a null or NaN in any of the columns are left out, and n counts the rest.
    Rows are told apart by a number of their own; a ``key`` is not needed and may repeat.
    """
    rows = numbered_rows(rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names]))
    for c in names:
        rows = rows.where(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")))
    sums, n = rank_gram(rows, names)
    gram = cut(sums.select("i", F.posexplode("row").alias("j", "s")))
    diagonal = gram.where("i = j").select("i", F.col("s").alias("d"))
    pairs = gram.where("i <= j").join(F.broadcast(diagonal), "i") \
        .join(F.broadcast(diagonal.select(F.col("i").alias("j"), F.col("d").alias("e"))), "j")
    flat = (F.col("d") < 1e-24) | (F.col("e") < 1e-24)
    raw = F.when(F.col("i") == F.col("j"), F.lit(1.0)).when(flat, F.lit(0.0)).otherwise(F.col("s") / F.sqrt(F.col("d") * F.col("e")))
    label = F.array(*[F.lit(c) for c in names])
    return pairs.select("i", "j", F.element_at(label, F.col("i") + 1).alias("a"), F.element_at(label, F.col("j") + 1).alias("b"),
                        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)).alias("rho"), F.lit(n).cast("long").alias("n"))


def audit_pairs(rows: DataFrame, columns: list[Expanded], key: str | None = None, cross_group_only: bool = True) -> DataFrame:
    """Pairs i < j with rho, whether they count, and adjusted p (1 for the others)."""
    names = [c.name for c in columns]
    staged = rows.select(*([key] if key else []), *[c.column.alias(c.name) for c in columns])
    rho = spearman(staged, names, key).where("i < j")
    lookup = lambda attr, at: F.element_at(F.array(*[F.lit(getattr(c, attr)) for c in columns]), F.col(at) + 1)
    pairs = rho.select("i", "j", "a", "b", lookup("group", "i").alias("group_a"), lookup("group", "j").alias("group_b"),
                       (lookup("factor", "i") != lookup("factor", "j")).alias("__other"), "rho", "n")
    counted = F.col("__other") & (F.col("group_a") != F.col("group_b")) if cross_group_only else F.col("__other")
    pairs = cut(pairs.withColumn("considered", counted).drop("__other").withColumn("p", fisher_z_p(F.col("rho"), F.col("n"))))
    adjusted = holm(pairs.where("considered"), "p", ["considered"]).select("i", "j", "p_holm")
    return pairs.join(adjusted, ["i", "j"], "left").withColumn("p_holm", F.coalesce("p_holm", F.lit(1.0)))


def gate_scenes(requested: int, least: int = MIN_SCENES) -> int:
    """Scenes to draw for a gate: at least so many that the bound is no noise; the report keeps the requested number beside it."""
    return max(int(requested), int(least))


def verdict(pairs: DataFrame, threshold: float = 0.10, alpha: float = 0.01) -> DataFrame:
    """Passes when no considered pair is large and none significant."""
    c = F.col("considered")
    size = F.when(c, F.abs("rho"))
    out = pairs.agg(F.max("n").alias("n_scenes"), F.coalesce(F.max(size), F.lit(0.0)).alias("max_abs_rho"),
                    F.max_by(F.struct("a", "b"), size).alias("__w"), F.sum(c.cast("long")).alias("n_pairs_considered"),
                    F.sum((c & (F.col("p_holm") < alpha)).cast("long")).alias("n_significant_after_holm"))
    return out.select("n_scenes", "max_abs_rho", F.col("__w.a").alias("worst_a"), F.col("__w.b").alias("worst_b"),
                      "n_pairs_considered", "n_significant_after_holm",
                      ((F.col("max_abs_rho") <= threshold) & (F.col("n_significant_after_holm") == 0)).alias("passed"))


def derived_columns(frames: DataFrame, factors: DataFrame, scene: str, targets: list[str]) -> tuple[DataFrame, list[Expanded]]:
    """Scene means of measured targets beside the sampled factors; for an advisory audit."""
    means = frames.groupBy(scene).agg(*[F.avg(F.col(t).cast("double")).alias(t) for t in targets])
    return factors.join(means, scene), [e for t in targets for e in expand(t, "physical", circular=False)]


def heat_map(rho: DataFrame, names: list[str]) -> DataFrame:
    """The square matrix, one row per column name."""
    both = rho.select("a", "b", "rho").unionByName(rho.where("i < j").select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
    return both.groupBy("a").pivot("b", names).agg(F.max("rho"))
