"""Mixing sources to target weights, by keyed shuffles and exact cuts.

Every document draws a key from its id. Within its source the documents lie in the
order of their keys; running sums of their word counts are made in two levels (bins
of keys, then rows in a bin), so a source with a third of all rows is spread over
all tasks. A source with budget T and S words is read T div S times whole, and then
up to word T mod S: the document that straddles that point is cut there.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from heldout.functions import keyed

from .shared import cut, words_in

BINS = 4096
#: Fixed values of the contract: weights by source in turn, share of all words, most passes over a source.
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
PASSES = 2


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, passes: int = PASSES) -> list[tuple[str | None, int, float]]:
    """(source, words, target) for each source.

    The sources share ``share`` of all words by weight; a target stops at ``passes``
    times its source and what is left over goes to the others by weight. Sums are
    integers, so each target is one division of exact values.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    size = dict(order)
    up, down = share
    total, open_, full = sum(size.values()), set(size), set()
    while True:
        left = up * total - down * passes * sum(size[s] for s in full)      # in parts of 1 / down
        spread = down * sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] > passes * size[s] * spread}
        if not above:
            break
        open_, full = open_ - above, full | above
    return [(s, n, float(passes * n) if s in full else left * weight[s] / spread) for s, n in order]


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share=SHARE, passes: int = PASSES) -> DataFrame:
    """Adds source_size, target and taken (words taken, repeats counted) to rows (doc_id, source, size, ...).

    The rows are read twice, so pass a table, not a long plan. Rows of one id draw one
    key and follow by size, then by a hash of their other columns, so any order of the
    rows gives the same words; rows without an id draw keys by size. A null source is a
    source of its own, last in the order; a null size counts as 0. Other columns pass
    through; those named as an added column get ``_given`` behind their name. An empty
    table gives no rows. The driver holds one row per source, nothing per document.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("doc_id", "source", "size")]
    size = F.coalesce("size", F.lit(0)).cast("long")
    held = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), size))
    rows = docs.select("doc_id", "source", size.alias("size"), held.alias("_held"), keyed.uniform(seed, key).alias("_u"))
    rows = rows.withColumn("_bin", F.floor(F.col("_u") * BINS).cast("int")).withColumn("_tie", _hash_of(docs, others))
    sums = cut(rows.groupBy("source", "_bin").agg(F.sum("size").alias("_sum")))
    per_source = [(r[0], r[1]) for r in sums.groupBy("source").agg(F.sum("_sum")).toLocalIterator()]
    plan = spark.createDataFrame(targets(per_source, weights, share, passes), "_source string, source_size long, target double")
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = sums.withColumn("_before", F.coalesce(before, F.lit(0))).join(plan, F.col("source").eqNullSafe(F.col("_source")))
    bins = bins.select(F.col("source").alias("_source"), F.col("_bin").alias("_b"), "_before", "source_size", "target")
    inside = F.sum("size").over(Window.partitionBy("source", "_bin").orderBy("_u", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_end", inside).join(bins, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bin") == F.col("_b")))
    budget, start = F.round("target").cast("long"), F.col("_before") + F.col("_end") - F.col("size")
    passed = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - passed * F.col("source_size")
    taken = passed * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    added = {"source_size": F.col("source_size"), "target": F.col("target"), "taken": taken.cast("long")}
    return placed.select("doc_id", "source", "size", *[F.col("_held").getField(c).alias(f"{c}_given" if c in added else c) for c in others], *[v.alias(c) for c, v in added.items()])


def _hash_of(docs: DataFrame, names: list[str]):
    """A hash of the columns that Spark can hash, read from ``_held``."""
    plain = [c for c in names if "map<" not in docs.schema[c].dataType.simpleString()]
    return F.xxhash64(*[F.col("_held").getField(c) for c in plain]) if plain else F.lit(0).cast("long")


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """One row per pass over a document; the pass that a budget ends in keeps the words before the cut.

    A document without words stays once if its source is taken at all. Null texts stay null.
    """
    passes = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).when((F.col("target") > 0) | (F.col("source_size") == 0), F.lit(1)).otherwise(F.lit(0)).cast("int")
    each = mixed.withColumn("_pass", F.explode(F.when(passes > 0, F.sequence(F.lit(1), passes)).otherwise(F.array().cast("array<int>"))))
    left = (F.col("taken") - (F.col("_pass") - 1) * F.col("size")).cast("int")
    head = F.array_join(F.slice(F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.greatest(left, F.lit(1))), "")
    return each.withColumn(text, F.when((F.col("size") > 0) & (left < F.col("size")), head).otherwise(F.col(text))).drop("_pass")


def sized(docs: DataFrame) -> DataFrame:
    """Adds the word count of the text as ``size``; a column of that name becomes ``size_given``."""
    return docs.select(*[F.col(f"`{c}`").alias("size_given" if c == "size" else c) for c in docs.columns], words_in(F.col("text")).alias("size"))
