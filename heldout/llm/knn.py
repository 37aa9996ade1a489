"""Exact top-k inner products with a KD-tree per shard.

Rows are dealt to shards by hash. Each shard builds a tree of median splits whose nodes
keep tight boxes. A task holds a block of queries and a run of shards: every query walks
the trees best box first, by the largest inner product that a box allows, and stops when
no box can beat its k-th score; the k-th score goes on from shard to shard. A last step
merges the runs of each query.
"""
from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut

LEAF = 512
SHARD_ROWS = 8192
RUN = 8
QUERY_ROWS = 2048
SCALE = 64


def whole(vector: Column) -> Column:
    """floor(64 * x) of each component; null for a vector that is null or holds a null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long")))


class Tree:
    """Rows in leaf order, with the box, children and rows of each node."""

    def __init__(self, rows, ids, low, high, child, span):
        self.rows, self.ids, self.low, self.high, self.child, self.span = rows, ids, low, high, child, span

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray) -> "Tree":
        order, low, high, child, span = np.argsort(ids, kind="stable"), [], [], [], []

        def node(a: int, b: int) -> int:
            me, part = len(span), rows[order[a:b]]
            low.append(part.min(0))
            high.append(part.max(0))
            child.append((-1, -1))
            span.append((a, b))
            if b - a > LEAF and rows.shape[1]:
                widest, middle = int((high[me] - low[me]).argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, widest], middle)]
                child[me] = (node(a, a + middle), node(a + middle, b))
            return me

        node(0, len(rows))
        return cls(rows[order], ids[order], np.array(low), np.array(high), np.array(child), np.array(span))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, rows=self.rows, ids=self.ids, low=self.low, high=self.high, child=self.child, span=self.span)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> "Tree":
        z = np.load(io.BytesIO(data))
        return cls(*(z[k] for k in ("rows", "ids", "low", "high", "child", "span")))


def exact(values: np.ndarray, other: np.ndarray):
    """The type in which inner products of the two are exact: doubles while they stay below 2^53."""
    most = int(np.abs(values).max(initial=0)) * int(np.abs(other).max(initial=0)) * max(values.shape[1], 1)
    return np.float64 if most < 1 << 53 else np.int64


class Best:
    """The k best (score, id) of one query so far; ties go to smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def kth(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -math.inf

    def add(self, score: np.ndarray, ids: np.ndarray):
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[:self.k]
        self.score, self.ids = score[order], ids[order]


def search(tree: Tree, queries: np.ndarray, ids: np.ndarray, best: list[Best]) -> None:
    """Brings the k best of each query up to date with the rows of a tree."""
    kind = exact(tree.rows, queries)
    rows, q = tree.rows.astype(kind), queries.astype(kind)
    bound = np.maximum(q, 0) @ tree.high.astype(kind).T + np.minimum(q, 0) @ tree.low.astype(kind).T
    for i in range(len(q)):
        limit, mine = bound[i], best[i]
        heap = [(-limit[0], 0)]
        while heap and -heap[0][0] >= mine.kth:
            at = heapq.heappop(heap)[1]
            left, right = tree.child[at]
            if left >= 0:
                for c in (left, right):
                    if limit[c] >= mine.kth:
                        heapq.heappush(heap, (-limit[c], c))
                continue
            a, b = tree.span[at]
            score = rows[a:b] @ q[i]
            keep = np.flatnonzero((score >= mine.kth) & (tree.ids[a:b] != ids[i]))
            if len(keep):
                mine.add(score[keep].astype(np.int64), tree.ids[a:b][keep])


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    tree = Tree.build(np.array(group["v"].tolist(), np.int64).reshape(len(group), -1), group["id"].to_numpy())
    return pd.DataFrame({"dim": [group["dim"].iloc[0]], "shard": [group["shard"].iloc[0]], "tree": [tree.pack()]})


def _block(group: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    np.savez(out, rows=np.array(group["v"].tolist(), np.int64).reshape(len(group), -1), ids=group["id"].to_numpy())
    return pd.DataFrame({"dim": [group["dim"].iloc[0]], "block": [group["block"].iloc[0]], "queries": [out.getvalue()]})


def _search(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        z = np.load(io.BytesIO(group["queries"].dropna().iloc[0]))
        rows, ids = z["rows"], z["ids"]
        best = [Best(k) for _ in ids]
        for data in group.dropna(subset=["tree"]).sort_values("shard")["tree"]:
            search(Tree.unpack(data), rows, ids, best)
        which = np.repeat(np.arange(len(ids)), [len(b.ids) for b in best])
        return pd.DataFrame({"query_id": ids[which], "vec_id": np.concatenate([b.ids for b in best]), "score": np.concatenate([b.score for b in best])}).astype("int64")
    return run


def top(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` (vec_id, embedding) for the rows where ``queries`` holds.

    Vectors that are null or hold null or non-finite components, and rows without an
    id, take no part. A row is no candidate of queries of its id. Only vectors of equal
    length meet. Repeated rows count once; rows of one id with different vectors are
    different rows (as queries, they share the id's ranks). Scores must fit 63 bits.
    Fewer than k candidates give fewer rows, an empty table none.
    """
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), whole(F.col("embedding")).alias("v"), queries.alias("asks"))
    rows = cut(rows.where("v is not null").withColumn("dim", F.size("v")).dropDuplicates(["id", "v"]))
    counts = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("int")).alias("q")).toLocalIterator()}
    spark = rows.sparkSession
    plan = spark.createDataFrame([(d, -(-n // SHARD_ROWS), max(1, -(-(q or 0) // QUERY_ROWS))) for d, (n, q) in counts.items()], "dim int, shards long, blocks long")
    rows = rows.join(plan, "dim")
    shard = F.pmod(F.xxhash64("id"), F.col("shards"))
    trees = cut(rows.withColumn("shard", shard).select("dim", "shard", "id", "v").groupBy("dim", "shard").applyInPandas(_pack, "dim int, shard long, tree binary"))
    asked = rows.where("asks").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))).select("dim", "block", "shards", "id", "v")
    blocks = cut(asked.groupBy("dim", "block").applyInPandas(_block, "dim int, block long, queries binary"))
    run = F.floor(F.col("shard") / RUN).cast("long")
    spread = blocks.join(plan, "dim").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shards") - 1) / RUN).cast("long"))))
    met = trees.withColumn("run", run).join(plan, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    work = spread.select("dim", "block", "run", "queries", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("binary").alias("tree")).unionByName(
        met.select("dim", "block", "run", F.lit(None).cast("binary").alias("queries"), "shard", "tree").join(blocks.select("dim", "block"), ["dim", "block"], "left_semi"))
    found = work.groupBy("dim", "block", "run").applyInPandas(_search(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
