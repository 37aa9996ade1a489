"""Sharding: minimax contiguous partition of groups of equal texts.

Groups lie in the order of a hash of their text. The smallest capacity for which a
greedy walk needs no more than the given shards is found by bisection; the cuts made
lie under that capacity too, but more evenly than the walk's (even_cuts). The driver sees the order only as bins with their sums: a bin
is a range of hashes. A walk over whole bins is feasible if it ends in time; a walk
that may split bins is infeasible if it ends too late; where the two disagree, only
the bins between their cuts are split further. So the capacity is exact, while the
driver holds some ten thousands of sums at any input size.
"""
from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut, unsigned32

OVERHEAD = 16
TOP_BITS = 14                   # bins at first: 2^14
STEP_BITS = 6                   # a bin is split in 2^6
SLOT_BINS, SLOT_SALTS = 1024, 64


def group_hash(text: Column) -> Column:
    """62 bits of a hash of the text: the place of its group in the order."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2)


BITS = 62


class Order:
    """The groups in order, as bins (first hash, hash bits in the bin, bytes, groups, largest group)."""

    def __init__(self, bins):
        self.set(bins)

    def set(self, bins):
        self.bins = sorted(bins)
        self.ends = list(accumulate(b[2] for b in self.bins))
        self.total = self.ends[-1] if self.bins else 0
        self.largest = max((b[4] for b in self.bins), default=0)

    def walk(self, capacity: int, split: bool) -> list[int]:
        """Index of the bin in which each next shard begins; with ``split`` a shard may take part of a bin."""
        cuts, at, n = [], 0, len(self.bins)
        while True:
            i = bisect.bisect_right(self.ends, at + capacity)
            if i >= n:
                return cuts
            if split and self.bins[i][3] > 1:
                at = max(at + capacity, self.ends[i - 1] if i else 0)
            else:
                at = self.ends[i - 1] if i else 0
            cuts.append(i)
            if len(cuts) > 10_000_000:
                raise RuntimeError("no progress")


def smallest_capacity(order: Order, shards: int, refine) -> int:
    """Bisects the capacity; ``refine(bins)`` returns the given bins split further."""
    low, high = max(-(-order.total // shards), order.largest), max(order.total, 1)   # high is feasible
    while low < high:
        mid = (low + high) // 2
        while True:
            atomic_fits = mid >= max(b[2] for b in order.bins)
            if atomic_fits and len(order.walk(mid, False)) < shards:
                high = mid
                break
            hopeful = order.walk(mid, True)
            if len(hopeful) >= shards:
                low = mid + 1
                break
            coarse = order.walk(mid, False) if atomic_fits else []
            wide = {i for a, b in zip(coarse, hopeful) for i in range(min(a, b), max(a, b) + 1)} if atomic_fits else set()
            wide |= {i for i, b in enumerate(order.bins) if b[2] > mid}
            wide = [i for i in wide if order.bins[i][3] > 1 and order.bins[i][1] > 0]
            if not wide:                                       # every bin that matters is one group
                wide = [i for i, b in enumerate(order.bins) if b[3] > 1 and b[1] > 0]
                if not wide:
                    raise RuntimeError("bins of one group leave nothing open")
            chosen = [order.bins[i] for i in wide]
            gone = set(wide)
            order.set([b for i, b in enumerate(order.bins) if i not in gone] + refine(chosen))
    return low


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Equal texts stay together; a null text counts as an empty one. Null and repeated
    ids are kept, each row with a slot of its own. An empty table gives no rows. The
    order within a shard is that of bins of the hash, then ids. ``docs`` needs doc_id
    and text; other columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), unsigned32(F.col("text")).alias("text_crc32"), group_hash(F.col("text")).alias("_h")))
    groups = cut(rows.groupBy("_h").agg(F.sum("size").alias("bytes")))
    cuts = boundaries(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("_h") >= F.lit(c)).cast("int")
    placed = rows.withColumn("shard", shard.cast("int"))
    placed = placed.withColumn("_b", F.shiftrightunsigned("_h", BITS - 10).cast("int")).withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_SALTS)).cast("int"))
    cell = ["shard", "_b", "_s"]
    earlier = Window.partitionBy("shard").orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("_h", "doc_id")) - 1
    numbered = placed.withColumn("_i", inside).join(starts.drop("_n"), cell)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_start") + F.col("_i")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def boundaries(groups: DataFrame, shards: int) -> list[int]:
    """First hash of each shard but the first, for groups (_h, bytes)."""
    def summed(df: DataFrame, bits: int) -> list[tuple]:
        first = F.shiftleft(F.shiftrightunsigned("_h", bits), bits)
        out = df.groupBy(first.alias("first"), F.lit(bits).alias("bits")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("m"))
        return [tuple(r) for r in out.toLocalIterator()]

    def refine(bins: list[tuple]) -> list[tuple]:
        out, by_bits = [], {}
        for b in bins:
            by_bits.setdefault(b[1], []).append(b[0])
        for bits, firsts in by_bits.items():
            wanted = groups.sparkSession.createDataFrame([(f,) for f in firsts], "_first long")
            inside = groups.withColumn("_first", F.shiftleft(F.shiftrightunsigned("_h", bits), bits)).join(wanted, "_first", "left_semi")
            out += summed(inside, max(bits - STEP_BITS, 0))
        return out

    order = Order(summed(groups, BITS - TOP_BITS))
    if not order.bins:
        return []
    capacity = smallest_capacity(order, shards, refine)
    return even_cuts(order, capacity, shards)


def even_cuts(order: Order, capacity: int, shards: int) -> list[int]:
    """Cuts under the capacity that use all shards: a shard closes at the mean of what is left, as long as the rest still fits.

    Bins count as whole; those that decided the capacity are single groups by then.
    """
    ends, n = order.ends, len(order.bins)
    need = [0] * (n + 1)                        # shards that the greedy walk needs from bin i on
    for i in range(n - 1, -1, -1):
        at = ends[i - 1] if i else 0
        j = bisect.bisect_right(ends, at + capacity)
        need[i] = 1 + need[max(j, i + 1)]
    cuts, i = [], 0
    for left in range(shards, 1, -1):
        at = ends[i - 1] if i else 0
        goal = at + (order.total - at) / left
        last = bisect.bisect_right(ends, at + capacity)         # furthest end under the capacity
        j = bisect.bisect_left(ends, goal) + 1
        if j - 1 > i and j - 1 <= n - 1 and abs(ends[j - 2] - goal) < abs(ends[j - 1] - goal):
            j -= 1
        j = min(max(j, i + 1), max(last, i + 1))
        while j < min(last, n) and need[j] > left - 1:
            j += 1
        if j >= n:
            break
        cuts.append(order.bins[j][0])
        i = j
    return cuts
