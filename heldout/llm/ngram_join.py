"""N-gram Jaccard join with parity sketches.

Two sets with Jaccard similarity s or more differ in at most (1 - s) / (1 + s) of the
sum of their sizes. Each set is dealt to blocks by hash; a block keeps the parity of
its elements (the XOR of their hashes, and bits for the distance). An element in which
two sets differ touches one block, so of D + 1 + T blocks at least T + 1 are equal if
the sets differ in D elements at most: sets are joined on equal blocks per band of
sizes. Empty blocks say nothing: T is so large that few sets have more empty blocks
than that, and they are left out. If all equal blocks of two sets are empty, both have
more than T and T + 1 in common at least; sets with more than T also join on small
groups of their first empty blocks, which no longer are the same in sets at random.
A set with U blocks in use shares U - D keys with each of its partners at least: sets
that share fewer with all others together have none and leave before families form.

Joined sets form families (components of "same block"). Within a family, pairs of the
right sizes are compared: Hamming distance of parity bits, a lower bound of the
difference, then the sets themselves. Families beyond a bound are cut into cells, and
each pair of cells is a task of its own, so nothing is left out and no task grows. A
task returns a spanning forest of the links it found, never all pairs.
"""
from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .shared import cut, slices
from .shingles import U, mixed, shingle_set, word_hashes

BAND = 1.5
CELL_SETS, CELL_SHINGLES = 1024, 1 << 21
FINE = 1.25                       # ratio of the size bands of cells
SKETCH_WORDS = 32
SEEN = 1_000_000
ROUNDS = 2                        # how often sets that share too few keys leave
EMPTY, RARE = 3, 2.5              # empty blocks to a key; standard deviations between the usual number of blocks in use and the least that needs no such key


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    column = batch.column(name)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def most_different(total: int, percent: int) -> int:
    """Most elements in which two sets of ``total`` elements together may differ."""
    return total * (100 - percent) // (100 + percent)


def bands(percent: int, top: int = 1 << 40) -> list[int]:
    """First size of each band."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND)))
    return out


def blocks_of(lows: list[int], g: int, percent: int) -> tuple[int, int]:
    """(blocks, T) of band g, which also takes the larger sets of band g - 1."""
    return _blocks(lows[g], lows[g + 1], percent)


@lru_cache(maxsize=None)
def _blocks(low: int, high: int, percent: int) -> tuple[int, int]:
    d = most_different(2 * (high - 1), percent)
    least = -(-percent * low // 100)
    spare = 1 + (d + 1) // 16
    while True:
        count = d + 1 + spare
        free = math.exp(-least / count)
        used, spread = count * (1 - free), math.sqrt(count * max(0.0, free - (1 + least / count) * free * free))
        if used - RARE * spread >= d + 1 or spare > 4 * (d + 1):
            return count, spare
        spare += 1 + spare // 32


def keys_by_band(s: np.ndarray, lows: list[int], percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, least number of keys in common with a partner, join keys) of a sorted set: for its own band and, for a set near the band's end, the next."""
    out, n = [], len(s)
    g = int(np.searchsorted(lows, n, "right")) - 1
    for group in (g, g + 1):
        if group > g and 100 * n < percent * lows[group]:
            break
        count, spare = blocks_of(lows, group, percent)
        block = ((s >> U(32)) * U(count)) >> U(32)              # ascending, as s is
        first = np.flatnonzero(np.diff(block, prepend=U(1 << 40)))
        parity = np.bitwise_xor.reduceat(mixed(s + U(group)), first)
        keys = mixed(parity + mixed(block[first] * U(1 << 20) + U(group)))
        if count - len(first) > spare:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), block[first])
            some = min(EMPTY, spare + 1)                        # of T + 1 common ones, so many are among the first of both sets
            told = np.array(list(combinations(empty[:len(empty) - spare - 1 + some], some)), np.uint64)
            key = np.full(len(told), group, np.uint64)
            for column in told.T:
                key = mixed(key + mixed(column + U(1)))
            keys = np.concatenate([keys, mixed(key)])
        out.append((group, max(1, len(first) + spare + 1 - count), keys))
    return out


def block_keys(s: np.ndarray, lows: list[int], percent: int) -> np.ndarray:
    """All join keys of a sorted set."""
    return np.concatenate([keys for _, _, keys in keys_by_band(s, lows, percent)])


def _signatures(k: int):
    def run(batches):
        for batch in slices(batches):
            ids, rows = batch.column(0), {"n": [], "s1": [], "s2": []}
            for words in word_hashes(_texts(batch, "text")):
                s = shingle_set(words, k)
                rows["n"].append(len(s))
                for name, value in zip(("s1", "s2"), signature(s)):
                    rows[name].append(value)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(rows[x], pa.int64()) for x in ("n", "s1", "s2"))], ["doc_id", "n", "s1", "s2"])
    return run


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit values of a set."""
    if not len(s):
        return 0, 0
    return int(np.bitwise_xor.reduce(mixed(s)).astype(np.int64)), int(np.add.reduce(mixed(s ^ U(0x5BD1E995))).astype(np.int64))


def _keys(k: int, percent: int):
    """(least, node, key) of each set; a task emits a set once, however many copies it reads (of the last SEEN sets).

    ``least`` is twice the number of keys that a partner shares, plus the last bit of the
    band, which tells the two bands of a set apart.
    """
    def run(batches):
        lows, seen = bands(percent), set()
        for batch in slices(batches):
            leasts, keys, owners = [], [], []
            for words in word_hashes(_texts(batch, "text")):
                s = shingle_set(words, k)
                node = signature(s)[0]
                if not len(s) or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                for band, least, found in keys_by_band(s, lows, percent):
                    keys.append(found.view(np.int64))
                    owners.append(np.full(len(found), node, np.int64))
                    leasts.append(np.full(len(found), 2 * least + band % 2, np.int32))
            if keys:
                columns = [np.concatenate(x) for x in (leasts, owners, keys)]
                for a in range(0, len(columns[0]), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a:a + 65536]) for x in columns], ["least", "node", "key"])
    return run


def _sets(k: int):
    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(w, k).tobytes() for w in word_hashes(_texts(batch, "text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(sets, pa.binary())], [*batch.schema.names[:-1], "shingles"])
    return run


def parity_bits(s: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS words of 64 bits; each element flips one bit."""
    bit = mixed(s ^ U(0x2545F4914F6CDD1D)) % U(64 * SKETCH_WORDS)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets; with ``side``, only of links between side 0 and 1."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    bits = np.array([parity_bits(sets[i]) for i in order]).reshape(len(sets), SKETCH_WORDS)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ends, forest = np.searchsorted(sizes, sizes * 100 // percent, "right"), []
    for i in range(len(sets)):
        j0, j1 = i + 1, int(ends[i])
        if j0 >= j1:
            continue
        far = np.bitwise_count(bits[j0:j1] ^ bits[i]).sum(1, dtype=np.int64)
        near = far <= (sizes[j0:j1] + sizes[i]) * (100 - percent) // (100 + percent)
        if side is not None:
            near &= side[order[j0:j1]] != side[order[i]]
        for j in np.flatnonzero(near) + j0:
            a, b = find(i), find(int(j))
            if a == b:
                continue
            both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
            if 100 * both >= percent * (int(sizes[i]) + int(sizes[j]) - both):
                root[b] = a
                forest.append((int(order[i]), int(order[j])))
    return forest


def _compare(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["doc_id", "shingles", "side"])
        ids = group["doc_id"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        side = group["side"].to_numpy() if group["two"].iloc[0] else None
        pairs = linked(sets, percent, side)
        return pd.DataFrame({"a": [ids[i] for i, _ in pairs], "b": [ids[j] for _, j in pairs]}, columns=["a", "b"]).astype("int64")
    return run


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their sets of k
    word shingles; component_id is the smallest doc_id reachable by links. Null and
    empty texts and texts without words have no shingles and no links. Rows with the
    same id are one document, linked as any of them; rows without an id have no part
    in links unless an equal set has one (then its component, else null). An empty
    table gives no rows. Words are compared by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(docs.mapInArrow(_signatures(k), "doc_id long, n long, s1 long, s2 long"))
    alike = ["n", "s1", "s2"]
    classes = cut(rows.where("n > 0").groupBy(*alike).agg(F.min("doc_id").alias("rep")))
    edges = _candidates(docs, k, percent)
    families = components(edges, "node", "first").select(F.col("node").alias("s1"), F.col("component").alias("family"))
    members = cut(families.join(classes.where("rep is not null"), "s1").select(F.col("rep").alias("doc_id"), "n", "family"))
    links = cut(_links(docs, members, k, percent))
    found = components(links, "a", "b")
    named = rows.join(classes, alike, "left").join(found, F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _candidates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, first): sets with a block in common, as stars around the least set of the block."""
    keys, by_key = docs.select("text").mapInArrow(_keys(k, percent), "least int, node long, key long"), Window.partitionBy("key")
    for _ in range(ROUNDS):
        met = keys.withColumn("low", F.min("node").over(by_key)).withColumn("high", F.max("node").over(by_key)).where("low < high")
        met = met.select("least", "node", "key").distinct().withColumn("common", F.count(F.lit(1)).over(Window.partitionBy("node", "least")))
        keys = cut(met.where(F.col("common") >= F.floor(F.col("least") / 2)).select("least", "node", "key"))
    first = F.min("node").over(by_key)
    return keys.withColumn("first", first).where(F.col("first") < F.col("node")).select("node", "first").distinct()


def _links(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    reach = math.ceil(math.log(100 / percent) / math.log(FINE))
    fine = F.floor(F.log("n") / math.log(FINE)).cast("int")
    whole = members.groupBy("family").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_s"))
    members = members.join(whole, "family")
    small = (F.col("_c") <= CELL_SETS) & (F.col("_s") <= CELL_SHINGLES)
    large = members.where(~small).withColumn("fine", fine)
    per = large.groupBy("family", "fine").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CELL_SETS, F.sum("n") / CELL_SHINGLES)).cast("int").alias("m"))
    per = cut(per)
    ahead = per.select("family", F.explode(F.sequence(F.col("fine"), F.col("fine") + reach)).alias("other"), "fine", "m")
    pairs = ahead.join(per.select("family", F.col("fine").alias("other"), F.col("m").alias("m2")), ["family", "other"])
    # each member goes to the pairs of its cell with every cell of the same and the next size bands
    spot = large.join(per, ["family", "fine"]).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.col("m")).cast("int"))
    first = spot.join(pairs.select("family", "fine", "other", "m2"), ["family", "fine"]).select(
        "family", "doc_id", "fine", "cell", "other", F.explode(F.sequence(F.lit(0), F.col("m2") - 1)).alias("cell2"), F.lit(0).alias("side"))
    first = first.where((F.col("fine") < F.col("other")) | (F.col("cell") <= F.col("cell2")))
    second = spot.select("family", "doc_id", F.col("fine").alias("other"), F.col("cell").alias("cell2")).join(pairs.select("family", "fine", "other", "m"), ["family", "other"]).select(
        "family", "doc_id", "fine", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("cell"), "other", "cell2", F.lit(1).alias("side"))
    second = second.where((F.col("fine") < F.col("other")) | (F.col("cell") < F.col("cell2")))
    columns = ["family", "doc_id", "fine", "cell", "other", "cell2", "side"]
    alone = members.where(small).select("family", "doc_id", *[F.lit(0).alias(c) for c in columns[2:]])
    tasks = alone.unionByName(first.select(*columns)).unionByName(second.select(*columns))
    spots = tasks.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in columns if c != "doc_id"])).alias("at"))
    spots = cut(spots)                                          # few as a rule: then they go to the texts, not the texts to them
    kind = spots.schema["at"].dataType.simpleString()
    sets = docs.join(spots, "doc_id").select("doc_id", "at", "text").mapInArrow(_sets(k), f"doc_id long, at {kind}, shingles binary")
    same = (F.col("fine") == F.col("other")) & (F.col("cell") == F.col("cell2"))
    work = sets.select("doc_id", F.explode("at").alias("at"), "shingles").select("doc_id", "at.*", "shingles").withColumn("two", ~same)
    return work.groupBy("family", "fine", "cell", "other", "cell2").applyInPandas(_compare(percent), "a long, b long")
