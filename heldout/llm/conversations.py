"""Repair of conversations: bidirectional Dijkstra over the edit lattice.

A conversation is well formed if the initials of its roles read (s?(ua)+)?. The nodes
of the edit lattice are (rows read, state); edges keep, rerole or delete the next row
or insert an empty one, each at its cost. One heap goes forward from the start, one in
reverse from the end; when their tops add up to more than the best crossing, all
crossings of that cost are known, and the one with the least concatenated audit wins.
Nodes leave a heap by (cost, rows read in its direction), so every way of equal cost to
a node has arrived before it leaves, and its least audit is final. Two audits of equal
cost over the same rows never begin one another, so audits may be compared part by part.

Rows are put in order once, by range, and numbered within their conversation without a
window over it. Chunks of CHUNK rows are solved on their own, from every state to every
state; inserts stand before the row that follows them. A conversation of one chunk is
done; the matrices of others are multiplied (min, then least audit), FAN at a time.
"""
from __future__ import annotations

from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut

CHUNK, FAN = 512, 64
#: Fixed values of the contract: costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults of a row: the first that holds counts.
FINE, BLANK, DUPLICATE, CUT_OFF = 0, 1, 2, 3
FAULTS = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": CUT_OFF}

#: States: nothing told, s told, u told, a told; and the state that each initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LEFT_BY = tuple({x: [s for s in range(4) if NEXT[s].get(x) == t] for x in "sua"} for t in range(4))
ENDS = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}

Way = tuple[int, str]


def _steps(initial: str, fault: int) -> list[tuple[str, int, tuple[str, ...]]]:
    """(edit, cost, initials told) of the edits that a row allows."""
    if fault in (BLANK, DUPLICATE):
        return [("D", DELETE, ())]
    extra = TRUNCATED if fault == CUT_OFF else 0
    return [("K", KEEP + extra, (initial,)), ("R", REROLE + extra, ("u", "a")), ("D", DELETE, ())]


def least_way(initials: str, faults: str, start: int, ends: tuple[int, ...], closing: bool) -> Way | None:
    """(cost, audit) of the cheapest edits of some rows from state ``start`` to one of ``ends``; None without a way.

    ``initials`` has a character per row, ``faults`` a digit. With ``closing`` inserts
    may follow the last row.
    """
    n = len(initials)
    steps = [_steps(x, int(f)) for x, f in zip(initials, faults)]
    fore: dict[tuple[int, int], Way] = {(0, start): (0, "")}
    back: dict[tuple[int, int], Way] = {(n, t): (0, "") for t in ends}
    heap, paeh = [(0, 0, start)], [(0, 0, t) for t in sorted(ends)]
    done, enod = set(), set()
    best: int | None = 0 if (0, start) in back else None

    def forward(node, cost, audit):
        old = fore.get(node)
        if old is None or (cost, audit) < old:
            fore[node] = (cost, audit)
            if old is None or cost < old[0]:
                heappush(heap, (cost, *node))

    def reverse(node, cost, audit):
        old = back.get(node)
        if old is None or (cost, audit) < old:
            back[node] = (cost, audit)
            if old is None or cost < old[0]:
                heappush(paeh, (cost, n - node[0], node[1]))

    def crossed(node):
        nonlocal best
        if node in fore and node in back:
            both = fore[node][0] + back[node][0]
            best = both if best is None else min(best, both)

    while heap and paeh and (best is None or heap[0][0] + paeh[0][0] <= best):
        if heap[0][0] <= paeh[0][0]:
            cost, i, state = heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            audit = fore[i, state][1]
            told = []
            if i < n:
                for edit, price, initials_told in steps[i]:
                    for x in initials_told or ("",):
                        to = NEXT[state].get(x) if x else state
                        if to is not None:
                            told.append(((i + 1, to), cost + price, audit + edit))
            if i < n or closing:
                told += [((i, NEXT[state][x]), cost + INSERT, audit + "I") for x in "ua" if x in NEXT[state]]
            for node, price, text in told:
                forward(node, price, text)
                crossed(node)
        else:
            cost, left, state = heappop(paeh)
            i = n - left
            if (i, state) in enod:
                continue
            enod.add((i, state))
            audit = back[i, state][1]
            told = []
            if i:
                for edit, price, initials_told in steps[i - 1]:
                    for x in initials_told or ("",):
                        told += [((i - 1, s), cost + price, edit + audit) for s in (LEFT_BY[state].get(x, ()) if x else (state,))]
            if i < n or closing:
                told += [((i, s), cost + INSERT, "I" + audit) for x in "ua" for s in LEFT_BY[state][x]]
            for node, price, text in told:
                reverse(node, price, text)
                crossed(node)
    if best is None:
        return None
    return best, min(way[1] + back[node][1] for node, way in fore.items() if node in back and way[0] + back[node][0] == best)


def matrix(initials: str, faults: str, first: bool, last: bool) -> list[Way | None]:
    """The least way from each state to each state; only START for the first chunk, and only ends, as one, for the last."""
    starts = (START,) if first else range(4)
    if last:
        return [least_way(initials, faults, s, ENDS, True) if s in starts else None for s in range(4)]
    return [least_way(initials, faults, s, (t,), False) if s in starts else None for s in range(4) for t in range(4)]


def times(a: list[Way | None], b: list[Way | None]) -> list[Way | None]:
    """The ways through both, one after the other; b has four columns, or one if it is the last."""
    columns = len(b) // 4
    out: list[Way | None] = []
    for s in range(4):
        for t in range(columns):
            ways = [(x[0] + y[0], x[1] + y[1]) for m in range(4) if (x := a[4 * s + m]) and (y := b[columns * m + t])]
            out.append(min(ways, default=None))
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage of (conv_id, turn, role, text) by crc32 of ``conv_id:turn``; a null is one blank wherever it is read as text."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("again")).drop("again")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``place``, the place of each row (conv_id, turn, role, text) in its conversation by (turn, role, text), from 0.

    Rows are cut into ranges of that order, sorted there and written with their place in
    the range; sizes of ranges and starts of conversations make it a place in the
    conversation, so a conversation may fill any number of ranges.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    flat = rows.select("conv_id", "turn", "role", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    flat = cut(flat.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = flat.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))     # a row per range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = flat.withColumn("_part", part).join(before, "_part").withColumn("_all", F.col("_before") + inside)
    starts = placed.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_all").alias("_start"), F.count(F.lit(1)).alias("n_rows"))
    joined = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.select("conv_id", "turn", "role", "text", (F.col("_all") - F.col("_start")).alias("place"), "n_rows")


def faulty(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` to numbered rows: BLANK, DUPLICATE (role and text stand at an earlier place) or CUT_OFF."""
    letter = r"[^\x20\x09-\x0D]"
    same = [F.xxhash64("role", "text").alias("_h1"), F.xxhash64(F.lit("second"), "text", "role").alias("_h2")]
    hashed = rows.select("*", *same)
    first = hashed.groupBy(F.col("conv_id").alias("_c"), F.col("_h1").alias("_f1"), F.col("_h2").alias("_f2")).agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_often"))
    first = first.where("_often > 1").drop("_often")
    hashed = hashed.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_h1") == F.col("_f1")) & (F.col("_h2") == F.col("_f2")), "left")
    fault = F.when(~F.col("text").rlike(letter), BLANK).when(F.col("_first") < F.col("place"), DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT_OFF).otherwise(FINE)
    return hashed.select(*rows.columns, fault.alias("fault"))


_WAYS = "array<struct<cost:long,audit:string>>"


def _solve(batches):
    for batch in batches:
        columns = batch.to_pydict()
        ways = []
        for initials, faults, chunk, last in zip(columns["initials"], columns["faults"], columns["chunk"], columns["last"]):
            found = matrix("".join(x if x in ("s", "u", "a") else "-" for x in initials), faults, chunk == 0, last)
            ways.append([None if w is None else {"cost": w[0], "audit": w[1]} for w in found])
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(ways, kind)], ["conv_id", "chunk", "ways"])


def _multiply(batches):
    for batch in batches:
        out = []
        for parts in batch.column("parts").to_pylist():
            parts = [[None if w is None else (w["cost"], w["audit"]) for w in p["ways"]] for p in sorted(parts, key=lambda p: p["chunk"])]
            whole = parts[0]
            for p in parts[1:]:
                whole = times(whole, p)
            out.append([None if w is None else {"cost": w[0], "audit": w[1]} for w in whole])
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(out, kind)], ["conv_id", "chunk", "ways"])


def _slices(size: int):
    """(conv_id, chunk, edits, next): the part of the audit that belongs to each chunk, and the initial that its first telling edit may tell."""
    def run(batches):
        for batch in batches:
            convs, chunks, edits, state = [], [], [], []
            for conv, audit in zip(batch.column("conv_id").to_pylist(), batch.column("audit").to_pylist()):
                now = "s" if sum(c != "D" for c in audit) % 2 else "u"      # an odd number of rows begins with s
                begin = rows = 0
                first = now
                for k, c in enumerate(audit):
                    if c != "D":
                        now = "a" if now == "u" else "u"
                    if c != "I":
                        rows += 1
                        if rows % size == 0:
                            convs.append(conv), chunks.append(rows // size - 1), edits.append(audit[begin:k + 1]), state.append(first)
                            begin, first = k + 1, now
                if begin < len(audit):
                    last = rows // size - (rows % size == 0)       # inserts after the last row belong to its chunk
                    if rows % size == 0 and chunks and chunks[-1] == last and convs[-1] == conv:
                        edits[-1] += audit[begin:]
                    else:
                        convs.append(conv), chunks.append(last), edits.append(audit[begin:]), state.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field("conv_id").type), pa.array(chunks, pa.int64()), pa.array(edits, pa.string()), pa.array(state, pa.string())], ["conv_id", "chunk", "edits", "next"])
    return run


def _rewrite(batches):
    """Rows (conv_id, chunk, part, edit, role, text) as the edits leave them, ``part`` counting the edits of a chunk."""
    for batch in batches:
        out: dict[str, list] = {name: [] for name in ("conv_id", "chunk", "part", "edit", "role", "text")}
        for conv, chunk, rows, edits, now in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "rows", "edits", "next"))):
            rows = iter(sorted(rows, key=lambda r: r["place"]))
            for k, edit in enumerate(edits):
                row = None if edit == "I" else next(rows)
                if edit != "D":
                    role = row["role"] if edit == "K" else NAMES[now]
                    for name, value in zip(out, (conv, chunk, k, edit, role, "" if row is None else row["text"])):
                        out[name].append(value)
                    now = "a" if now == "u" else "u"
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def repaired(rows: DataFrame, size: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(report, kept) of conversations (conv_id, turn, role, text, ...).

    report has a row per conversation: gaps (turns missing between the least and the
    greatest), the faults blank, duplicate and truncated, illegal (neighbouring initials
    other than su, ua, au), cost and audit. kept has the rows after repair (conv_id,
    chunk, part, edit, role, text), in order of (chunk, part); a conversation of which
    nothing stays has none. Null turns come first and leave no gap; a null id is an id;
    a null role or text is one blank. Rows of one turn are taken by role, then text, so
    repeated and tied rows have one order. Other columns are left out, whatever their
    names. An empty table gives empty tables.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    spoken = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = cut(faulty(numbered(rows.select("conv_id", "turn", *spoken))).withColumn("initial", F.substring("role", 1, 1)).withColumn("chunk", F.floor(F.col("place") / size)))
    told = F.array_sort(F.collect_list(F.struct("place", F.when(F.col("initial") == "", "-").otherwise(F.col("initial")).alias("initial"), F.col("fault").cast("string").alias("fault"))))
    chunks = rows.groupBy("conv_id", "chunk").agg(told.alias("rows"), F.max("n_rows").alias("n_rows"))
    chunks = chunks.select("conv_id", "chunk", F.array_join("rows.initial", "").alias("initials"), F.array_join("rows.fault", "").alias("faults"),
                           (F.col("chunk") == F.floor((F.col("n_rows") - 1) / size)).alias("last"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("initials")), lambda i: F.substring(F.col("initials"), i, F.lit(2)))
    wrong = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))
    chunks = cut(chunks.withColumn("wrong", wrong).withColumn("ends", F.concat(F.substring("initials", 1, 1), F.substring("initials", -1, 1))))
    ways = cut(chunks.mapInArrow(_solve, f"conv_id {kind}, chunk long, ways {_WAYS}"))
    longest = chunks.agg(F.max("chunk")).first()[0] or 0
    while longest:
        by = F.floor(F.col("chunk") / fan)
        ways = cut(ways.groupBy("conv_id", by.alias("chunk")).agg(F.collect_list(F.struct("chunk", "ways")).alias("parts")).mapInArrow(_multiply, f"conv_id {kind}, chunk long, ways {_WAYS}"))
        longest //= fan
    # the pairs between chunks: the last initial of one and the first of the next
    edges = chunks.select("conv_id", F.explode(F.array(F.struct(F.col("chunk").alias("at"), F.lit(1).alias("side"), F.substring("ends", 1, 1).alias("x")),
                                                       F.struct((F.col("chunk") + 1).alias("at"), F.lit(0).alias("side"), F.substring("ends", 2, 1).alias("x")))).alias("e")).select("conv_id", "e.*")
    between = edges.groupBy("conv_id", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "x"))), lambda e: e["x"]), "").alias("pair")).where("length(pair) = 2 and pair not in ('su', 'ua', 'au')")
    wrong = chunks.select("conv_id", F.col("wrong").cast("long").alias("w")).unionByName(between.select("conv_id", F.lit(1).cast("long").alias("w"))).groupBy("conv_id").agg(F.sum("w").alias("illegal"))
    faults = [F.sum(F.when(F.col("fault") == code, 1).otherwise(0)).cast("long").alias(name) for name, code in FAULTS.items()]
    turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    facts = rows.groupBy("conv_id").agg(turns, *faults)
    path = ways.select("conv_id", F.element_at("ways", START + 1).alias("w")).select("conv_id", F.col("w.cost").alias("cost"), F.col("w.audit").alias("audit"))
    named = lambda df, name: df.withColumnRenamed("conv_id", name)
    report = facts.join(named(wrong, "_a"), F.col("conv_id").eqNullSafe(F.col("_a"))).join(named(path, "_b"), F.col("conv_id").eqNullSafe(F.col("_b"))).drop("_a", "_b")
    report = cut(report.select("conv_id", "gaps", *FAULTS, "illegal", "cost", "audit"))
    slices = report.select("conv_id", "audit").mapInArrow(_slices(size), f"conv_id {kind}, chunk long, edits string, next string")
    slices = slices.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), "edits", "next")
    texts = rows.groupBy("conv_id", "chunk").agg(F.collect_list(F.struct("place", "role", "text")).alias("rows"))
    kept = texts.join(slices, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))).select("conv_id", "chunk", "rows", "edits", "next")
    return report, kept.mapInArrow(_rewrite, f"conv_id {kind}, chunk long, part long, edit string, role string, text string")


def digests(kept: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows kept: ``role:text`` joined by line feeds, hashed row by row as they stream by in order."""
    import hashlib
    kind = kept.schema["conv_id"].dataType.simpleString()

    def run(batches):
        none = object()
        now, state = none, None
        for batch in batches:
            convs, out = [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is not None and conv == now:
                    state.update(b"\n")
                else:
                    if state is not None:
                        convs.append(now), out.append(state.hexdigest())
                    now, state = conv, hashlib.sha256()
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field("conv_id").type), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
            kind_of_id = batch.schema.field("conv_id").type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind_of_id), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "part").select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
