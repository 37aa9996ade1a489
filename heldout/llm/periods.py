"""Periodic runs of words: an online sparse diagonal DP, text by text.

A word that stands d words after an equal one lies on diagonal d. While consecutive
words stay on a diagonal its match grows by one a word; when a word leaves it, the
match has ended, and if it is long enough a run is told at once. A run of period d is
a match of d words or more (and of LEAST - d), so the DP is sparse: diagonal d takes
part only where a whole gram of words recurs d words later, of GRAM words for d up to
2 * GRAM and of l words for d from l + 1 to 2 * l, l = 2 * GRAM, 4 * GRAM and so on.
A word's earlier occurrences are those of the grams that end with it.

A match on diagonal d means that its last m + d words have period d. No smallest
period e <= m of a run can then end there (two periods that overlap in d + e words
have a common divisor as period), so the diagonals up to m are passed over, and a text
of one word repeated stays linear. Each run is on its diagonal at its last word, and
a diagonal that comes back is followed to its first word.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import STEPS, U, mixed

LEAST, GRAM = 12, 6
BLOCK_BYTES = 1 << 24

Run = tuple[int, int, int]


def occurrences(words: list[bytes]) -> list[tuple[np.ndarray, list[int], np.ndarray, np.ndarray, int]]:
    """(ends, places, first, last, most) per length of gram.

    ``ends`` are the places at which a gram ends that ended before, near enough; its
    earlier ends are places[first:last], ascending; ``most`` is the greatest lag.
    """
    n, out = len(words), []
    gram, size = np.fromiter(map(hash, words), np.int64, n).view(np.uint64), 1
    total = np.full(n - GRAM + 1, GRAM, np.uint64)
    for k in range(GRAM):
        total = total + gram[k:n - GRAM + 1 + k] * U(STEPS[k])
    gram, size, least = mixed(total), GRAM, 1
    while True:
        order = np.argsort(gram, kind="stable")
        new = np.diff(gram[order], prepend=~gram[order[:1]]) != 0
        if new.all():
            return out
        group = np.cumsum(new) - 1
        key = group * (2 * n) + order                           # ascending
        most = min(2 * size, n // 2)
        last = np.searchsorted(key, key - least, "right")
        first = np.maximum(np.searchsorted(key, key - most, "left"), np.flatnonzero(new)[group])
        some = np.flatnonzero(last > first)
        some = some[np.argsort(order[some])]
        shift = size - 1                                        # from the first word of a gram to its last
        out.append((order[some] + shift, (order + shift).tolist(), first[some], last[some], most))
        if 2 * size >= n // 2:
            return out
        gram = mixed(gram[:-size] * U(STEPS[6]) + gram[size:] * U(STEPS[7] | 1))
        size, least = 2 * size, 2 * size + 1


def _primitive(words: list[bytes], start: int, end: int, period: int) -> bool:
    """Whether words[start:end], of this period, has no smaller one."""
    rest, p = period, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            q = period // p
            if words[start + q:end] == words[start:end - q]:
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def runs_of(words: list[bytes]) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    if len(words) < LEAST:
        return []
    scales = occurrences(words)
    if not scales:
        return []
    found: list[Run] = []
    events: dict[int, list] = {}
    for ends, places, first, last, most in scales:
        for i, a, b in zip(ends.tolist(), first.tolist(), last.tolist()):
            events.setdefault(i, []).append((places, a, b, most))

    def ended(lag: int, matched: int, at: int):
        start = at - matched - lag + 1
        if matched >= lag and matched + lag >= LEAST and _primitive(words, start, at + 1, lag):
            found.append((start, matched + lag, lag))

    active: dict[int, int] = {}                                 # diagonal -> words matched up to the last word
    now = -1
    for i in sorted(events):
        if i != now + 1:
            for lag, matched in active.items():
                ended(lag, matched, now)
            active = {}
        going: dict[int, int] = {}
        reach = 0
        for places, a, b, most in events[i]:                    # by lag, ascending
            if most <= reach:
                continue
            if reach:
                b = bisect_left(places, i - reach, a, b)
            for at in range(b - 1, a - 1, -1):
                lag = i - places[at]
                if lag <= reach:
                    continue
                matched = active.get(lag, -1) + 1
                if not matched:
                    k = i
                    while k >= lag and words[k] == words[k - lag]:
                        k -= 1
                    matched = i - k
                going[lag] = matched
                reach = max(reach, matched)
        for lag, matched in active.items():
            if lag not in going:
                ended(lag, matched, now)
        active, now = going, i
    for lag, matched in active.items():
        ended(lag, matched, now)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    stays = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        stays[start + period:start + length] = bytes(length - period)
    return [w for w, s in zip(words, stays) if s]


def damaged(doc_id, words: list[bytes]) -> list[bytes]:
    """The contract's damage: of every tenth id, by its crc32, the words from one place on repeat a stretch. A null id counts as an empty text."""
    h, n = crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def detect(docs: DataFrame, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs`` (doc_id, text, ...), whole texts.

    ``runs`` is an array of (start, length, period), by start, then period; collapsed
    is the text of the words that no run holds after its first period, parted by single
    blanks. Words are parted by ASCII white space and compared as bytes (found by
    64-bit hashes). ``prepare`` may exchange the words of a document, given its id.
    Null, empty and blank texts have no words, no runs and collapse to the empty text.
    Null and repeated ids pass through; other columns are left out. No rows, no rows.
    Each text is on its own: nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def told(ids: list, texts: list[bytes]) -> list[pa.Array]:
        n, runs, rest = [], [], []
        for doc_id, text in zip(ids, texts):
            words = text.split()
            if prepare and words:
                words = prepare(doc_id, words)
            found = runs_of(words)
            n.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            rest.append(b" ".join(collapsed(words, found)))
        return [pa.array(n, pa.int64()), pa.array(runs, run_type), pa.array(rest, pa.binary()).cast(pa.string())]

    def run(batches):
        for batch in batches:
            size = batch.column(1).nbytes
            step = max(1, batch.num_rows * BLOCK_BYTES // max(size, 1))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *told(part.column(0).to_pylist(), texts)], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
