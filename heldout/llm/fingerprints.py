"""Document fingerprints by consistent weighted sampling.

Terms are lower-cased words, weighted by their number in the text. For sample k each
term x has r, c ~ gamma(2, 1) and b ~ uniform(0, 1), made from hashes of (x, k). A term
of weight w has t = floor(ln w / r + b) and a = c exp(-r (t - b) - r); the term with the
least a is the sample, named by (x, t). Two texts have equal samples as often as the
generalised Jaccard similarity of their weights. As a depends on (x, t, k) alone, the
least a itself names the sample, and a component of the fingerprint is 16 bits of it.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .shared import cut, parallelism
from .shingles import U, mixed, word_hashes

SAMPLES = 64
CACHED = 1 << 16                 # terms whose draws a task keeps: the first that come, one a slot
BLOCK_TERMS = 1 << 14
BLOCK_CHARS = 1 << 20
EMPTY = "0" * (4 * SAMPLES)      # of texts without words


def draws(terms: np.ndarray) -> np.ndarray:
    """r, b, ln c, and ln a of weight 1, as [term, which, sample], from hashes of (term, sample)."""
    cell = mixed(terms)[:, None] + np.arange(1, SAMPLES + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    low, scale = U(0xFFFFFFFF), 2.0**-32

    def uniforms(stream: int) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(cell ^ U(stream * 0xD6E8FEB86659FD93 % 2**64))
        return ((h >> U(32)).astype(np.float64) + 0.5) * scale, ((h & low).astype(np.float64) + 0.5) * scale

    (u, v), (x, y) = uniforms(1), uniforms(2)
    b = uniforms(3)[0]
    r, log_c = -np.log(u * v), np.log(-np.log(x * y))
    out = np.empty((len(terms), 4, SAMPLES), np.float32)
    for k, made in enumerate((r, b, log_c, log_c + r * b - r)):
        out[:, k] = made
    return out


@lru_cache(maxsize=1)
def cache() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a slot is taken, its term, and its draws."""
    return np.zeros(CACHED, bool), np.zeros(CACHED, np.uint64), np.zeros((CACHED, 4, SAMPLES), np.float32)


def drawn(terms: np.ndarray) -> np.ndarray:
    """The draws of distinct terms, of kept ones from the cache; what is kept changes no draw."""
    taken, names, kept = cache()
    slot = (mixed(terms) >> U(40)).astype(np.int64) % CACHED
    known = taken[slot] & (names[slot] == terms)
    out = np.empty((len(terms), 4, SAMPLES), np.float32)
    out[known] = kept[slot[known]]
    new = np.flatnonzero(~known)
    if len(new):
        out[new] = draws(terms[new])
        free, where = np.unique(slot[new], return_index=True)
        where, free = new[where[~taken[free]]], free[~taken[free]]
        taken[free], names[free], kept[free] = True, terms[where], out[where]
    return out


def least(terms: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least ln a of each text and sample; texts are runs of terms, none empty. Terms are taken in blocks of BLOCK_TERMS."""
    out = np.full((len(starts), SAMPLES), np.inf, np.float32)
    for i in range(0, len(terms), BLOCK_TERMS):
        part, n = terms[i:i + BLOCK_TERMS], counts[i:i + BLOCK_TERMS]
        some, row = np.unique(part, return_inverse=True)
        d = drawn(some)
        a = d[row, 3]
        more = np.flatnonzero(n > 1)
        if len(more):
            r, b, log_c = (d[row[more], k] for k in range(3))
            t = np.floor(np.log(n[more]).astype(np.float32)[:, None] / r + b)
            a[more] = np.where(t == 0, a[more], log_c - r * (t - b) - r)
        first = np.searchsorted(starts, i, "right") - 1
        last = np.searchsorted(starts, i + len(part), "left")
        edges = np.maximum(starts[first:last] - i, 0)
        out[first:last] = np.minimum(out[first:last], np.minimum.reduceat(a, edges, axis=0))
    return out


def signatures(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    found = []
    for words in word_hashes([t.encode() for t in texts]):
        found.append(np.unique(words, return_counts=True) if len(words) else None)
    out, i = [EMPTY] * len(texts), 0
    some = [k for k, x in enumerate(found) if x is not None]
    while i < len(some):
        j, n, starts = i, 0, []
        while j < len(some) and (j == i or n + len(found[some[j]][0]) <= BLOCK_TERMS):
            starts.append(n)
            n += len(found[some[j]][0])
            j += 1
        part = [found[k] for k in some[i:j]]
        a = least(np.concatenate([x[0] for x in part]), np.concatenate([x[1] for x in part]), np.array(starts))
        bits = (mixed(a.view(np.uint32).astype(np.uint64) + U(7)) >> U(48)).astype(">u2")
        for k, row in zip(some[i:j], bits):
            out[k] = row.tobytes().hex()
        i = j
    return out


def likeness(left: str, right: str) -> float:
    """Share of equal samples: an estimate of the generalised Jaccard similarity; texts without words are alike only among themselves."""
    if (left == EMPTY) != (right == EMPTY):
        return 0.0
    a, b = (np.frombuffer(bytes.fromhex(x), np.uint16) for x in (left, right))
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(texts: list[str], following: list[str], prints: list[str], next_prints: list[str]) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    other = signatures(changed)
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()), pa.array(prints, pa.string()), pa.array(other, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(prints, other)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(prints, next_prints)], pa.float64())]


def blocks(texts: list[str]):
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= BLOCK_CHARS):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def fingerprint(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The columns of FIELDS for each row of ``docs`` (doc_id, text), with its edited text and the next document in order.

    Null texts count as empty. Order is by doc_id, then text; null ids come first, and
    the first document follows the last. A lone document follows itself. An empty table
    gives no rows. The rows are dealt to tasks by ranges of ids; only the first and the
    last row of a task meet those of other tasks, in a table of two rows per task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {TYPES}, part int, head string, tail string"

    def run(batches):
        part, held, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in blocks(all_texts):
                ids, texts = all_ids[i:j], all_texts[i:j]
                prints = signatures(texts)
                head = [None] * len(ids)
                if first:
                    head[0], first = texts[0], False
                if held:
                    ids, texts, prints, head = [held[0], *ids], [held[1], *texts], [held[2], *prints], [held[3], *head]
                held = (ids[-1], texts[-1], prints[-1], head[-1])
                n = len(ids) - 1
                if n:
                    made = _rows(texts[:-1], texts[1:], prints[:-1], prints[1:])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], batch.column(0).type), *made, pa.array([part] * n, pa.int32()), pa.array(head[:-1], pa.string()), pa.array([None] * n, pa.string())], [*FIELDS, "part", "head", "tail"])
                kind_of = batch.column(0).type
        if held:
            none = [pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.string()) for _ in range(3)), *(pa.nulls(1, pa.float64()) for _ in range(2))]
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], kind_of), *none, pa.array([part], pa.int32()), pa.array([held[3]], pa.string()), pa.array([held[1]], pa.string())], [*FIELDS, "part", "head", "tail"])

    def close(batches):
        for batch in batches:
            texts, following = ([t or "" for t in batch.column(c).to_pylist()] for c in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_rows(texts, following, signatures(texts), signatures(following))], FIELDS)

    ordered = docs.select("doc_id", "text").repartitionByRange(parts or parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    made = cut(ordered.mapInArrow(run, schema))
    heads = made.where("head is not null").select("part", "head")
    by_part = Window.orderBy("part")
    around = heads.select("part", F.coalesce(F.lead("head").over(by_part), F.first("head").over(by_part)).alias("following"))
    ends = made.where("tail is not null").select("doc_id", "tail", "part").join(around, "part").select("doc_id", "tail", "following")
    return made.where("tail is null").select(*FIELDS).unionByName(ends.mapInArrow(close, f"doc_id {kind}, {TYPES}"))
