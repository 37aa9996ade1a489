"""Byte-level BPE encoding and decoding in numpy.

The distinct pieces of a block of texts are laid out as padded matrices, one per
length bucket. In each round every row merges its leftmost pair of the smallest rank;
ranks of pairs come from an open hash table; rows that are done leave the matrix.
A task keeps the pieces that it has seen last, so frequent ones are encoded once.
"""
from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import slices

NONE = np.int32(2**31 - 1)
LONG = 1024                     # longer pieces are rows of their own
KEPT_BYTES = 1 << 24             # of the pieces that a task keeps, objects included
OBJECTS = 130                    # bytes of a kept piece besides its characters and ids
BLOCK_CHARS = 1 << 20

#: Letters, numbers and other characters of the first Unicode blocks, for texts that have no others.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SIMPLE = re.compile("[^\t\n\r -~\xa0-ɏ]")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """A function that splits a text into the matches of the public pattern; other patterns go to the regex module as they are."""
    import public_tokenizers
    import regex
    white = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    if pattern != public_tokenizers.PATTERN:
        return white.findall
    return lambda text: white.findall(text) if _SIMPLE.search(text) else _PIECE.findall(text)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        ranks = self.ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.bits = max(16, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        keys = left << 32 | right
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):                                    # a key that finds its slot taken tries the next one
            free = self.keys[slot[todo]] == -1
            first = todo[free][np.unique(slot[todo[free]], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], rank[first]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.size = order[-1][1] + 1 if order else 0
        self.length = np.zeros(self.size, np.int64)
        self.length[[r for _, r in order]] = [len(t) for t, _ in order]
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(t for t, _ in order), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it is no token; negative ids are padding."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.int64) << 32 | right[todo].astype(np.int64)
        slot = self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers; pieces of similar length."""
        n, width = len(pieces), max(map(len, pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < length[:, None], self.single[raw], np.int32(-1))
        pair = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        out, row = [b""] * n, np.arange(n)
        while len(row):
            at = pair.argmin(1) if pair.shape[1] else np.zeros(len(row), np.int64)
            best = pair[np.arange(len(row)), at] if pair.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                for r, v, m in zip(row[done], ids[done], length[row[done]]):
                    out[r] = v[:m].astype("<u4").tobytes()
                on = ~done
                row, ids, pair, at, best = row[on], ids[on], pair[on], at[on], best[on]
                if not len(row):
                    break
            k = np.arange(len(row))
            ids[k, at] = best
            length[row] -= 1
            width = int(length[row].max())
            move = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
            padded = np.concatenate([ids, np.full((len(row), 1), -1, np.int32)], 1)
            ids = np.take_along_axis(padded, np.minimum(move, padded.shape[1] - 1), 1)
            padded = np.concatenate([pair, np.full((len(row), 2), NONE, np.int32)], 1)
            pair = np.take_along_axis(padded, np.minimum(move[:, :max(width - 1, 0)], padded.shape[1] - 1), 1)
            for spot in (at - 1, at):
                ok = (spot >= 0) & (spot < width - 1)
                pair[k[ok], spot[ok]] = self.rank(ids[k[ok], spot[ok]], ids[k[ok], spot[ok] + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one long row: a round merges all places of the smallest rank from the left.

        The result is that of one merge a round: a round ends early at the first place
        whose merge opens a pair of lower rank with its neighbours.
        """
        ids = self.single[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            pair = self.rank(ids[:-1], ids[1:])
            best = pair.min()
            if best == NONE:
                break
            at = np.flatnonzero(pair == best)
            run = np.diff(at, prepend=-2) != 1
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            beside = np.append(ids, [-1, -1])[at + 2], np.where(np.diff(at, prepend=-9) == 2, best, np.append(-1, ids)[at])
            merged = np.full(len(at), best, np.int32)
            lower = np.flatnonzero(np.minimum(self.rank(merged, beside[0]), self.rank(beside[1], merged)) < best)
            at = at[:lower[0] + 1] if len(lower) else at
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids.astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        data = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(data)
        groups: dict[int, list[int]] = {}
        for i, d in enumerate(data):
            whole = self.ranks.get(d)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(d) > LONG:
                out[i] = self.merge_long(d)
            else:
                groups.setdefault((len(d) + 3) // 4 if len(d) <= 32 else 32 + len(d).bit_length(), []).append(i)
        for members in groups.values():
            step = max(1, (1 << 20) // max(len(data[i]) for i in members))
            for a in range(0, len(members), step):
                part = members[a:a + step]
                for i, ids in zip(part, self.merge_rows([data[i] for i in part])):
                    out[i] = ids
        return out

    def encode(self, texts: list[str], split, seen: dict[str, bytes] | None = None) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; ``seen`` keeps the ids of pieces between calls, KEPT_BYTES at most."""
        seen = {} if seen is None else seen
        lists = [split(t) for t in texts]
        new = list(set().union(*lists).difference(seen))
        seen.update(zip(new, self.encode_pieces(new)))
        out = [b"".join(map(seen.__getitem__, p)) for p in lists]
        if sum(map(len, seen.values())) + sum(map(len, seen)) + OBJECTS * len(seen) > KEPT_BYTES:
            seen.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids; whole arrays at once, 2^16 ids at a time."""
        every, out = np.frombuffer(ids, "<u4"), []
        for a in range(0, len(every), 1 << 16):
            part = every[a:a + (1 << 16)]
            n = self.length[part]
            end = np.cumsum(n)
            out.append(self.pool[np.repeat(self.start[part] - end + n, n) + np.arange(end[-1])].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def blocks(texts: list[str]):
    """(first, last) of runs of texts of about BLOCK_CHARS characters."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= BLOCK_CHARS):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows (doc_id, text): ids as little-endian 32-bit integers, and the bytes decoded from them.

    Null texts count as empty and have no ids. Null and repeated doc_ids pass through.
    An empty table gives no rows. ``path`` names a tiktoken file on every executor.
    """
    def run(batches):
        voc, split, seen = vocabulary(path), splitter(pattern), {}
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in blocks(texts):
                ids = voc.encode(texts[i:j], split, seen)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids, pa.binary()), pa.array(map(voc.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), the digests of ``encoded`` made where the ids are."""
    def run(batches):
        voc, split, seen = vocabulary(path), splitter(pattern), {}
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for i, j in blocks(texts):
                for ids in voc.encode(texts[i:j], split, seen):
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(voc.decode(ids)).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
