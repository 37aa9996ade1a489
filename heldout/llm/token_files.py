"""Token ids in files: one array of ids, with document boundaries and ids in Elias-Fano code.

A file holds the ids of a run of documents, ascending by doc_id, in 2 or 4 bytes each,
then the ends of the documents and the doc_ids as Elias-Fano sequences, then a footer.
The i-th value of a sequence is found from the sampled place of every 64th one bit and
a few words after it; no table of 64-bit offsets is kept.

Tasks write under names of their own and report them; a file counts only once its name
is in the manifest, so a task that runs twice or dies leaves nothing that is read.
"""
from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import cut, parallelism, shared_folder

MAGIC = b"EFTOKEN1"
SAMPLE = 64
KEPT_WORDS = 600_000
BLOCK_CHARS = 1 << 20
READ_IDS, READ_DOCS = 1 << 20, 1 << 14
SCAN_BYTES = 1 << 14

#: Letters and numbers of the first Unicode blocks, for texts that have no other characters; the word rule is the tokenizer file's.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_OTHER = re.compile("[^\t\n\r -~\xa0-įı-ſ]")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


class EliasFano:
    """A non-decreasing sequence of integers from 0."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, places: bytes):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        x = np.asarray(values, np.uint64)
        n = len(x)
        low_bits = max(0, int(int(x[-1]) // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((x[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").tobytes()
        return cls(n, low_bits, low, high, ones[::SAMPLE].astype("<u4").tobytes())

    def place(self, i: int) -> int:
        """Place of the i-th one bit, from the sample before it."""
        place = int(np.frombuffer(self.places, "<u4")[i // SAMPLE])
        left, byte = i % SAMPLE, place // 8
        word = self.high[byte] & (0xFF << (place % 8))
        while True:
            ones = word.bit_count()
            if ones > left:
                break
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        """The i-th value."""
        high = self.place(i) - i
        first = i * self.low_bits
        piece = int.from_bytes(self.low[first // 8:(first + self.low_bits + 7) // 8 + 1], "little") >> (first % 8)
        return high << self.low_bits | piece & ((1 << self.low_bits) - 1)

    def values(self, first: int, last: int) -> np.ndarray:
        """The values first..last - 1: a select for the first, then a scan from there; memory is that of these values."""
        n = last - first
        if n <= 0:
            return np.zeros(0, np.int64)
        byte, found, ones = self.place(first) // 8, 0, []
        skip = self.place(first) % 8
        while found < n:
            bits = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8, min(SCAN_BYTES, len(self.high) - byte), byte), bitorder="little"))
            bits = bits[bits >= skip] + byte * 8
            ones.append(bits[:n - found])
            found, byte, skip = found + len(ones[-1]), byte + SCAN_BYTES, 0
        high = (np.concatenate(ones) - np.arange(first, last)) << self.low_bits
        start, stop = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8, (stop + 7) // 8 - start // 8, start // 8), bitorder="little")
        bits = bits[start % 8:start % 8 + n * self.low_bits].reshape(n, self.low_bits)
        low = np.zeros(n, np.int64)
        for k in range(self.low_bits):
            low |= bits[:, k].astype(np.int64) << k
        return high | low

    def all(self) -> np.ndarray:
        return self.values(0, self.n)

    def pack(self) -> bytes:
        return struct.pack("<QIQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.places)) + self.low + self.high + self.places

    @classmethod
    def unpack(cls, data: bytes) -> "EliasFano":
        n, low_bits, *sizes = struct.unpack_from("<QIQQQ", data)
        at, parts = struct.calcsize("<QIQQQ"), []
        for size in sizes:
            parts.append(data[at:at + size])
            at += size
        return cls(n, low_bits, *parts)


class Encoder:
    """Ids of whole texts by a tokenizers file; every distinct word of plain texts goes to the library once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True         # their names in a text are ordinary text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.seen: dict[str, bytes] = {}
        self.by_word = self._splits_words(path)

    @staticmethod
    def _splits_words(path: str) -> bool:
        """Whether the file has the normaliser and the word rule that _WORD restates; otherwise texts go to the library whole."""
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        rule = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        return kinds == ["NFC", "Replace", "Lowercase"] and (steps[0].get("pattern") or {}).get("Regex") == rule and steps[0].get("invert") is True

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(e.ids, kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_word and not _OTHER.search(t) for t in texts]
        lists = [_WORD.findall(t.lower()) if p else None for t, p in zip(texts, plain)]
        new = set().union(*(x for x in lists if x is not None)).difference(self.seen)
        if len(self.seen) + len(new) > KEPT_WORDS:
            self.seen.clear()
            new = set().union(*(x for x in lists if x is not None))
        new = list(new)
        self.seen.update(zip(new, self._ids(new)))
        whole = iter(self._ids([t for t, p in zip(texts, plain) if not p]))
        return [next(whole) if words is None else b"".join(map(self.seen.__getitem__, words)) for words in lists]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _blocks(texts: list[str]):
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= BLOCK_CHARS):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def write(docs: DataFrame, path: str, end: int = 1, parts: int | None = None) -> DataFrame:
    """Writes files of the ids of ``docs`` (doc_id, text) and returns the manifest (part, file, n_docs, n_ids).

    Files ascend by doc_id from part to part and within one; equal ids stand together,
    null ids first. Null texts count as empty: the end id alone. An empty table makes
    no file. ``path`` names a tokenizers file on every executor.
    """
    root = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    place, folder = fs.FileSystem.from_uri(root)
    place.create_dir(folder, recursive=True)

    def run(batches):
        part, out, lengths, ids = TaskContext.get().partitionId(), None, [], []
        disk, folder = fs.FileSystem.from_uri(root)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ef"
        enc = encoder(path)
        stop = np.array([end], f"<u{enc.width}").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids += batch.column(0).to_pylist()
            for i, j in _blocks(texts):
                out = out or disk.open_output_stream(f"{folder}/{name}")
                for one in enc.encode(texts[i:j]):
                    out.write(one + stop)
                    lengths.append(len(one) // enc.width + 1)
        if out:
            known = np.array([i for i in ids if i is not None], np.int64)
            base = int(known[0]) if len(known) else 0
            sections = [EliasFano.of(np.cumsum(lengths)).pack(), EliasFano.of(known.astype(np.uint64) - np.uint64(base % (1 << 64))).pack()]
            out.write(b"".join(sections))
            foot = json.dumps({"width": enc.width, "docs": len(ids), "nulls": len(ids) - len(known), "base": base, "ids": int(sum(lengths)), "sections": [len(s) for s in sections]}).encode()
            out.write(foot + struct.pack("<I", len(foot)) + MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{root}/{name}"]), pa.array([len(ids)], pa.int64()), pa.array([int(sum(lengths))], pa.int64())], ["part", "file", "n_docs", "n_ids"])

    ordered = docs.select("doc_id", "text").repartitionByRange(parts or parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, "part int, file string, n_docs long, n_ids long"))


class TokenFile:
    """A file written by ``write``: boundaries in memory, ids read as asked for."""

    def __init__(self, uri: str):
        disk, path = fs.FileSystem.from_uri(uri)
        self.file = disk.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        foot = struct.unpack("<I", tail[:4])[0]
        self.meta = json.loads(self.file.read_at(foot, size - 12 - foot))
        at, self.sequences = size - 12 - foot - sum(self.meta["sections"]), []
        for n in self.meta["sections"]:
            self.sequences.append(EliasFano.unpack(self.file.read_at(n, at)))
            at += n
        self.ends, self.keys = self.sequences

    def __len__(self) -> int:
        return self.meta["docs"]

    def span(self, first: int, last: int) -> np.ndarray:
        """Ids from place ``first`` to before ``last``."""
        w = self.meta["width"]
        return np.frombuffer(self.file.read_at((last - first) * w, first * w), f"<u{w}")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by two selects."""
        return self.span(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def doc_ids(self, first: int = 0, last: int | None = None) -> list[int | None]:
        """Ids of the documents first..last - 1; those without an id come first."""
        last, nulls = len(self) if last is None else last, self.meta["nulls"]
        return [None] * (min(last, nulls) - min(first, nulls)) + (self.keys.values(max(first - nulls, 0), max(last - nulls, 0)) + self.meta["base"]).tolist()


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files of a manifest.

    ``start`` counts the ids of all documents before it; the driver holds one row per file.
    """
    files, before = sorted((r["part"], r["file"], r["n_ids"]) for r in manifest.toLocalIterator()), 0
    rows = []
    for part, file, n in files:
        rows.append((part, file, before))
        before += n

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                f = TokenFile(file)
                for first in range(0, len(f), READ_DOCS):
                    yield from told(f, first, min(first + READ_DOCS, len(f)), start)

    def told(f: TokenFile, first: int, last: int, start: int):
        """The documents first..last - 1 of a file: their boundaries are read by a select and a scan, their ids READ_IDS at a time."""
        ends, ids = f.ends.values(first, last), f.doc_ids(first, last)
        begins = np.concatenate([np.array([f.ends.select(first - 1) if first else 0], np.int64), ends[:-1]])
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(ends, begins[i] + READ_IDS, "right")))
            block = f.span(int(begins[i]), int(ends[j - 1])).astype("<u4")
            crc = [zlib.crc32(block[a:b].tobytes()) for a, b in zip(begins[i:j] - begins[i], ends[i:j] - begins[i])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(begins[i:j] + start), pa.array(ends[i:j] - begins[i:j]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
            i = j

    table = spark.createDataFrame(rows, "part int, file string, start long").repartition(max(len(rows), 1), "part")
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
