"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

A text becomes symbols, one per character, blanks as the space mark. Adjacent pairs
that are pieces together stand on an agenda (short units: a list), best score first, then leftmost; the best
is merged and the pairs with its new neighbours join the agenda; entries whose symbols
have changed meanwhile are passed over. No piece holds a space mark after another character, so no merge crosses
into the next run of marks: texts are cut into units there, and a task keeps the units
it has seen last, so frequent ones are encoded once.

In every Arrow batch the sentencepiece library encodes the new units too, and it decodes
every piece when a model is loaded; any difference fails the task.
"""
from __future__ import annotations

import gc
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, repeat
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import slices

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
KEPT_CHARS = 1 << 22                # characters of the units that a task keeps
BLOCK_CHARS = 1 << 20
SHORT_UNIT = 48                     # characters of a unit whose pairs are searched in place
NEVER = float("inf")


class Pieces:
    """A merge-type model with byte pieces, read through the library; ``library`` checks every batch."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.vocab_size())
        self.names = [lib.id_to_piece(i) for i in ids]
        special = {i for i in ids if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        #: Pieces that merges may make: name -> place on the agenda (lower first), and name -> id.
        self.cost = {self.names[i]: -lib.get_score(i) for i in ids if i not in special}
        self.id = {self.names[i]: i for i in ids if i not in special}
        self.unused = {self.names[i] for i in ids if lib.is_unused(i)}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(lib.is_byte(i) for i in self.bytes):
            raise ValueError(f"{path}: a vocabulary with byte pieces is needed")
        self.end = lib.eos_id()
        self.units = not any(SPACE in name.lstrip(SPACE) for name in self.cost)
        value = {i: b"" for i in special} | {i: bytes([b]) for b, i in enumerate(self.bytes)} | {lib.unk_id(): " \u2047 ".encode()}
        self.value = [value.get(i, name.replace(SPACE, " ").encode()) for i, name in zip(ids, self.names)]
        self.decimal = [str(i) for i in ids]
        told = [v.decode("utf-8", "replace") for v in self.value]       # after another piece, so that no mark in front goes
        if [self.library.decode([self.id["a"], i]) for i in ids] != ["a" + t for t in told]:
            raise ValueError(f"{path}: the library decodes a piece otherwise")

    def marked(self, text: str) -> str:
        """The text as the model sees it: blanks as space marks, one in front of all."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merge(self, unit: str) -> tuple[int, ...]:
        """Ids of one unit."""
        part = list(unit)
        made: dict[str, tuple[str, str]] = {}
        (self._merge_short if len(part) <= SHORT_UNIT else self._merge_long)(part, made)
        try:
            if not made:
                return tuple([*map(self.id.__getitem__, filter(None, part))])
        except KeyError:                                        # a character that is no piece
            pass
        out: list[int] = []
        for name in filter(None, part):
            self._told(name, made, out)
        return tuple(out)

    def _merge_short(self, part: list[str], made: dict):
        """The agenda of a short unit is the list of its pairs' costs, kept in place: the least is taken, leftmost first."""
        cost, unused = self.cost.get, self.unused
        costs = [*map(cost, map(add, part, part[1:]), repeat(NEVER))]
        while costs and (least := min(costs)) < NEVER:
            i = costs.index(least)
            left, right = part[i], part.pop(i + 1)
            both = part[i] = left + right
            if unused and both in unused:
                made[both] = (left, right)
            del costs[i]
            if i:
                costs[i - 1] = cost(part[i - 1] + both, NEVER)
            if i < len(costs):
                costs[i] = cost(both + part[i + 1], NEVER)

    def _merge_long(self, part: list[str], made: dict):
        cost, n = self.cost.get, len(part)
        agenda = [(c, i, i + 1, pair) for i, pair in enumerate(map(add, part, part[1:])) if (c := cost(pair)) is not None]
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, j, both = heappop(agenda)
            left, right = part[i], part[j]
            if not right or after[i] != j or left + right != both:
                continue                                        # one of the two was merged meanwhile
            if self.unused and both in self.unused:
                made[both] = (left, right)
            part[i], part[j] = both, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = both + part[k]
                if (c := cost(pair)) is not None:
                    heappush(agenda, (c, i, k, pair))
            h = before[i]
            if h >= 0:
                pair = part[h] + both
                if (c := cost(pair)) is not None:
                    heappush(agenda, (c, h, i, pair))

    def _told(self, name: str, made: dict, out: list[int]):
        if name in made:                                        # an unused piece is told by the two that made it
            for x in made[name]:
                self._told(x, made, out)
        elif name in self.id:
            out.append(self.id[name])
        else:
            out.extend(self.bytes[b] for b in name.encode())

    def encode(self, texts: list[str], seen: dict) -> list[list[int]]:
        """Ids of each text, then the end id; ``seen`` keeps ids of units between calls."""
        cut = _UNIT.findall if self.units else lambda whole: [whole] if whole else []
        units = [cut(self.marked(t)) for t in texts]
        new = list(set().union(*units).difference(seen))
        found = [self.merge(u) for u in new]
        self.check(new, found)
        seen.update(zip(new, found))
        return [[*chain.from_iterable(map(seen.__getitem__, u)), self.end] for u in units]

    def check(self, units: list[str], found: list[tuple[int, ...]]):
        """Raises if the library gives other ids for a unit; the library puts the mark in front, but not before an empty text."""
        if not units:
            return
        texts = [u[1:].replace(SPACE, " ") for u in units]
        mark = self.library.encode("a ")[-1:]
        others = [ids or mark for ids in self.library.encode(texts, num_threads=1)]
        if [*map(list, found)] != others:
            u = next(u for u, ids, other in zip(units, found, others) if list(ids) != other)
            raise ValueError(f"other ids than the library's for {u[:200]!r}")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD, special pieces nothing, the mark in front goes."""
        at = next((k for k, i in enumerate(ids) if not (self.library.is_control(i))), len(ids))
        text = b"".join(map(self.value.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if at < len(ids) and self.names[ids[at]].startswith(SPACE) else text


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


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


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of rows (doc_id, text, ...): decimal ids with the end id, joined by blanks, and the text decoded from them.

    Null texts count as empty: the end id alone. Null and repeated doc_ids pass through,
    other columns are left out. An empty table gives no rows. ``path`` names a model
    on every executor: merge-type, with byte pieces, a mark put in front, and no
    rewriting of characters; the library's ids fail the task where that is not so.
    """
    def run(batches):
        model, seen = pieces(path), {}
        gc.disable()                                            # nothing here makes cycles, and the kept units would be walked again and again
        try:
            yield from told(model, seen, batches)
        finally:
            gc.enable()

    def told(model, seen, batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in blocks(texts):
                ids = model.encode(texts[i:j], seen)
                if sum(map(len, seen)) > KEPT_CHARS:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(map(len, ids), pa.int64()),
                    pa.array((" ".join(map(model.decimal.__getitem__, x)) for x in ids), pa.string()), pa.array(map(model.decode, ids), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids string, decoded string")
