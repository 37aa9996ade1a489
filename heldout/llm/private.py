"""Personal data: exact patterns and a semi-Markov conditional random field.

The base patterns give spans that always stay. The field reads the windows of a text
that hold a digit, an @ or a spelled-out (at). A window is a run of tokens; a labelling
cuts it into segments, each an entity (numbers of up to MOST_TOKENS tokens, addresses
of any length) or a single other token. Features look at whole segments (digits, groups, checksum, octets, neighbours),
and neighbouring segments have weights for their types. Training maximises the
likelihood of windows labelled by the base patterns, and of copies of them in which the
entity is written in another way; decoding is dynamic programming over the places of a
window, which chooses boundaries and types together. An entity is added where it
outweighs "no entity" by MARGIN and meets no base span.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: windows with and without base spans, those of least hash.
TRAIN_WINDOWS = 200
TRAIN_CHARS = 400
EPOCHS = 12
MARGIN = 1.5
MOST_TOKENS = 24
MOST_GAP, CONTEXT = 24, 24          # characters between triggers of one window, and around it

#: The base patterns.
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
_DIGIT = re.compile("[0-9]")
EDGE = 2                            # characters past the end of a name, for the features of its neighbours
_RUN = re.compile(r"[\w.%+-]+")        # what names and addresses are made of
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _AT_DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start.

    Emails are found from each @ to the left, the other kinds from digits: the same
    leftmost matches in time linear in the text.
    """
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdecimal, m[0])) <= 15]
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers that lie near each other, to the ends of the names they reach into; those that touch are one."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() - out[-1][1] <= MOST_GAP:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    spans: list[list[int]] = []
    for a, b in out:
        a, b = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
        m = _RUN.match(text, b) if _RUN.match(text, b - 1) else None
        b = min(len(text), max(b, m.end() + EDGE)) if m else b
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
            continue
        if _RUN.match(text, a):
            while a and _RUN.match(text, a - 1, a):
                a -= 1
            a = max(0, a - EDGE)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


class Window:
    """Tokens of a window and its candidate segments (first token, end token, kind, features)."""

    def __init__(self, text: str):
        found = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        self.text, self.begin, self.end = text, [a for a, _ in found], [b for _, b in found]
        tokens = [text[a:b] for a, b in found]
        self.kinds = ["9" if "0" <= t[0] <= "9" else "a" if t[0].isalpha() else "_" if t.isspace() else t for t in tokens]
        self.tokens, self.segments = tokens, []
        self._numbers()
        self._emails()

    def _side(self, i: int) -> str:
        k = self.kinds[i] if 0 <= i < len(self.kinds) else "end"
        return k if k in "9a_.-+()@,:/=\"'" or k == "end" else "other"

    def _beyond(self, i: int, step: int) -> str:
        """Kind of the next token that is no white space."""
        while 0 <= i < len(self.kinds) and self.kinds[i] == "_":
            i += step
        return self._side(i)

    def _numbers(self):
        n = len(self.tokens)
        for i in range(n):
            if self.kinds[i] not in ("9", "+", "("):
                continue
            digits, groups, marks = "", [], set()
            for j in range(i, min(n, i + MOST_TOKENS)):
                kind = self.kinds[j]
                if kind == "9":
                    digits += self.tokens[j]
                    groups.append(self.tokens[j])
                elif kind == "_" and self.tokens[j] == " " or kind in ("-", ".", "(", ")") or kind == "+" and j == i:
                    marks.add(kind)
                else:
                    break
                if len(digits) > 19:
                    break
                if kind != "9" or len(digits) < 4 or self._side(i - 1) == "9" or self._side(j + 1) == "9":
                    continue
                octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
                shape = "-".join(str(len(g)) for g in groups)
                common = [f"digits={len(digits)}", f"groups={min(len(groups), 6)}", f"marks={''.join(sorted(marks))}", f"left={self._side(i - 1)}", f"right={self._side(j + 1)}", f"before={self._beyond(i - 1, -1)}", f"after={self._beyond(j + 1, 1)}", f"inner={self._beyond(i - 1, -1) in '9+(' or self._beyond(j + 1, 1) in '9)'}"]
                if octets and marks == {"."}:
                    self.segments.append((i, j + 1, 1, ["ip", *(f"ip:{x}" for x in common), "ip:octets"]))
                if 16 <= len(digits) <= 19:
                    self.segments.append((i, j + 1, 2, ["card", *(f"card:{x}" for x in common), f"card:luhn={luhn(digits)}", f"card:shape={shape}"]))
                if 8 <= len(digits) <= 15:
                    self.segments.append((i, j + 1, 3, ["phone", *(f"phone:{x}" for x in common), f"phone:plus={'+' in marks}", f"phone:open={'(' in marks}", f"phone:shape={shape}", f"phone:{shape}:{self._beyond(i - 1, -1) in '9+('}"]))

    def _emails(self):
        n = len(self.tokens)
        for c in range(n):
            spelled = self.tokens[c] == "at" and 0 < c < n - 1 and self.kinds[c - 1] in ("(", "[") and self.kinds[c + 1] in (")", "]")
            if self.kinds[c] != "@" and not spelled:
                continue
            left, right = (c - 2, c + 2) if spelled else (c - 1, c + 1)
            while left >= 0 and (self.kinds[left] in "9a.%+-" or self.tokens[left] == "_" or self.kinds[left] == "_" and left == c - 2 and self.tokens[left] == " "):
                left -= 1
            while right < n and (self.kinds[right] in "9a.-" or self.kinds[right] == "_" and spelled and right == c + 2 and self.tokens[right] == " "):
                right += 1
            i, j = left + 1, right
            while j > c and self.kinds[j - 1] not in "9a":
                j -= 1
            while i < c and self.kinds[i] not in "9a":
                i += 1
            local, domain = "".join(self.tokens[i:c]).strip(" (["), "".join(self.tokens[c + 1:j]).strip(" )]")
            if local and "." in domain:
                last = domain.rsplit(".", 1)[1]
                self.segments.append((i, j, 0, ["email", f"email:spelled={spelled}", f"email:last={min(len(last), 5)}", f"email:alpha={last.isalpha()}", f"email:parts={min(domain.count('.'), 4)}", f"email:left={self._side(i - 1)}", f"email:right={self._side(j)}", f"email:digits={any(map(str.isdigit, local))}"]))

    def gold(self, spans: list[tuple[str, int, int]]) -> list[int]:
        """Places in ``segments`` of the given spans, those that overlap an earlier one left out."""
        where = {(self.begin[i], self.end[j - 1], KINDS[k]): s for s, (i, j, k, _) in enumerate(self.segments)}
        out, upto = [], 0
        for kind, a, b in sorted(spans, key=lambda x: x[1:]):
            s = where.get((a, b, kind))
            if s is not None and self.segments[s][0] >= upto:
                out.append(s)
                upto = self.segments[s][1]
        return out


class Field:
    """Weights of the features and of neighbouring types (none first)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.names, self.weights, self.pairs = names, weights, pairs

    def scores(self, w: Window) -> np.ndarray:
        return np.array([self.weights[[self.names[f] for f in fs if f in self.names]].sum() for *_, fs in w.segments])

    def decode(self, w: Window) -> list[tuple[str, int, int, float]]:
        """Best segmentation: (kind, start, end, score) of its entities. States are types; a step ends at each token."""
        if not w.segments:
            return []
        n, types, score = len(w.tokens), len(KINDS) + 1, self.scores(w)
        best, back = np.full((n + 1, types), -np.inf), {}
        best[0, 0] = 0
        at: dict[int, list[int]] = {}
        for s, seg in enumerate(w.segments):
            at.setdefault(seg[1], []).append(s)
        for j in range(1, n + 1):
            into = best[j - 1] + self.pairs[:, 0]
            best[j, 0] = into.max()
            back[j, 0] = (j - 1, int(into.argmax()), None)
            for s in at.get(j, ()):
                i, _, k, _ = w.segments[s]
                into = best[i] + self.pairs[:, k + 1]
                value = into.max() + score[s]
                if value > best[j, k + 1]:
                    best[j, k + 1] = value
                    back[j, k + 1] = (i, int(into.argmax()), s)
        j, k, out = n, int(best[n].argmax()), []
        while j > 0:
            i, before, s = back[j, k]
            if s is not None:
                a, b, kind, _ = w.segments[s]
                out.append((KINDS[kind], w.begin[a], w.end[b - 1], float(score[s])))
            j, k = i, before
        return out[::-1]


def _log_sum(x: np.ndarray) -> float:
    top = x.max()
    return top + np.log(np.exp(x - top).sum()) if np.isfinite(top) else -np.inf


def gradient(field: Field, w: Window, gold: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the log likelihood of a labelling by segment and by pair of types, and the likelihood; forward and backward sums."""
    n, types, score, pairs = len(w.tokens), len(KINDS) + 1, field.scores(w), field.pairs
    ahead, behind = np.full((n + 1, types), -np.inf), np.full((n + 1, types), -np.inf)
    ahead[0, 0], behind[n] = 0, 0
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for s, (i, j, _, _) in enumerate(w.segments):
        ends.setdefault(j, []).append(s)
        starts.setdefault(i, []).append(s)
    for j in range(1, n + 1):
        ahead[j, 0] = _log_sum(ahead[j - 1] + pairs[:, 0])
        for s in ends.get(j, ()):
            i, _, k, _ = w.segments[s]
            ahead[j, k + 1] = np.logaddexp(ahead[j, k + 1], _log_sum(ahead[i] + pairs[:, k + 1]) + score[s])
    for i in range(n - 1, -1, -1):
        behind[i] = pairs[:, 0] + behind[i + 1, 0]
        for s in starts.get(i, ()):
            _, j, k, _ = w.segments[s]
            behind[i] = np.logaddexp(behind[i], pairs[:, k + 1] + score[s] + behind[j, k + 1])
    total = _log_sum(ahead[n])
    by_segment, by_pair = np.zeros(len(w.segments)), np.zeros_like(pairs)
    for j in range(1, n + 1):
        by_pair[:, 0] -= np.exp(ahead[j - 1] + pairs[:, 0] + behind[j, 0] - total)
    for s, (i, j, k, _) in enumerate(w.segments):
        p = np.exp(ahead[i] + pairs[:, k + 1] + score[s] + behind[j, k + 1] - total)
        by_pair[:, k + 1] -= p
        by_segment[s] -= p.sum()
    value, state, chosen = 0.0, 0, {w.segments[s][0]: s for s in gold}
    j = 0
    while j < n:
        s = chosen.get(j)
        kind = w.segments[s][2] + 1 if s is not None else 0
        value += pairs[state, kind] + (score[s] if s is not None else 0)
        by_pair[state, kind] += 1
        if s is not None:
            by_segment[s] += 1
        state, j = kind, w.segments[s][1] if s is not None else j + 1
    return by_segment, by_pair, value - total


def rewritten(text: str, spans: list[tuple[str, int, int]]):
    """Copies of a labelled window whose first entity is written in another way, or spoiled (checksum, octets) and no entity."""
    if not spans:
        return
    kind, a, b = spans[0]
    body = text[a:b]
    forms = {"phone": [re.sub(r"^\+[0-9]+[ -]", "", body), body.replace("+", "00", 1), re.sub("[() ]+", "-", body.lstrip("+")).strip("-")],
             "card": [".".join(body[i:i + 4] for i in range(0, len(body), 4)) if body.isdigit() else body.replace(" ", ".")],
             "email": [body.replace("@", "(at)"), body.replace("@", "[at]"), body.replace("@", " (at) ")], "ip": []}[kind]
    wrong = body[:-1] + str((int(body[-1]) + 1) % 10) if kind == "card" else "999" + body if kind == "ip" else ""
    if wrong and not base_spans(wrong):
        yield text[:a] + wrong + text[b:], []
    for form in forms:
        if form != body:
            yield text[:a] + form + text[b:], [(kind, a, a + len(form))]


def train(samples: list[str]) -> Field:
    """A field from windows of text; windows are labelled by the base patterns."""
    data, names = [], {}
    for text in samples:
        spans = base_spans(text)
        for t, labels in [(text, spans), *rewritten(text, spans)]:
            w = Window(t)
            if w.segments:
                data.append((w, w.gold(labels)))
    for w, _ in data:
        for *_, fs in w.segments:
            for f in fs:
                names.setdefault(f, len(names))
    types = len(KINDS) + 1
    field = Field(names, np.zeros(len(names)), np.zeros((types, types)))
    steps, pair_steps = np.full(len(names), 1e-6), np.full((types, types), 1e-6)
    for _ in range(EPOCHS if data else 0):
        for w, gold in data:
            by_segment, by_pair, _ = gradient(field, w, gold)
            g = np.zeros(len(names))
            for v, (*_, fs) in zip(by_segment, w.segments):
                np.add.at(g, [names[f] for f in fs], v)
            g -= 1e-3 * field.weights
            steps += g * g
            field.weights += 0.3 * g / np.sqrt(steps)
            pair_steps += by_pair * by_pair
            field.pairs += 0.1 * by_pair / np.sqrt(pair_steps)
    return field


def learned(docs: DataFrame) -> Field:
    """A field from at most 2 x TRAIN_WINDOWS windows of the table: those of least hash, with and without base spans."""
    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                for a, b in windows(text or ""):
                    part = text[a:min(b, a + TRAIN_CHARS)]
                    out.append((part, bool(base_spans(part)), hashlib.md5(part.encode()).hexdigest()))
            part, has, key = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([int(x) for x in has], pa.int32()), pa.array(key, pa.string())], ["part", "has", "key"])
    found = docs.select("text").mapInArrow(run, "part string, has int, key string")
    found = cut(found)
    samples = [r["part"] for has in (1, 0) for r in found.where(F.col("has") == has).select("key", "part").distinct().orderBy("key").limit(TRAIN_WINDOWS).toLocalIterator()]
    return train(samples)


def spans_of(text: str, field: Field | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by kind as listed, then start."""
    base = base_spans(text)
    added = []
    if field is not None and field.names:
        taken = sorted((a, b) for _, a, b in base)
        for a, b in windows(text):
            for kind, s, e, score in field.decode(Window(text[a:b])):
                if score >= MARGIN and not any(x < a + e and a + s < y for x, y in taken):
                    added.append((kind, a + s, a + e))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda x: (order[x[0]], x[1], x[2]))


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of ``docs`` (doc_id, text).

    Counts and hash are those of the base spans, ``spans`` holds them and the added
    ones, n_added counts the latter. Offsets are in code points, ends exclusive. Null
    texts count as empty; null and repeated ids pass through; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                base, every = spans_of(text, model.value) if text and _TRIGGER.search(text) else ([], [])
                for c, kind in zip(cols, KINDS):
                    c.append(sum(k == kind for k, *_ in base))
                cols[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                cols[5].append(written(every))
                cols[6].append(len(every) - len(base))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
