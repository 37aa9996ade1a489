"""Conversations, pieces and runs against brute force and the sentencepiece library."""
import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

import public_tokenizers
from heldout.llm import conversations, periods, pieces
from heldout.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
sha = lambda t: hashlib.sha256(t.encode() if isinstance(t, str) else t).hexdigest()


# --- conversations ---

def cheapest(initials, faults):
    """Plain DP over (row, state) with whole audits; inserts are relaxed until nothing changes."""
    then = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(now):
        for _ in range(4):
            for s, (cost, audit) in list(now.items()):
                for x in "ua":
                    if x in then[s]:
                        now[then[s][x]] = min(now.get(then[s][x], (10**9, "")), (cost + 5, audit + "I"))
        return now

    now = {0: (0, "")}
    for x, f in zip(initials, faults):
        new = {}
        for s, (cost, audit) in inserted(now).items():
            ways = [("D", 2, s)]
            if f in ("", "truncated"):
                more = 5 if f else 0
                ways += [("K", more, then[s][x])] if x in then[s] else []
                ways += [("R", 1 + more, then[s][y]) for y in "ua" if y in then[s]]
            for edit, price, t in ways:
                new[t] = min(new.get(t, (10**9, "")), (cost + price, audit + edit))
        now = new
    now = inserted(now)
    return min(now[s] for s in (0, 3) if s in now)


def judged(rows):
    """What the contract says of the damaged rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = cheapest(initials, faults)
    turns = [r[0] for r in rows if r[0] is not None]
    at, told = iter(rows), []
    odd = sum(c != "D" for c in audit) % 2
    for c in audit:
        row = None if c == "I" else next(at)
        if c != "D":
            role = row[1] if c == "K" else ("user", "assistant")[(len(told) - odd) % 2]
            told.append(f"{role}:{row[2] if row else ''}")
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(told)))


def broken(rows):
    out = {}
    text_of = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        mine = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text_of(text)) if kind == 2 else text_of(text)
            mine += [(turn, "user" if kind == 4 else text_of(role), text)] * (2 if kind == 3 else 1)
    return {conv: judged(mine) if mine else (0, 0, 0, 0, 0, 0, "", sha("")) for conv, mine in out.items()}


def test_least_way_and_products_of_chunks_match_brute_force():
    rng, names = random.Random(2), ["", "blank", "duplicate", "truncated"]
    for _ in range(1500):
        n = rng.randrange(26)
        initials, faults = "".join(rng.choice("suuaa-") for _ in range(n)), "".join(rng.choice("00000123") for _ in range(n))
        best = cheapest(initials, [names[int(f)] for f in faults])
        assert conversations.least_way(initials, faults, conversations.START, conversations.ENDS, True) == best
        whole = None
        for k in range(0, n, 7):
            part = conversations.matrix(initials[k:k + 7], faults[k:k + 7], k == 0, k + 7 >= n)
            whole = part if whole is None else conversations.times(whole, part)
        assert whole is None or whole[0] == best


def test_conversation_query(spark, folder):
    t = pq.read_table(f"{folder}/conversations.parquet").to_pydict()
    want = broken(zip(t["conv_id"], t["turn"], t["role"], t["text"]))
    rows = QUERIES["op11_conversation_repair"](spark, folder).collect()
    assert {r.conv_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)


AWKWARD_TURNS = [(None, 0, "user", "Who?", 1), (None, 1, "assistant", "Nobody.", 1), (1, None, None, None, 2), (1, 2, "user", None, 2), (1, 2, "user", "Twice.", 2), (1, 2, "user", "Twice.", 2),
                 (1, 2, "assistant", "Tied.", 3), (2, 5, "", "no role!", 0), (2, -3, "system", "x" * 20000 + ".\n\t ", 0), (2, 9, "User", "é .", 0), (3, None, "user", "a.\u0085", 0), (4, 7, "assistant", "\x0b", 0)]


@pytest.mark.parametrize("size,fan", [(512, 64), (4, 2)])
def test_conversations_of_any_length_and_awkward_rows(spark, size, fan):
    rng = random.Random(5)
    long_ = [(77, t // 2, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", "", f"Turn {t}!", f"cut {t}"]), 0) for t in range(150)]
    rows = AWKWARD_TURNS + long_
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    report, kept = conversations.repaired(df, size, fan)
    digest = {r[0]: r[1] for r in conversations.digests(kept).collect()}
    of = {}
    for conv, turn, role, text, _ in rows:
        of.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    got = {r.conv_id: (*tuple(r)[1:], digest.get(r.conv_id, sha(""))) for r in report.collect()}
    assert got == {conv: judged(mine) for conv, mine in of.items()}


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, kept = conversations.repaired(conversations.damaged(none))
    assert report.count() == 0 and kept.count() == 0 and conversations.digests(kept).count() == 0


# --- pieces ---

def test_pieces_match_the_library():
    rng = random.Random(3)
    pick = lambda: rng.choice([chr(rng.randrange(32, 127)), chr(rng.randrange(0xa0, 0x250)), chr(rng.randrange(0x250, 0xd7ff)), chr(rng.randrange(0x1f300, 0x1f700)), " ", " ", "\n", "▁", "e", "th"])
    texts = ["".join(pick() for _ in range(rng.randrange(60))) for _ in range(800)] + ["", " ", "  ", "▁", "▁▁a", "a  b", "<s>a</s>", "<0x41>", "\0", "x" * 4000, "ab" * 3000, " a" * 500, "the end "]
    model, seen = pieces.Pieces(MODEL), {}
    for text, ids in zip(texts, model.encode(texts, seen)):
        assert ids == model.library.encode(text, add_eos=True) and model.decode(ids) == model.library.decode(ids)
        assert model.merge(model.marked(text)) == tuple(ids[:-1])       # units change nothing
    assert model.decode([2]) == model.decode([]) == "" and model.decode([1, 259, 2]) == model.library.decode([1, 259, 2])


def test_pieces_of_short_units_are_those_of_the_agenda():
    import random
    model, draw = pieces.Pieces(MODEL), random.Random(4)
    for unused in (set(), set(draw.sample(sorted(model.id), 4000))):
        model.unused = unused
        for n in [0, 1, 2, *range(3, 60)] * 3:
            unit = "".join(draw.choices("aetoinshr\u2581\u00e9\u4e00", [9, 9, 9, 9, 9, 9, 9, 9, 9, 2, 1, 1], k=n))
            a, b, made_a, made_b = list(unit), list(unit), {}, {}
            model._merge_short(a, made_a), model._merge_long(b, made_b)
            assert a == [*filter(None, b)] and made_a == made_b


def test_pieces_notice_another_result():
    model = pieces.Pieces(MODEL)
    del model.cost["▁the"]
    with pytest.raises(ValueError, match="library"):
        model.encode(["the thing there"], {})


def test_pieces_query_and_awkward_rows(spark, folder, texts, awkward, nothing):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def told(text):
        ids = lib.encode(text or "", add_eos=True)
        return len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))
    rows = QUERIES["op12_sentencepiece"](spark, folder).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: told(t) for i, t in texts.items()} and len(rows) == len(texts)
    got = sorted((tuple(r) for r in pieces.encoded(awkward, MODEL).select("doc_id", "n_tokens", "decoded").collect()), key=str)
    assert got == sorted(((r.doc_id, told(r.text)[0], r.text or "") for r in awkward.collect()), key=str)
    assert pieces.encoded(nothing, MODEL).count() == 0


# --- runs ---

def runs_by_definition(words):
    """Every diagonal, word by word; of equal stretches the smallest period."""
    n, found = len(words), {}
    for d in range(1, n // 2 + 1):
        i = d
        while i < n:
            j = i
            while j < n and words[j] == words[j - d]:
                j += 1
            if j - i >= d and j - i + d >= 12:
                found.setdefault((i - d, j - i + d), d)
            i = j + 1
    return sorted(((s, m, d) for (s, m), d in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_match_the_definition():
    rng = random.Random(1)
    for _ in range(1500):
        kinds = rng.choice([1, 2, 3, 5])
        words = [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(4)):
            if len(words) > 4:
                a = rng.randrange(len(words))
                p, e = 1 + rng.randrange(max(1, (len(words) - a) // 2)), rng.randrange(a, len(words))
                for i in range(a, e):
                    words[i] = words[a + (i - a) % p]
        assert periods.runs_of(words) == runs_by_definition(words)


def test_long_texts_of_few_words_stay_fast():
    assert periods.runs_of([b"a"] * 100_000) == [(0, 100_000, 1)]
    rows = [w for i in range(20_000) for w in (b"GET", b"of", b"one", b"page", b"took", b"only", b"%d" % i)]
    assert periods.runs_of(rows) == []


def told_of(doc_id, text, damage=True):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if damage and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_definition(words) if n < 3000 else [(0, n, 1)] if len(set(words)) == 1 else periods.runs_of(words)
    gone = {i for s, m, d in runs for i in range(s + d, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query(spark, folder, texts):
    rows = QUERIES["op13_periodic_runs"](spark, folder).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: told_of(i, t) for i, t in texts.items()} and len(rows) == len(texts)


def test_runs_of_awkward_rows(spark, awkward, nothing):
    got = sorted(((r.doc_id, len(r.runs), sha(r.collapsed)) for r in periods.detect(awkward).collect()), key=str)
    assert got == sorted(((r.doc_id, *(told_of(r.doc_id, r.text, False)[k] for k in (0, -1))) for r in awkward.collect()), key=str)
    assert periods.detect(nothing).count() == 0
