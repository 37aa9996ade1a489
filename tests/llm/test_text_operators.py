"""Tokens, fingerprints, personal data and languages against libraries and brute force."""
import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import public_tokenizers
from heldout.llm import bpe, fingerprints, langid, private, token_files
from heldout.llm.queries import QUERIES

TIKTOKEN, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def strange(n, seed=0):
    rng = random.Random(seed)
    pick = lambda: rng.choice([chr(rng.randrange(32, 127)), chr(rng.randrange(0xa0, 0x250)), chr(rng.randrange(0x250, 0xd7ff)), chr(rng.randrange(0x1f300, 0x1f700)), " ", "\n", "\x1c", "\x85", rng.choice("aeiouthers'")])
    return ["".join(pick() for _ in range(rng.randrange(60))) for _ in range(n)] + ["", " ", "I'll 'sdon't", "<|endoftext|>", "a" * 5000, "ab" * 2000 + "é" * 700, "İ ΣΑΣ ǅ"]


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TIKTOKEN, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: np.array(enc.encode_ordinary(t), "<u4").tobytes()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_bpe_matches_tiktoken_and_round_trips(tiktoken_ids):
    voc, split, data = bpe.Vocabulary(TIKTOKEN), bpe.splitter(public_tokenizers.PATTERN), strange(600)
    for text, ids in zip(data, voc.encode(data, split)):
        assert ids == tiktoken_ids(text)
        assert voc.decode(ids) == text.encode()


def test_bpe_long_rows_equal_short_ones():
    voc = bpe.Vocabulary(TIKTOKEN)
    for piece in (b"abcabcabdabc" * 20, b"aaaaaaa", bytes(range(256))):
        assert voc.merge_rows([piece])[0] == voc.merge_long(piece)


def test_bpe_query(spark, folder, texts, tiktoken_ids):
    rows = QUERIES["op9_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tiktoken_ids(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_awkward(awkward, nothing, tiktoken_ids):
    rows = bpe.digests(awkward, TIKTOKEN, public_tokenizers.PATTERN).collect()
    want = [(r.doc_id, hashlib.sha256(tiktoken_ids(r.text or "")).hexdigest()) for r in awkward.collect()]
    assert sorted(((r.doc_id, r.ids_sha256) for r in rows), key=str) == sorted(want, key=str)
    assert bpe.encoded(nothing, TIKTOKEN, public_tokenizers.PATTERN).count() == 0


def test_elias_fano_selects():
    for values in ([0], [5, 5, 5], [0, 0, 1, 10**12], np.cumsum(np.random.default_rng(1).integers(0, 900, 1000)), np.arange(300) ** 2):
        e = token_files.EliasFano.unpack(token_files.EliasFano.of(values).pack())
        assert [e.select(i) for i in range(len(values))] == list(map(int, values)) == e.all().tolist()
        for a, b in ((0, len(values)), (len(values) // 3, len(values)), (len(values) // 2, len(values) // 2 + 5), (len(values) - 1, len(values))):
            b = min(b, len(values))
            assert e.values(a, b).tolist() == list(map(int, values[a:b]))
    assert token_files.EliasFano.of(np.zeros(0)).all().tolist() == []
    n = 10_000
    e = token_files.EliasFano.of(np.cumsum(np.full(n, 700)))
    assert len(e.pack()) * 8 < n * (2 + np.log2(700) + 1) + 400


def test_encoder_matches_library(library):
    data = strange(1500, 2)
    enc = token_files.Encoder(WORDS)
    assert enc.by_word
    for text, ids in zip(data, enc.encode(data)):
        assert ids == np.array(library(text), "<u2").tobytes(), text


def test_token_files_query(spark, folder, texts, library):
    rows = {r.doc_id: r for r in QUERIES["op2_elias_fano"](spark, folder).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = library(texts[doc_id]) + [1]
        r = rows[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_awkward(spark, awkward, nothing, library):
    manifest = token_files.write(awkward, WORDS, parts=3)
    rows = token_files.read(spark, manifest).collect()
    want = sorted(((r.doc_id, len(library(r.text or "")) + 1) for r in awkward.collect()), key=lambda x: (x[0] is not None, x))
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=lambda x: (x[0] is not None, x)) == want
    texts = {}                                                  # ids of each document, found by select in its file
    for row in manifest.collect():
        f = token_files.TokenFile(row.file)
        for i, doc_id in enumerate(f.doc_ids()):
            texts.setdefault(None if doc_id is None else int(doc_id), []).append([int(x) for x in f.document(i)])
    ids = {}
    for r in awkward.collect():
        ids.setdefault(r.doc_id, []).append(library(r.text or "") + [1])
    assert {k: sorted(v) for k, v in texts.items()} == {k: sorted(v) for k, v in ids.items()}
    assert token_files.read(spark, token_files.write(nothing, WORDS)).count() == 0


def test_weighted_sampling_estimates_generalised_jaccard():
    rng = random.Random(5)
    errors = []
    for _ in range(60):
        a = [f"w{rng.randrange(80)}" for _ in range(300)]
        b = a[:rng.randrange(300)] + [f"w{rng.randrange(160)}" for _ in range(150)]
        x, y = Counter(a), Counter(b)
        true = sum(min(x[k], y[k]) for k in x | y) / sum(max(x[k], y[k]) for k in x | y)
        errors.append(fingerprints.likeness(*fingerprints.signatures([" ".join(a), " ".join(b)])) - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


@pytest.mark.parametrize("words", [20_000, 60_000])
def test_long_texts_without_a_common_word_are_not_alike(words):
    a, b = (" ".join(f"{c}{i}" for i in range(words)) for c in "xy")
    assert fingerprints.likeness(*fingerprints.signatures([a, b])) <= 0.02
    half = " ".join(a.split()[:words // 2] + b.split()[:words // 2])
    assert abs(fingerprints.likeness(*fingerprints.signatures([a, half])) - 1 / 3) < 0.2


def test_weighted_sampling_blocks_and_cache_change_nothing(monkeypatch):
    texts = [" ".join(f"w{i % 700}" for i in range(n)) for n in (900, 3, 1, 2500)]
    want = fingerprints.signatures(texts)
    monkeypatch.setattr(fingerprints, "BLOCK_TERMS", 7)
    monkeypatch.setattr(fingerprints, "CACHED", 16)
    fingerprints.cache.cache_clear()
    assert fingerprints.signatures(texts) == want == [fingerprints.signatures([t])[0] for t in texts]
    fingerprints.cache.cache_clear()


def test_weighted_sampling_is_consistent():
    """ln a of a weight changes only when its t does, and grows less with the weight."""
    term = np.array([12345], np.uint64)
    values = [fingerprints.least(term, np.array([n]), np.array([0]))[0] for n in range(1, 200)]
    assert all((b <= a).all() for a, b in zip(values, values[1:]))
    assert sum((a == b).mean() for a, b in zip(values, values[1:])) > 150


def test_fingerprint_query(spark, folder, texts):
    rows = {r.doc_id: r for r in QUERIES["op6_weighted_sampling"](spark, folder).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for i, doc_id in enumerate(ids):
        text, following = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        changed = fingerprints.edited(text, following)
        mine, other, after = fingerprints.signatures([text, changed, following])
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (mine, other)
        assert r.near_edited == fingerprints.likeness(mine, other) and r.near_next == fingerprints.likeness(mine, after)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprint_awkward(awkward, nothing, parts):
    rows = fingerprints.fingerprint(awkward, parts).collect()
    assert len(rows) == awkward.count()
    by_text = {}
    for r in rows:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprint(nothing, parts).count() == 0


def test_language_awkward(spark, awkward, nothing):
    model = langid.train(awkward)
    rows = langid.predict(awkward, *model).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not langid.has_letter(r.text)) and 0 <= r.score <= 1
    assert langid.predict(nothing, *model).count() == 0
    assert {r.lang_pred for r in langid.predict(awkward, *langid.train(nothing)).collect()} == {"und"}


def test_language_counts_and_scores_match_brute_force(spark):
    texts = ["Hello you", "Grüße", "hi", "Ho"]
    rows = spark.createDataFrame([(t, l) for t, l in zip(texts, ["en", "de", "en", None])], "text string, lang string")
    languages, matrix = langid.train(rows)
    assert languages == ["de", "en"]
    counts = np.full((langid.BUCKETS, 2), langid.SMOOTH)
    grams = lambda t: [int(langid.buckets(np.array([ord(c) for c in f" {t.lower()} "][i:i + n], np.uint32), n)[0]) for n in langid.SIZES for i in range(len(t) + 3 - n)]
    for t, k in ((texts[0], 1), (texts[1], 0), (texts[2], 1)):
        for g in grams(t):
            counts[g, k] += 1
    assert np.allclose(matrix, np.log(counts / counts.sum(0)), atol=1e-6)
    assert np.allclose(langid.score(texts, matrix), [[matrix[grams(t), k].astype(float).sum() for k in (0, 1)] for t in texts])


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op8_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and private.luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_match_plain_patterns():
    rng = random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choice("ab1234 .@+-()%5678") for _ in range(rng.randrange(80)))
        assert private.base_spans(text) == plain_spans(text)
    assert private.base_spans("a" * 200_000 + "1" * 200_000 + "@") == []


def test_private_query(spark, folder, texts):
    for r in QUERIES["op3_private_spans"](spark, folder).collect():
        base = plain_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in private.KINDS]
        assert r.base_sha256 == hashlib.sha256(private.written(base).encode()).hexdigest()
        assert set(filter(None, private.written(base).split(","))) <= set(r.spans.split(","))


def test_field_decodes_the_best_segmentation():
    """Dynamic programming against all ways to cut a window; gradients against differences."""
    from itertools import combinations
    text = "at +1 (988) 555-2485 or a.b@c.de, 1.2.3.4 x"
    w, rng = private.Window(text), np.random.default_rng(0)
    names = {f: i for i, f in enumerate(sorted({f for *_, fs in w.segments for f in fs}))}
    field = private.Field(names, rng.normal(size=len(names)), rng.normal(size=(5, 5)) * 0.3)
    score = field.scores(w)

    def value(chosen):
        state, j, total, at = 0, 0, 0.0, {w.segments[s][0]: s for s in chosen}
        while j < len(w.tokens):
            s = at.get(j)
            kind = w.segments[s][2] + 1 if s is not None else 0
            total += field.pairs[state, kind] + (score[s] if s is not None else 0)
            state, j = kind, w.segments[s][1] if s is not None else j + 1
        return total

    every = [c for n in range(4) for c in combinations(range(len(w.segments)), n) if all(w.segments[a][1] <= w.segments[b][0] or w.segments[b][1] <= w.segments[a][0] for a, b in combinations(c, 2))]
    best = max(every, key=value)
    assert {(k, a, b) for k, a, b, _ in field.decode(w)} == {(private.KINDS[w.segments[s][2]], w.begin[w.segments[s][0]], w.end[w.segments[s][1] - 1]) for s in best}
    by_segment, by_pair, likelihood = private.gradient(field, w, list(best))
    p = np.exp([value(c) for c in every])
    assert likelihood == pytest.approx(value(best) - np.log(p.sum()), abs=0.05)
    for s in range(len(w.segments)):
        assert by_segment[s] == pytest.approx((s in best) - sum(q for c, q in zip(every, p) if s in c) / p.sum(), abs=0.02)


def test_field_finds_other_spellings():
    rng = random.Random(2)
    words = lambda: " ".join("".join(rng.choice("abcdelmnorst") for _ in range(rng.randrange(2, 8))) for _ in range(3))
    phones = [f"{words()} +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {words()}" for _ in range(60)]
    plain = [f"{words()} version {rng.randrange(9)}.0 {words()}" for _ in range(40)] + [f"{words()} {rng.randrange(1990, 2030)} {words()}" for _ in range(20)]
    field = private.train(phones + plain)
    base, every = private.spans_of("please call (212) 555-7788 today", field)
    assert base == [] and every == [("phone", 12, 26)]
    assert private.spans_of("in the year 2024 version 3.0 came", field)[1] == []


CONTACTS = ["please write to {} today", "{}", "(see {})"]
SPELLED = ["jo (at) mail.department.example-university.edu", "jo (at) verylongcompanyname-international.com", "a.very.long.first.name.and.a.longer.last.name[at]example.org",
           "first_middle_and_quite_long_last_name(at)example.com", "x1y2z3x1y2z3x1y2z3x1y2z3 (at) a1b2c3d4e5f6.example.com"]


def test_windows_hold_whole_addresses():
    """Long local parts, long domains and neighbours: a candidate has exactly the address, and windows do not cut each other."""
    texts = [(t.format(x), [x]) for t in CONTACTS for x in SPELLED]
    texts += [(f"{x}, {y}; {x}", [x, y, x]) for x in SPELLED for y in SPELLED] + [("ann.bartholomew (at) company.org, christopher.doe (at) company.org", ["ann.bartholomew (at) company.org", "christopher.doe (at) company.org"])]
    for text, want in texts:
        found = {text[a + w.begin[i]:a + w.end[j - 1]] for a, b in private.windows(text) for w in [private.Window(text[a:b])] for i, j, k, _ in w.segments if k == 0}
        assert set(want) <= found, text
        spans = private.windows(text)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_field_finds_long_and_neighbouring_addresses():
    rng = random.Random(4)
    words = lambda: " ".join("".join(rng.choice("abcdelmnorst") for _ in range(rng.randrange(2, 8))) for _ in range(4))
    field = private.train([f"{words()} {words().replace(' ', '.')}@{words().split()[0]}.example.{rng.choice(['com', 'org', 'edu'])} {words()}" for _ in range(80)] + [f"{words()} {rng.randrange(3000)} {words()}" for _ in range(40)])
    for x in SPELLED[:4]:
        text = f"please write to {x} or {x} today"
        assert [text[a:b] for k, a, b in private.spans_of(text, field)[1]] == [x, x]


def test_private_awkward(awkward, nothing):
    field = private.learned(awkward)
    assert private.find(awkward, field).count() == awkward.count()
    assert private.find(nothing, private.learned(nothing)).count() == 0
