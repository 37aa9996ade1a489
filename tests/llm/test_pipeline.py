"""The pipeline's stages, each held against plain Python on its own input."""
import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as C
import public_tokenizers
from heldout.llm import langid, mixing
from heldout.llm.shared import cut, documents
from test_set_operators import brute_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output rows of each stage over the smallest table."""
    docs, out = documents(spark, folder), {}
    for name, stage in C.STAGES:
        done = cut(stage(spark, docs, folder))
        out[name] = (docs.collect(), done.collect(), done.columns)
        docs = done
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mixing", "byte_bpe"]
    assert all(stages[n][2] == COLUMNS for n, _ in C.STAGES[:-1]) and stages["byte_bpe"][2] == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_language_id_keeps_clear_texts(stages):
    before, after, _ = stages["language_id"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) >= 0.98 * len(before)
    assert all(langid.has_letter(r.text) for r in after)


FOREIGN = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
           "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
           "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani",
           "Все люди рождаются свободными и равными в своем достоинстве и правах", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van"]


def test_language_id_rejects_unclear_texts(spark):
    """Gibberish, foreign texts and halves of two languages go, clean texts of all lengths stay."""
    import random
    docs, rng = documents(spark, "/root/testdata/sf0.01"), random.Random(1)
    by = {}
    for r in docs.select("lang", "text").where("lang is not null and length(text) > 2100").orderBy("doc_id").collect():
        if not re.search(r"[$%&#*]{3}", r.text):
            by.setdefault(r.lang, []).append(r.text)
    planted = [("foreign", t) for t in FOREIGN]
    for n in (60, 150, 400, 1000):
        for _ in range(60):
            a, b = rng.sample(sorted(by), 2)
            planted += [(f"mixed {n}", rng.choice(by[a])[:n // 2] + " " + rng.choice(by[b])[:n // 2]), (f"gibberish {n}", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)))]
    for n in (3, 10, 30, 100, 300, 1000):
        planted += [(f"clean {n}", rng.choice(by[rng.choice(sorted(by))])[20:20 + n].replace("\n", " ") + "a") for _ in range(100)]
    rows = spark.createDataFrame([(10**9 + i, t) for i, (_, t) in enumerate(planted)], "doc_id long, text string")
    kept = {r.doc_id for r in C.language_id(spark, docs.select("doc_id", "text", "lang").unionByName(rows, allowMissingColumns=True), "").select("doc_id").collect()}
    stay, every = Counter(k for i, (k, _) in enumerate(planted) if 10**9 + i in kept), Counter(k for k, _ in planted)
    print({k: (stay[k], every[k]) for k in every})
    assert stay["foreign"] == 0 and all(stay[f"gibberish {n}"] == 0 for n in (60, 150, 400, 1000))
    assert all(stay[f"mixed {n}"] <= 0.1 * every[f"mixed {n}"] for n in (150, 400, 1000))
    assert all(stay[k] >= 0.98 * every[k] for k in every if k.startswith("clean"))


@pytest.mark.parametrize("held", [1, 7, 8, 20])
def test_language_id_has_limits_for_languages_of_any_size(spark, held):
    """Few or many labelled texts of a language: gibberish near it goes, its own texts stay."""
    import random
    rng = random.Random(held)
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang").where("length(text) > 300")
    known = {r.doc_id for r in docs.where("lang = 'de'").select("doc_id", langid.held_out(docs.doc_id).alias("h")).where("h").orderBy("doc_id").limit(held).collect()}
    some = docs.where((docs.lang != "de") | ~langid.held_out(docs.doc_id) | docs.doc_id.isin(*known))
    junk = [(10**9 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüß     ") for _ in range(400)), None) for i in range(60)]
    kept = {r.doc_id for r in C.language_id(spark, some.unionByName(spark.createDataFrame(junk, docs.schema)), "").select("doc_id").collect()}
    own = {r.doc_id for r in some.where("lang = 'de'").select("doc_id").collect()}
    assert not any(i >= 10**9 for i in kept) and len(own & kept) >= 0.97 * len(own)


def test_copies_with_blank_lines_go(spark):
    text = "The first paragraph of a text that is copied whole.\n\nIts second paragraph follows after a blank line."
    rows = spark.createDataFrame([(1, text, "en", "a", 9), (2, text, "en", "a", 9), (3, "\n \n", None, None, 3), (4, "--- ***", None, None, 7)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in C.dedup_lines(spark, rows, "").collect()}
    assert got == {1: text, 3: "\n \n", 4: "--- ***"}


def test_texts_of_one_id_are_documents_of_their_own(spark):
    alpha, beta = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    rows = [(7, alpha, "en"), (7, beta, "en"), (7, beta, "en"), (9, alpha + " end", "en"), (3, beta + " end", "en"), (None, "one two three four five six", None), (None, "one two three four five six", None), (5, "", "en"), (5, "", "en")]
    want = sorted([(7, alpha), (3, beta + " end"), (None, "one two three four five six"), (5, ""), (5, "")], key=str)
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string")
        assert sorted(((r.doc_id, r.text) for r in C.near_duplicates(spark, docs, "").collect()), key=str) == want


def test_lines_stand_once(stages):
    before, after, _ = stages["line_dedup"]
    form = lambda x: " ".join(re.sub(r"[^\w]|_", " ", x.lower()).split())
    lines = lambda rows: Counter(form(x) for r in rows for x in r.text.split("\n") if form(x))
    old, new = lines(before), lines(after)
    assert set(new) <= set(old) and max(new.values()) == 1
    assert len(old) - len(new) <= 0.1 * len(old)
    texts = {r.doc_id: r.text.split("\n") for r in before}
    for r in after:
        rest = iter(texts[r.doc_id])
        assert all(any(x == y for y in rest) for x in r.text.split("\n")) and r.n_chars == len(r.text)


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages["ngram_jaccard_join"]
    found = brute_join([(r.doc_id, r.text) for r in before], 5, 80)
    assert {r.doc_id for r in after} == {d for d, (n, c) in found.items() if n == 0 or c == d}


def test_sources_meet_their_targets(stages):
    before, after, _ = stages["mixing"]
    words = lambda rows: Counter({s: sum(len((r.text or "").split()) for r in rows if r.source == s) for s in {r.source for r in rows}})
    for source, _, target in mixing.targets(list(words(before).items())):
        assert abs(words(after)[source] - target) <= 0.5 + 1e-9


def test_ids_are_those_of_the_library(stages):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after, _ = stages["byte_bpe"]
    want = Counter((r.doc_id, np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before)
    assert Counter((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in after) == want


def test_awkward_and_empty_tables(spark, awkward, nothing):
    for first in (awkward, nothing):
        docs = first
        for name, stage in C.STAGES[:-1]:
            docs = cut(stage(spark, docs, ""))
            assert docs.columns == first.columns, name
        done = cut(C.STAGES[-1][1](spark, docs, ""))
        assert done.count() == docs.count() and (first is awkward or done.count() == 0)


def test_registered(spark):
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
