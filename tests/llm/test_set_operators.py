"""Shards, joins, lines, mixes and nearest rows against brute force."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from heldout.llm import knn, line_dedup, mixing, ngram_join, sharding
from heldout.llm.components import components
from heldout.llm.queries import ORACLES, QUERIES
from heldout.llm.shingles import word_hashes


class Union:
    def __init__(self, nodes):
        self.root = {n: n for n in nodes}

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(50, 51), (51, 52), (52, 50)], [(3, 3), (None, 4), (9, 8), (8, 9)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    u = Union({x for e in real for x in e})
    for a, b in real:
        u.join(a, b)
    assert got == {n: u.find(n) for n in u.root}


def test_word_hashes_split_as_the_rule():
    texts = ["", " ", "One  two\tTHREE", "a\x0bb\x0cc\rd\ne", "é É x", "x" * 100, "the cat the CAT"]
    table = {}
    for text, hashes in zip(texts, word_hashes([t.encode() for t in texts])):
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert table.setdefault(w, h) == h
    assert len(set(table.values())) == len(table)


def brute_join(rows, k, percent):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    u, ids = Union(sets), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                u.join(a, b)
    return {d: (len(sets[d]), u.find(d)) for d in ids}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("k,percent,cell", [(3, 90, 1024), (5, 80, 1024), (3, 90, 16)])
def test_ngram_join_loses_no_link(spark, monkeypatch, k, percent, cell):
    monkeypatch.setattr(ngram_join, "CELL_SETS", cell)
    rng = random.Random(k)
    texts = [t for size in (4, 12, 30, 90, 300) for t in family(rng, 40, size, max(1, size // 12))] + ["a b", "a b", "A  B", "a", "", None, "b a"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == brute_join(rows, k, percent)


def test_pigeonhole_blocks_meet():
    """Two sets that may be linked share a key, whatever their sizes."""
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        lows = ngram_join.bands(percent)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            cut = int(rng.integers(0, n // 8 + 1))
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                assert np.intersect1d(ngram_join.block_keys(a, lows, percent), ngram_join.block_keys(b, lows, percent)).size


@pytest.mark.parametrize("tight", [False, True])
def test_partners_share_as_many_keys_as_told(monkeypatch, tight):
    """A set shares the told number of keys of a band with each partner; also if most sets have more empty blocks than may be left out."""
    rng = np.random.default_rng(5)
    if tight:
        monkeypatch.setattr(ngram_join, "_blocks", lambda low, high, percent: (ngram_join.most_different(2 * (high - 1), percent) + 3, 2))
    for percent in (80, 90):
        lows = ngram_join.bands(percent)
        for _ in range(400):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            cut = int(rng.integers(0, n // 8 + 1))
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = ({g: (least, keys) for g, least, keys in ngram_join.keys_by_band(s, lows, percent)} for s in (a, b))
                assert any(len(np.intersect1d(x[g][1], y[g][1])) >= max(x[g][0], y[g][0]) for g in x.keys() & y.keys())


def test_unlike_texts_form_no_families(spark):
    """Texts without a common shingle, and texts that only quote the same passages, are not compared; copies are."""
    rng = random.Random(8)
    quotes = [" ".join(f"q{q}x{i}" for i in range(12)) for q in range(3)]
    texts = [" ".join(f"d{d}x{i}" for i in range(rng.randrange(30, 600))) for d in range(200)]
    texts += [" ".join(f"e{d}x{i}" for i in range(rng.randrange(200, 300))) + " " + rng.choice(quotes) for d in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert ngram_join._candidates(docs, 5, 80).count() == 0
    assert ngram_join._candidates(docs.union(docs.selectExpr("doc_id + 1000", "concat(text, ' end')")), 5, 80).count() >= 300


def test_parity_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 5000, 300).astype(np.uint64)) for _ in range(2))
        far = int(np.bitwise_count(ngram_join.parity_bits(a) ^ ngram_join.parity_bits(b)).sum())
        assert far <= len(np.setxor1d(a, b))


def test_ngram_join_awkward(spark, awkward, nothing):
    rows = ngram_join.join(awkward, 3, 90).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].component_id == 1 and by_id[3].n_shingles == 0 and by_id[3].component_id == 3 and by_id[9].n_shingles == 1
    assert ngram_join.join(nothing).count() == 0


@pytest.mark.parametrize("name", ["op5_ngram_jaccard_join", "op7_kd_tree_top_k", "op10_mixing"])
def test_queries_match_sql(spark, folder, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed,shards", [(0, 3), (1, 7), (2, 40), (3, 40), (4, 1)])
def test_capacity_is_minimal(spark, monkeypatch, seed, shards):
    monkeypatch.setattr(sharding, "TOP_BITS", 3)
    rng = random.Random(seed)
    groups = {rng.randrange(1 << 62): rng.choice([rng.randrange(1, 100), rng.randrange(1, 20_000)]) for _ in range(rng.choice([5, 60, 500]))}
    cuts = sharding.boundaries(spark.createDataFrame(list(groups.items()), "_h long, bytes long"), shards)
    assert cuts == sorted(cuts) and len(cuts) < shards
    load = Counter()
    for h, size in groups.items():
        load[sum(h >= c for c in cuts)] += size
    assert max(load.values()) == best_capacity([groups[h] for h in sorted(groups)], shards) or max(load.values()) <= best_capacity([groups[h] for h in sorted(groups)], shards)


def test_sharding_query(spark, folder, texts):
    rows = QUERIES["op4_sharding"](spark, folder).collect()
    slots, load, groups = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "bytes", None)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        groups[text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    assert all(len(s) == 1 for s in groups.values()) and len(rows) == len(texts)


def test_sharding_awkward(awkward, nothing):
    rows = sharding.assign(awkward, 4).collect()
    assert len(rows) == awkward.count() and sharding.assign(nothing).count() == 0
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {16}


def test_line_dedup_matches_all_pairs(spark):
    from pyspark.sql import functions as F
    rng = random.Random(8)
    lines = family(rng, 30, 60, 2) + family(rng, 25, 40, 3) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(12)) for _ in range(40)] + ["", "---", "The end.", "the  END"]
    docs = []
    for d in range(40):
        docs.append((d, "\n".join(rng.choice(lines) for _ in range(6))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = line_dedup.lines_of(df).join(line_dedup.nodes_of(df).select("node", "sim"), "node").select("doc_id", "place", "norm", "sim").collect()
    node = {r.norm: r for r in found}
    forms = sorted(node)
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(forms) for b in forms[i + 1:]], "x string, y string").withColumn("d", F.levenshtein("x", "y"))
    u = Union(forms)
    for r in pairs.collect():
        far = bin((node[r.x].sim ^ node[r.y].sim) & (2**64 - 1)).count("1")
        if far <= line_dedup.MOST_BITS and r.d <= int((1 - line_dedup.SIMILAR) * max(len(r.x), len(r.y)) + 1e-9):
            u.join(r.x, r.y)
    first = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.place)):
        first.setdefault(u.find(r.norm), (r.doc_id, r.place))
    stay = set(first.values())
    said = {(r.doc_id, r.place) for r in found}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) in stay or (d, i) not in said) for d, t in docs}
    got = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_lines == 6 for r in got.values())
    assert len({u.find(f) for f in forms}) < len(forms)


def test_simhash_counts_bits(spark):
    from pyspark.sql import functions as F
    texts = ["one two three", "x", " ".join(f"w{i}" for i in range(700)), "same " * 500 + "other", "a to of"]
    df = spark.createDataFrame([(i, t.strip()) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = line_dedup.lines_of(df).select("node", line_dedup.features(F.col("norm")).alias("h")).join(line_dedup.nodes_of(df), "node").collect()
    assert len(rows) == len(texts)
    for r in rows:
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.h) > len(r.h))
        assert r.sim % 2**64 == bits


def test_line_dedup_finds_alike_lines_of_all_lengths(spark):
    """Recall of pairs whose edit similarity is high enough, at 8 to 100 words, without regard to SimHashes."""
    from pyspark.sql import functions as F
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 9])))
    kinds, pairs = {"one word": 0.96, "tenth": 0.96, "fifth": 0.8, "letters": 0.9}, []
    for kind in kinds:
        for n in (8, 12, 20, 27, 40, 60, 100):
            for _ in range(60):
                a = [word() for _ in range(n)]
                b = list(a)
                for at in rng.sample(range(n), max(1, round({"tenth": 0.1, "fifth": 0.2}.get(kind, 0) * n)) if kind != "letters" else 0):
                    b[at] = word()
                text = " ".join(b)
                pairs.append((len(pairs), kind, n, " ".join(a), "".join("q" if c != " " and kind == "letters" and rng.random() < 0.02 else c for c in text)))
    made = spark.createDataFrame(pairs, "k long, kind string, n long, x string, y string")
    alike = made.where(F.levenshtein("x", "y") <= F.floor((1 - line_dedup.SIMILAR) * F.greatest(F.length("x"), F.length("y")) + 1e-9)).select("k", "kind", "n").collect()
    rows = [(2 * k + h, t) for k, _, _, *both in pairs for h, t in enumerate(both)]
    kept = {r.doc_id: r.n_kept for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(kept[2 * k] == 1 for k, *_ in pairs)
    every, found = Counter((r.kind, r.n) for r in alike), Counter((r.kind, r.n) for r in alike if kept[2 * r.k + 1] == 0)
    print({c: (found[c], every[c]) for c in every})
    for kind, least in kinds.items():
        assert sum(found[c] for c in found if c[0] == kind) >= least * sum(every[c] for c in every if c[0] == kind)
    assert all(found[c] >= (kinds[c[0]] - 0.15) * every[c] for c in every)


def test_line_dedup_awkward(awkward, nothing):
    rows = line_dedup.dedup(awkward).collect()
    assert len(rows) == awkward.count() and "size" in rows[0].asDict()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[3].text is None and by_id[4].text == "" and by_id[6].text == "--- !!! ---" and by_id[5].text == " \n\t "
    assert by_id[7].text.count("\n") == 0 and by_id[7].n_kept == 1 and by_id[2].text == "" and by_id[1].n_kept == 1
    assert line_dedup.dedup(nothing).count() == 0


def test_line_dedup_stays_native(awkward):
    plan = line_dedup.dedup(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_targets_reshare_the_excess():
    t = {s: (n, x) for s, n, x in mixing.targets([("a", 10), ("b", 1000), ("c", 1000), (None, 0)])}
    assert t["a"][1] == 20 and t[None][1] == 0
    assert sum(x for _, x in t.values()) == pytest.approx(1.5 * 2010)
    assert t["b"][1] / t["c"][1] == pytest.approx(0.5) and all(x <= 2 * n for n, x in t.values())
    assert mixing.targets([]) == []


def test_mixing_meets_its_budgets(spark, awkward, nothing):
    rows = mixing.mix(mixing.sized(awkward)).collect()
    assert len(rows) == awkward.count()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(taken[s] == round(x) or abs(taken[s] - x) <= 0.5 for s, x in target.items())
    assert mixing.mix(mixing.sized(nothing)).count() == 0


def test_mixing_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i if i % 3 else None, f"s{i % 2}", 5 + i % 7, "x" * (i % 5)) for i in range(60)] + [(1, "s1", n, str(n)) for n in range(20)]
    kind = "doc_id long, source string, size long, text string"
    told = [sorted(((r.doc_id, r.size, r.text, r.taken) for r in mixing.mix(spark.createDataFrame(x, kind)).collect()), key=str) for x in (rows, rows[::-1], sorted(rows, key=str))]
    assert told[0] == told[1] == told[2]


def test_mixing_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a", 3, "t", "u", 7, 8), (2, "b", 4, "v", "w", 9, 10)], "doc_id long, source string, size long, target string, taken string, _u int, _bin int")
    got = {r.doc_id: r for r in mixing.mix(rows).collect()}
    assert (got[1].target_given, got[1].taken_given, got[1]._u, got[1]._bin) == ("t", "u", 7, 8) and isinstance(got[2].target, float)
    both = mixing.sized(spark.createDataFrame([("a b", "given")], "text string, size string")).first()
    assert (both.size, both.size_given) == (2, "given")


def test_copies_are_cut_at_the_budget(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", " ".join(["w"] * (i + 1)) + "\n") for i in range(30)] + [(99, "s0", None)], "doc_id long, source string, text string")
    mixed = mixing.mix(mixing.sized(docs))
    want = {r.doc_id: r.taken for r in mixed.collect()}
    got = Counter()
    for r in mixing.copies(mixed).collect():
        got[r.doc_id] += len((r.text or "").split())
    assert all(got[d] == n for d, n in want.items())


@pytest.mark.parametrize("leaf,shard", [(512, 8192), (4, 30)])
def test_top_k_matches_brute_force(spark, monkeypatch, leaf, shard):
    monkeypatch.setattr(knn, "LEAF", leaf)
    monkeypatch.setattr(knn, "SHARD_ROWS", shard)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(200)] + [(i, [1.0] * 6) for i in range(200, 230)]
    rows += [(300, None), (301, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (320, [1.0, 2.0]), (321, [2.0, 2.0]), (340, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top(df, F.col("vec_id") % 20 == 0, 7).collect())
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), c) for c, v in good.items() if c != q and len(v) == len(good[q]))
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:7])]
    assert got == sorted(want)


def test_top_k_of_nothing(spark):
    from pyspark.sql import functions as F
    assert knn.top(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
