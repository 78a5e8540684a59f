"""Jaccard join, neighbours, mixing, BPE and the pipeline on small tables."""

import base64
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, components, jaccard_join, mixing
from tessera.llm.common import table

SF = os.environ.get("TESSERA_SF", "/root/testdata/sf0.001")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(14):
        base = [word() for _ in range(rng.choice([3, 5, 9, 20, 60, 150, 400]))]
        if g % 3 == 0:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.choice([1, 2, 6, 14])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy) if rng.random() < 0.8 else "\n".join(copy).upper() + " ")
    rng.shuffle(rows)
    return [*enumerate(rows), (1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one\ttwo"), (1005, "Ünïcode ÄÖ İ x"), (1006, "ünïcode ÄÖ İ x"), (1007, "word and more " * 20_000)]


@pytest.mark.parametrize(("seed", "block", "unit"), [(1, 1_000_000, None), (2, 50, None), (3, 50, 300), (4, 1_000_000, None)])
def test_join_like_brute_force(spark, monkeypatch, seed, block, unit):
    if unit:
        monkeypatch.setattr(jaccard_join, "BLOCK", unit)
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, block=block, sample=50, least=4).collect()}
    assert got == brute_components(rows)


def test_pipeline_drops_near_copies_at_five_words_and_eighty_percent(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(1000)]
    long = base + [f"x{i}" for i in range(200)]  # 0.833
    longer = base + [f"y{i}" for i in range(300)]  # 0.769
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(long)), (3, " ".join(longer)), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.remove_near_copies(spark, docs, SF).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(docs).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize(("percent", "block"), [(80, 1_000_000), (80, 50)])
def test_join_of_five_words_like_brute_force(spark, percent, block):
    rows = near_copies(5)[:-1]
    sets = {i: (lambda w: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, words=5, percent=percent, block=block).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_join_edges(spark):
    schema = "doc_id long, text string, id int"
    assert jaccard_join.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e", 1), (5, "a b c d e", 2), (5, "a b c d e", 3), (4, "A B C D E", 4), (None, None, 5)], schema)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()), key=str)
    assert got == [(4, 2, 4), (5, 2, 4), (5, 2, 4), (None, 0, None), (None, 2, None)]
    left = jaccard_join.one_of_each(odd)
    assert left.columns == odd.columns and sorted(r.id for r in left.collect()) == [1, 4, 5]


def test_cuts_have_a_block_to_spare():
    make = jaccard_join.Cuts()
    make(80_000)
    cuts = [None, *({c: (b, s) for c, b, s in make(n)} for n in range(1, 71_000))]
    for n in [*range(1, 400), *range(400, 3000, 23), *range(3000, 60_000, 997)]:
        for t in range(n, n * 100 // 85 + 1, max(1, n // 40)):
            assert any(b - s > jaccard_join.most_differences(n + t) for _, (b, s) in cuts[n].items() & cuts[t].items()), (n, t)


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_list_though_the_least_blocks_are_left_out(percent):
    rng = np.random.default_rng(percent)
    cuts, none = jaccard_join.Cuts(percent), np.zeros(0, np.uint64)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    with np.errstate(over="ignore"):
        for n in [1, 2, 3, 5, 8, *range(10, 400, 6), 900, 3000]:
            for seed in (0, 1):
                for _ in range(12):
                    s = draw(n)
                    union = rng.integers(n, n * 100 // percent + 1)
                    lost = rng.integers(0, n - -(-percent * union // 100) + 1)  # as far apart as linked sets may be
                    t = np.union1d(rng.permutation(s)[: n - lost], draw(union - n))
                    common = np.sort(rng.permutation(s)[: n // 3]) if rng.random() < 0.5 else none
                    assert np.intersect1d(jaccard_join.keys(s, common, cuts, seed), jaccard_join.keys(t, common, cuts, seed)).size, (n, seed, lost)
                    assert len(jaccard_join.keys(s, none, cuts, seed)) <= sum(b - k for _, b, k in cuts(n)) + 2 * (n - -(-percent * n // 100) + 1)


@pytest.mark.parametrize(("own", "pool", "shared"), [(40, 500, 4), (250, 300, 6)])
def test_sets_that_share_single_shingles_stay_apart(own, pool, shared):
    rng, cuts, none = np.random.default_rng(3), jaccard_join.Cuts(80), np.zeros(0, np.uint64)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
    pool, root = draw(pool), list(range(4000))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    with np.errstate(over="ignore"):
        ks = [jaccard_join.keys(np.unique(np.concatenate([draw(own), rng.choice(pool, shared, replace=False)])), none, cuts) for _ in root]
    nodes = np.repeat(np.arange(len(ks)), [len(k) for k in ks])
    for a, b in zip(*jaccard_join.chained(np.concatenate(ks), nodes)[2:], strict=True):
        root[top(a)] = top(b)
    # one component held 2,578 and 1,297 of them, when blocks of one element were lists as good as any
    assert np.bincount([top(x) for x in root]).max() <= 10


def test_search_like_brute_force():
    rng = np.random.default_rng(4)
    for trial in range(60):
        percent = int(rng.choice([60, 80, 85, 95]))
        base = [rng.choice(300, int(rng.integers(1, 60)), replace=False) for _ in range(6)]
        sets = []
        for _ in range(50):
            s = set(base[rng.integers(6)].tolist())
            for _ in range(int(rng.integers(0, 5))):
                s.symmetric_difference_update({int(rng.integers(300))})
            sets.append(np.array(sorted(s or {1000 + trial}), np.int64))
        m = len(sets)
        link = np.array([[100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for b in sets] for a in sets])
        reach = link.copy()
        for _ in range(7):
            reach = (reach.astype(int) @ reach.astype(int)) > 0
        assert jaccard_join.search(sets, percent).tolist() == [int(np.flatnonzero(reach[i])[0]) for i in range(m)]


def test_answers_are_derived_and_blocks_are_skipped(monkeypatch):
    counted, looked = [], []
    overlaps, met = jaccard_join.Lists.overlaps, jaccard_join.Lists.met
    monkeypatch.setattr(jaccard_join.Lists, "overlaps", lambda self, x, others: (counted.append(len(others)), overlaps(self, x, others))[1])
    monkeypatch.setattr(jaccard_join.Lists, "met", lambda self, x, left: (looked.append(x), met(self, x, left))[1])
    chain = [np.arange(i, i + 100) for i in range(0, 400, 4)]  # each links to its neighbours only
    assert set(jaccard_join.search(chain, 85).tolist()) == {0}
    assert len(looked) >= 50 and sum(counted) < 0.1 * 100 * 100


def test_words_that_a_polynomial_would_confuse(spark):
    flip = lambda s: s.translate(str.maketrans("ab", "ba"))
    w1 = "a"
    for _ in range(10):
        w1 += flip(w1)
    w2 = flip(w1)
    data = [(1, f"{w1} x y z"), (2, f"{w2} x y z"), (3, f"{w1} x y z {w2} x y z")]
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (5, 3)}


def test_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, 0), (5, text + " more", 1), (5, "something else that is said", 2)], "doc_id long, text string, node int")
    assert sorted((r.id, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()) == [(1, 1), (5, 1), (5, 5)]
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted((r.doc_id, r.node) for r in left.collect()) == [(1, 0), (5, 2)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 80)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


# -- neighbours -------------------------------------------------------------------------------


def nearest(ids, x, query, k):
    s = x @ x[query]
    order = np.lexsort((ids, -s))
    return [(int(ids[i]), s[i]) for i in order if i != query][:k]


def recall_of(spark, ids, x, kind="float", **options):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>").repartition(3)
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    x = (x if kind == "double" else x.astype(np.float32)).astype(float)
    hit = n = 0
    for at in np.flatnonzero(ids % 20 == 0):
        mine, want = got[ids[at]], nearest(ids, x, at, 20)
        assert sorted(mine) == list(range(1, len(want) + 1))
        assert [mine[r] for r in sorted(mine)] == sorted(mine.values(), key=lambda t: (-t[1], t[0]))
        assert all(abs(s - x[np.flatnonzero(ids == v)[0]] @ x[at]) <= 1e-9 * max(1.0, abs(s)) for v, s in mine.values())
        hit, n = hit + len({v for v, _ in mine.values()} & {v for v, _ in want}), n + len(want)
    return hit / n


def unit_vectors(seed, n):
    x = np.random.default_rng(seed).normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_at_production_values(spark):
    x, rng = unit_vectors(1, 1500), np.random.default_rng(3)
    ids = np.arange(1500)
    assert recall_of(spark, ids, x) >= 0.95
    longer = x.copy()
    longer[7] *= 100
    assert recall_of(spark, ids, longer) >= 0.95
    assert recall_of(spark, ids, x * np.exp(rng.normal(0, 0.5, (1500, 1)))) >= 0.95
    assert recall_of(spark, ids, x * np.exp(rng.normal(0, 2, (1500, 1))), "double") >= 0.95
    assert recall_of(spark, ids, x, block=64) >= 0.95
    assert recall_of(spark, ids[:25], x[:25]) == recall_of(spark, ids[:9], x[:9]) == 1.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_on_the_test_table(spark):
    got = table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    assert recall_of(spark, np.array([r[0] for r in got]), np.array([r[1] for r in got])) >= 0.95


@pytest.mark.parametrize("block", [4096, 16])
def test_neighbour_edges(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6)) * rng.choice([0.1, 1, 5], (60, 1))  # uneven norms
    same = [0.5, -0.0, 1.0, 2.0, 0.0, 0.25]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, same) for i in range(50)]
    bad = [(200, None), (201, [0.0] * 6), (202, [float("nan")] + [1.0] * 5), (203, [float("inf")] + [1.0] * 5), (204, [None] + [1.0] * 5), (205, [1.0] * 3), (None, same), (220, [0.0] * 6), (0, data[0][1])]
    schema = "vec_id long, embedding array<double>, id string, v int, asks string, lot int"  # names that the operator uses itself
    wide = lambda rows: spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], schema)
    df = wide(data + bad).repartition(3)
    ids, full = np.array([i for i, _ in data]), np.array([v for _, v in data])
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0, k=5, block=block).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 100, 120, 140}
    assert [v for v, _ in got[120]] == [v for v, _ in nearest(ids, full, int(np.flatnonzero(ids == 120)[0]), 5)]
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in nearest(ids, full, int(np.flatnonzero(ids == q)[0]), 5)}) for q in got) >= 27
    assert ann.neighbours(wide(data[:3]), F.col("vec_id") == 0).count() == 2
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.neighbours(df, F.col("vec_id") == 10**9).count() == 0


# -- mixing -----------------------------------------------------------------------------------


def test_mixture_meets_its_targets(spark):
    rng = random.Random(8)
    make = {"good": ["lorem", "ipsum", "dolor"], "poor": ["#x#", "&&y", "%z%"], "toxic": ["idiot", "zorgle", "amet"]}
    data = [(i, " ".join(rng.choice(make[d]) for _ in range(rng.randint(20, 60))), d) for i in range(400) for d in [rng.choice(["good"] * 6 + ["poor"] * 2 + ["toxic"])]]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in data] + [(900, None, 1), (901, "", 1), (902, "lorem ipsum " * 20_000, 1)], "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(i, int(d == "good"), int(d == "toxic")) for i, _, d in data if i % 2] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    fitted = mixing.fit_mix(docs, labels, mixing.DOMAIN, weights={"good": 0.6, "poor": 0.3, "toxic": 0.1}, whole_rows=True)
    assert fitted.residual < mixing.RESIDUAL
    assert fitted.model.names == ["good", "poor", "toxic"]
    rated = fitted.rates(fitted.members, "id").collect()
    reached = sum(np.array(r.posterior) * r.tokens * r.rate for r in rated)
    assert np.allclose(reached, fitted.target, rtol=0.01) and np.allclose(reached / reached.sum(), [0.6, 0.3, 0.1], atol=0.01)
    assert all(r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1 and abs(sum(r.posterior) - 1) < 1e-6 for r in rated)
    assert {r.id: r.tokens for r in rated if r.id in (900, 901)} == {900: 0, 901: 0}
    again = fitted.repeated()
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in rated)
    small = mixing.fit_mix(docs, labels, mixing.DOMAIN, weights={"good": 0.9, "toxic": 0.0, "poor": 0.1}, budget=2000.0)
    assert sum(r.rate * r.tokens for r in small.rates(small.members, "id").collect()) == pytest.approx(2000, rel=0.05)


def test_mixture_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fitted = mixing.fit_mix(docs, none, mixing.DOMAIN)
    assert fitted.model.names == ["all"] and {r.copies for r in fitted.rates(fitted.members, "id").collect()} == {1}
    assert mixing.fit_mix(docs.limit(0), none, mixing.DOMAIN).members.count() == 0
    assert mixing.fit_mix(docs, none, mixing.DOMAIN, boost={"good": 2.0}, whole_rows=True).repeated().count() == 2
    twice = spark.createDataFrame([(1, "a b", 5, 1.0), (1, "a b", 5, 1.0), (None, "漢字 x", 6, 2.0)], "doc_id long, text string, tokens int, rate double")
    fitted = mixing.fit_mix(twice, none, mixing.DOMAIN, least=1.0, whole_rows=True)
    rated = fitted.rates(fitted.members, "id").collect()
    assert sorted((r.id or 0, r.tokens, r.copies) for r in rated) == [(0, 4, 1), (1, 2, 1), (1, 2, 1)]
    assert sorted(map(tuple, fitted.repeated().collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_tokens_are_words():
    assert [mixing.tokens_in(t) for t in ("", "  ", "a  b", "a\tb\n\nc", "x" * 999, "é ü")] == [0, 0, 2, 3, 1, 2]


def test_targets_out_of_reach_are_told(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="misses its targets"):
        assert mixing.fit_mix(docs, labels, mixing.DOMAIN, weights={"good": 0.9, "poor": 0.1}).residual > 0.3


# -- BPE --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(9)
    chars = [" ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "﻿", "'s", "'LL", "a", "b", "th", "é", "ß", "漢", "😀", "́", "1", "٣", "²", "!", "$$", "<|endoftext|>", "\x00", "\U0010ffff"]
    return ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_encoding_like_the_library(spark, tiktoken_encoding):
    import public_tokenizers as P

    texts = [*odd_texts(), None, "", "x" * 5000, "the" * 400, "ab " * 30_000, "!" * 3000, " " * 2000 + "x", "word and more " * 20_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    out = bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        text = texts[r.doc_id] or ""
        assert r.ids == tiktoken_encoding.encode_ordinary(text), text[:80]
        assert bytes(r.decoded) == text.encode()
    assert bpe.encode_decode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_words_contract_like_the_library(tiktoken_encoding, monkeypatch):
    import public_tokenizers as P

    ranks = bpe.ranks_of(P.path("byte_bpe_50k.tiktoken"))
    merges, rng = bpe.merges_of(ranks), random.Random(10)
    pick = lambda parts, n: "".join(rng.choice(parts) for _ in range(n))
    words = [pick("abthe", rng.randint(2, 60)) for _ in range(200)] + [pick(["the", "in", "er", "a", "ing"], 300) for _ in range(30)] + [pick("etaoinshr", 700) for _ in range(5)] + ["x" * n for n in range(2, 90)]
    words += ["x" * 100_000, "the" * 20_000, "aaab" * 300, "=" * 70_000, "漢字" * 900]
    for long in (bpe.LONG, 1, 10**9):  # by length, every piece in batches, none
        monkeypatch.setattr(bpe, "LONG", long)
        e = bpe.Encoder(ranks, merges, P.PATTERN)
        some = [w for w in words if len(w) < 9_000 or long < 10**9]
        e.learn(some)
        assert all(np.frombuffer(e.known[w], "<i4").tolist() == tiktoken_encoding.encode_ordinary(w) and e.decoded[w] == w.encode() for w in some)


def test_long_words_fit_in_memory(tiktoken_encoding, tmp_path, monkeypatch):
    import public_tokenizers as P

    monkeypatch.chdir(tmp_path)
    ranks, rng = bpe.ranks_of(P.path("byte_bpe_50k.tiktoken")), random.Random(11)
    e = bpe.Encoder(ranks, bpe.merges_of(ranks), P.PATTERN)
    words = ["".join(rng.choice(["the", "in", "er", "on", "ing", "Q"]) for _ in range(190)) for _ in range(3000)]  # 1.3 MB
    e.learn(words)
    assert all(np.frombuffer(e.known[w], "<i4").tolist() == tiktoken_encoding.encode_ordinary(w) for w in words[::50])
    assert not list(tmp_path.rglob("*"))  # nothing was spilled


# -- the pipeline -----------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark, tiktoken_encoding):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    texts, seen = {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == table(spark, SF, "documents").columns
            docs = corpus_pipeline.written(out, "test")
            seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    a, b, c, d = seen.values()
    assert len(a) >= 0.97 * len(texts)
    best = {}
    for i in a:
        key = re.sub(r"[\x20\x09-\x0D]", "", texts[i])
        best[key] = min(best.get(key, (1, 0)), (-len(texts[i]), i))
    assert sorted(b) == sorted(i for _, i in best.values())
    comp = brute_components([(i, texts[i]) for i in b])
    assert sorted(c) == sorted(i for i in b if comp[i][1] == i)
    assert set(d) == set(c) and len(d) >= len(c)
    last = out.collect()
    assert len(last) == len(d) and all(r.ids == tiktoken_encoding.encode_ordinary(texts[r.doc_id]) for r in last)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_on_odd_tables(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, tokens long, copies int, kept boolean, node string"
    prose = [r.text for r in table(spark, SF, "documents").filter("lang = 'en'").orderBy("doc_id").limit(40).collect()]
    odd = [(None, None), (1, ""), (2, None), (3, "!!! 12"), (4, "x" * 100_000), (5, prose[0] + " " + prose[1]), (5, prose[0] + " " + prose[1]), (5, prose[2] * 30), (None, prose[3])]
    rows = [(i, t, "en" if i else None, None, 7, "a", 1, 2, True, "n") for i, t in [*odd, *enumerate(prose, 100)]]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs.limit(0), docs):
            out = stage(spark, df, SF)
            got = out.collect()
            assert not got if df is not docs else got, name
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        kept[name] = got
    texts = lambda name: [r.text for r in kept[name]]
    assert not {None, "", "!!! 12"} & set(texts("language ID")) and prose[5] in texts("language ID")
    assert sorted(texts("exact dedup"), key=str) == sorted({(r[1] or "") for r in rows} - {""} | {next(t for t in texts("exact dedup") if not t)}, key=str)
    assert {t or "" for t in texts("n-gram Jaccard join")} >= {"", "!!! 12", prose[5]}
    assert {str(tuple(r)) for r in kept["mixing to target weights"]} == {str(r) for r in rows}
    assert len(kept["byte-level BPE"]) == len(rows)


def test_scratch_tables_go(spark):
    from pathlib import Path

    from tessera.llm.common import scratch, shared_dir, written

    here = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "tessera"
    with scratch(spark):
        written(spark.range(3), "probe-inner")
        kept = written(spark.range(4), "probe-kept", keep=True)
        assert list(here.glob("probe-inner-*"))
    assert not list(here.glob("probe-inner-*")) and kept.count() == 4
