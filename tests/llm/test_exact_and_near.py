"""Exact dedup, SimHash, embeddings and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bitgrove.llm import base, embedding_dedup, exact_dedup, simhash
from bitgrove.llm.components import components, forest

SF = "/root/testdata/sf0.001"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# ---- components
def test_forest():
    rng = random.Random(0)
    for _ in range(50):
        n = rng.randint(1, 40)
        a = np.array([rng.randrange(n) for _ in range(rng.randint(0, 60))], np.int64)
        b = np.array([rng.randrange(n) for _ in a], np.int64)
        u = Union(range(n))
        for x, y in zip(a.tolist(), b.tolist()):
            u.join(x, y)
        member, low = forest(a, b)
        assert dict(zip(member.tolist(), low.tolist())) == {x: u.find(x) for x in set(a.tolist()) | set(b.tolist()) if u.find(x) != x}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none", "loops"])
def test_components(spark, kind):
    rng = random.Random(1)
    links = {"path": [(i + 1, i) for i in range(300)], "star": [(7, i) for i in range(400)], "random": [(rng.randrange(500), rng.randrange(500)) for _ in range(350)], "none": [], "loops": [(3, 3)]}[kind]
    rng.shuffle(links)
    u = Union({x for pair in links for x in pair})
    for a, b in links:
        u.join(a, b)
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {x: u.find(x) for x in u.up if u.find(x) != x}


def test_spread_meets_every_pair_once(spark):
    rows = [(k, i) for k, n in ((1, 700), (2, 3), (3, 90)) for i in range(k * 10_000, k * 10_000 + n)]
    cells = base.spread(spark.createDataFrame(rows, "key long, ident long"), "key", "ident", 64).collect()
    by_cell = {}
    for r in cells:
        by_cell.setdefault(r["cell"], []).append((r["chunk"], r["ident"]))
    seen = {}
    for own in by_cell.values():
        chunks = {c for c, _ in own}
        assert len(own) < 64 * 4
        for i, (c, x) in enumerate(own):
            for d, y in own[:i]:
                if len(chunks) == 1 or c != d:
                    seen[frozenset((x, y))] = seen.get(frozenset((x, y)), 0) + 1
    want = {frozenset((a, b)) for k, a in rows for j, b in rows if k == j and a < b}
    assert set(seen) == want and set(seen.values()) == {1}


# ---- exact
def test_exact_duplicates_against_brute_force(spark):
    long = "x" * 70_000
    texts = ["a", "A", "b", None, "", "É", "é", "AÉ", "aÉ", long, long, long + "y", "same prefix " * 30 + "1", "same prefix " * 30 + "2", "same prefix " * 30 + "1", "a"]
    rows = [(i * 7 % 101, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "b", "", 0), (None, "alone", "", 0), (5, "twice", "", 0), (5, "twice", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, kept int").repartition(5)
    got = sorted(map(repr, exact_dedup.exact_duplicates(df, hash_all=True).collect()))
    want = []
    for i, t, *_ in rows:
        own = [j for j, s, *_ in rows if lower(s) == lower(t)]
        keep = max((j for j in own if j is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    made = exact_dedup.exact_duplicates(df, hash_all=True).collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, want)) and len(got) == len(rows)
    # rows that are settled by length or prefix are not hashed
    assert any(r["digest"] is None for r in exact_dedup.exact_duplicates(df).collect())
    kept = exact_dedup.dedup_exact(df.where("doc_id is not null and doc_id <> 5"))
    assert kept.columns == df.columns
    assert sorted(lower(r["text"]) for r in kept.collect()) == sorted({lower(t) for i, t, *_ in rows if i not in (None, 5)})
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


# ---- SimHash
def plain_fingerprint(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    runs = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    u = Union(fps)
    own = list(fps.items())
    for k, (i, f) in enumerate(own):
        for j, g in own[:k]:
            if (f ^ g).bit_count() <= 3:
                u.join(i, j)
    return {i: (f"{f:016x}", u.find(i)) for i, f in fps.items()}


def test_simhash_against_brute_force(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "Gamma", "δelta", "eps,", "zeta x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 4, 30])))) for i in range(150)]
    base_text = [f"w{rng.randrange(50)}" for _ in range(400)]
    for i in range(200, 260):
        copy = list(base_text)
        copy[rng.randrange(400)] = f"q{rng.randrange(9)}"
        rows.append((i, " ".join(copy)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "A B"), (304, "a b"), (305, "long " * 20_000)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fp string, node int").repartition(4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_duplicates(df).collect()}
    assert got == plain_classes(rows)
    assert simhash.simhash_duplicates(df.limit(0)).count() == 0
    twice = simhash.simhash_duplicates(df.where("doc_id = 303").unionAll(df.where("doc_id = 303"))).collect()
    assert [r["component_id"] for r in twice] == [303, 303]


def test_simhash_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op4_simhash_near_dedup(spark, SF).collect()}
    assert got == plain_classes(rows)


@pytest.mark.parametrize(("words", "radius"), [(1, 3), (1, 0), (1, 7), (4, 48)])
def test_bit_sliced_pairs(words, radius):
    rng = np.random.default_rng(words * 100 + radius)
    seeds = rng.integers(0, 2**63, (40, words), dtype=np.uint64)
    fps = seeds[rng.integers(0, 40, 900)].copy()
    for row in fps:
        for _ in range(rng.integers(0, 3 if words == 1 else 30)):
            row[rng.integers(words)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    sizes = [1, 2, 5, 40, 47, 48, 49, 100, 300, 1, 1]
    sizes.append(900 - sum(sizes))
    starts = np.cumsum([0, *sizes[:-1]])
    i, j = simhash.near_pairs(fps, starts, radius)
    got = set(zip(i.tolist(), j.tolist()))
    want = set()
    for s, n in zip(starts, sizes):
        d = np.bitwise_count(fps[s : s + n, None] ^ fps[None, s : s + n]).sum(2)
        a, b = np.nonzero(np.triu(d <= radius, 1))
        want |= set(zip((a + s).tolist(), (b + s).tolist()))
    assert got == want and len(i) == len(got)


def test_hot_buckets_give_the_same_classes(spark, monkeypatch):
    rng = random.Random(2)
    center = rng.getrandbits(64)
    fps = {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(900)} | {rng.getrandbits(64) for _ in range(50)}
    rows = [(k, bytearray(int(f).to_bytes(8, "little"))) for k, f in enumerate(sorted(fps))]
    monkeypatch.setattr(simhash, "CELL_ROWS", 40)
    df = spark.createDataFrame(rows, "doc_id long, fp binary")
    u = Union(k for k, _ in rows)
    own = sorted(fps)
    for a in range(len(own)):
        for b in range(a):
            if (own[a] ^ own[b]).bit_count() <= 3:
                u.join(a, b)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_classes(df, "doc_id", 3).collect()}
    assert got == {k: u.find(k) for k, _ in rows}


def test_pigeonhole_keys_cover_and_sampled_keys_reach_their_recall():
    for blocks in (4, 5, 6):
        keys = simhash.pigeonhole_keys(64, 3, blocks)
        rng = random.Random(blocks)
        for _ in range(300):
            flips = set(rng.sample(range(64), 3))
            assert any(not flips & set(k) for k in keys)
    rng = np.random.default_rng(0)
    keys = simhash.sampled_keys(256, 14, 0.151, 0.95)
    met = np.mean([any(not flips[k].any() for k in keys) for flips in rng.random((400, 256)) < 0.151])
    assert met > 0.93


def test_near_dedup_keeps_one_of_each_group_and_leaves_others(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, groups = [], []
    for g in range(25):
        text = [word() for _ in range(300)]
        own = []
        for c in range(4):
            copy = list(text)
            for _ in range(2 if c else 0):  # each changes five of 296 runs at most
                copy[rng.randrange(300)] = word()
            own.append(len(rows))
            rows.append((len(rows), " ".join(copy), "s", len(rows)))
        groups.append(own)
    shared = " ".join(word() for _ in range(60))
    for _ in range(60):  # a passage in common isn't a copy
        rows.append((len(rows), f"{' '.join(word() for _ in range(100))} {shared}", "s", 0))
    rows += [(len(rows), None, "s", 0), (len(rows) + 1, "", "s", 0), (None, "x", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, a long")
    kept = simhash.dedup_near(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert all(len(ids & set(g)) == 1 for g in groups)
    assert set(range(100, 160)) <= ids and None in ids and len(ids & {160, 161}) == 1


def test_near_dedup_finds_copies_among_many_texts_of_one_template(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(300)]
    rows = []
    for _ in range(200):  # two copies share two changes and have three of their own; most others are below 0.8
        mine = list(base)
        for at in rng.sample(range(300), 2):
            mine[at] = word()
        for _ in range(2):
            copy = list(mine)
            for at in rng.sample(range(300), 3):
                copy[at] = word()
            rows.append((len(rows), " ".join(copy)))
    sets = [set(simhash.shingle_hashes(t, 5, True).tolist()) for _, t in rows]
    fps = [simhash.fingerprint(simhash.shingle_hashes(t, 5, True), 256) for _, t in rows]
    u = Union(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and np.bitwise_count(fps[a] ^ fps[b]).sum() <= simhash.NEAR_RADIUS:
                u.join(a, b)
    best = len({u.find(k) for k in range(len(rows))})
    assert len(rows) - best >= 150
    kept = {r["doc_id"] for r in simhash.dedup_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {u.find(k) for k in kept} == {u.find(k) for k in range(len(rows))}
    assert len(kept) - best <= 0.08 * (len(rows) - best)  # the sampled keys miss a few, nothing else does


def test_near_dedup_finds_pairs_just_above_the_similarity(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for _ in range(300):
        text = [word() for _ in range(300)]
        copy = list(text)
        for at in (1, *(40 * k + rng.randrange(20, 50) // 10 * 3 for k in range(1, 7))):  # 2 + 6 * 5 of 296 runs
            copy[at] = word()
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(copy))]
    sets = [set(simhash.shingle_hashes(t, 5, True).tolist()) for _, t in rows]
    assert all(0.8 <= len(a & b) / len(a | b) <= 0.81 for a, b in zip(sets[::2], sets[1::2]))
    kept = simhash.dedup_near(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert 300 <= kept <= 306


# ---- embeddings
def plain_embeddings(rows, cosine=0.9):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    u, n = Union(i for i, _ in rows), dict.fromkeys((i for i, _ in rows), 0)
    own = list(unit)
    for k, a in enumerate(own):
        for b in own[:k]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                u.join(a, b)
                n[a] += 1
                n[b] += 1
    return {i: (n[i], u.find(i), u.find(i) == i) for i, _ in rows}


def test_embeddings_small_and_odd(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 16)))]
    rows += [(100 + k, (np.array(rows[k][1]) * 3 + 0.05 * rng.standard_normal(16)).tolist()) for k in range(20)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] + [1.0] * 15), (304, []), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [float("inf")] * 16), (308, [1e-300] * 16), (309, [1e300] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    want = plain_embeddings([(i, v) for i, v in rows if i < 308])
    assert {i: got[i] for i in want} == want
    assert got[308] == (1, 308, True) and got[309] == (1, 308, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_hot_group_and_recall_at_the_limit(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 128)
    monkeypatch.setattr(embedding_dedup, "SPREAD", 100)
    rng = np.random.default_rng(3)
    a = rng.standard_normal((500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((500, 32))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = np.concatenate([a, 0.9001 * a + np.sqrt(1 - 0.9001**2) * b])
    hot = a[0] + 0.01 * rng.standard_normal((300, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([pairs, hot]))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = plain_embeddings(rows)
    found, wanted = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert 0.97 <= found / wanted <= 1 and all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i][0] > 0 for i in range(1, 500)]) >= 0.93
    assert len({got[i][1] for i in range(1000, 1300)}) == 1


def test_embedding_query(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.op8_embedding_near_dedup(spark, SF).collect()}
    assert got == plain_embeddings(rows)
    assert embedding_dedup.threshold(0.9, 24, 0.6, 0.985) == 15
    assert spark.range(1).select(F.lit(1)).count() == 1


@pytest.mark.parametrize("bits", [1 << 20, 1 << 23])
def test_bitmaps_hold_their_keys_at_every_size(spark, bits):
    keys = spark.range(20_000).select(F.col("id").alias("k"))
    found = spark.range(40_000).where(exact_dedup.in_bitmap(exact_dedup.keys_bitmap(keys, "k", bits=bits), F.col("id"), bits=bits))
    ids = {r["id"] for r in found.collect()}
    assert set(range(20_000)) <= ids and len(ids) - 20_000 < 40_000 * 20_000 / bits
    assert exact_dedup.bits_for(0) == 1 << 20 and exact_dedup.bits_for(1 << 20) == 1 << 23 and exact_dedup.bits_for(10**12) == exact_dedup.MOST_BITS
