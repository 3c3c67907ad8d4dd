import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitgrove.operators import edges as E
from bitgrove.operators import reason as R
from bitgrove.operators import search as S
from test_kernel import M, big, signed, vec


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    rows = [(i, vec(rng, 4)) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)]  # ties
    return rows, spark.createDataFrame(rows, "entity_id bigint, hv array<bigint>").repartition(7)


def brute(rows, query, k):
    return sorted(((big(v) ^ big(query)).bit_count(), i) for i, v in rows)[:k]


def test_search_and_range(spark, corpus):
    rows, df = corpus
    got = [(r["distance"], r["entity_id"]) for r in S.search(df, rows[3][1], 12).collect()]
    assert got == brute(rows, rows[3][1], 12) and got[0] == (0, 3) and got[1] == (0, 1003)
    assert S.search(df, rows[3][1], 12, min_similarity=0.9).count() == 2
    near = {r["entity_id"] for r in S.range_search(df, rows[3][1], 110).collect()}
    assert near == {i for d, i in brute(rows, rows[3][1], 400) if d <= 110}
    for bad in (0, -1):
        with pytest.raises(ValueError):
            S.search(df, rows[0][1], bad)
    with pytest.raises(ValueError):
        S.search(df, rows[0][1], 1, min_similarity=1.5)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_knn_join_both_ways(spark, corpus, monkeypatch, limit):
    rows, df = corpus
    monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(S, "QUERY_BLOCK", 20)
    monkeypatch.setattr(S, "SLAB_ROWS", 50)
    asked = df.where("entity_id < 60").withColumnRenamed("entity_id", "query_id")
    got = {}
    for r in S.knn_join(df, asked, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["entity_id"]))
    assert len(got) == 60
    for i in range(60):
        assert [x[1:] for x in sorted(got[i])] == brute(rows, rows[i][1], 7)


def test_knn_join_of_nothing(spark, corpus):
    _, df = corpus
    none = df.limit(0)
    assert S.knn_join(none, df.withColumnRenamed("entity_id", "query_id"), 3).count() == 0
    assert S.knn_join(df, none.withColumnRenamed("entity_id", "query_id"), 3).count() == 0


def test_a_task_of_knn_join_holds_no_table_of_all_distances(spark, monkeypatch):
    """4,000 queries against a batch of 10,000 codes: a table of their distances takes 160 MB."""
    rng = np.random.default_rng(3)
    codes = rng.integers(-(1 << 63), (1 << 63) - 1, (20_000, 4))
    codes[5000:5050] = codes[15_000:15_050] = codes[0]  # ties, in both batches
    df = spark.createDataFrame([(i, v) for i, v in enumerate(codes[:4000].tolist())], "entity_id bigint, hv array<bigint>")
    taken, own = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, *more: taken.append(fn) or own(self, fn, *more))
    S.knn_join(df, df.withColumnRenamed("entity_id", "query_id"), 7)
    batches = [pa.record_batch([pa.array(range(at, at + 10_000)), pa.array(codes[at : at + 10_000].tolist())], names=["entity_id", "hv"]) for at in (0, 10_000)]
    tracemalloc.start()
    got = [(r["query_id"], r["distance"], r["entity_id"]) for out in taken[0](iter(batches)) for r in out.slice(0, 14).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    rows = list(enumerate(codes.tolist()))
    for q in (0, 1, 256):
        assert [x[1:] for x in got if x[0] == q] == brute(rows, rows[q][1], 7)


def brute_top(rows, asked, k):
    return {(i, e) for i, v in asked for _, e in brute(rows, v, k)}


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_ann_join_finds_neighbours_without_structure(spark, monkeypatch, limit):
    """Random codes lie far apart, so that nearest and next differ by little: the hardest case for a sketch."""
    monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(S, "QUERY_BLOCK", 20)
    monkeypatch.setattr(S, "SLAB_ROWS", 150)
    rng = random.Random(4)
    rows = [(i, vec(rng, 157)) for i in range(400)]
    asked = [(i, v) for i, v in rows if i % 8 == 0]
    df = spark.createDataFrame(rows, "entity_id bigint, hv array<bigint>")
    q = spark.createDataFrame(asked, "query_id bigint, hv array<bigint>")
    got = S.ann_join(df, q, 6).collect()
    want = brute_top(rows, asked, 6)
    assert len(got) == 300 and len({(r["query_id"], r["rank"]) for r in got}) == 300
    assert len(want & {(r["query_id"], r["entity_id"]) for r in got}) >= 0.95 * len(want)
    by_id = dict(rows)
    assert all(r["distance"] == (big(by_id[r["query_id"]]) ^ big(by_id[r["entity_id"]])).bit_count() for r in got)


def test_ann_join_of_few_and_equal_rows(spark):
    rows = [(i, [7, 9]) for i in range(5)]
    df = spark.createDataFrame(rows, "entity_id bigint, hv array<bigint>")
    got = S.ann_join(df, df.withColumnRenamed("entity_id", "query_id"), 3).collect()
    assert {(r["query_id"], r["rank"], r["entity_id"], r["distance"]) for r in got} == {(q, k + 1, k, 0) for q in range(5) for k in range(3)}
    assert S.ann_join(df, df.withColumnRenamed("entity_id", "query_id"), 9).count() == 25
    assert S.ann_join(df.limit(0), df.withColumnRenamed("entity_id", "query_id"), 3).count() == 0


def test_band_join_finds_close_codes(spark):
    rng = random.Random(4)
    rows = [(i, vec(rng, 157)) for i in range(200)]
    asked = [(i, [signed(w & M ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64))) for w in v]) for i, v in rows]  # an eighth of the bits
    df = spark.createDataFrame(rows, "entity_id bigint, hv array<bigint>")
    q = spark.createDataFrame(asked, "query_id bigint, hv array<bigint>")
    far = max((big(v) ^ big(w)).bit_count() for (_, v), (_, w) in zip(rows, asked))
    got = {(r["query_id"], r["entity_id"]): r["distance"] for r in S.band_join(df, q, far).collect()}
    assert len(got) >= 196 and all(a == b for a, b in got)
    assert all(d == (big(rows[a][1]) ^ big(asked[a][1])).bit_count() for (a, _), d in got.items())


def test_band_classes_count_the_links_of_band_join(spark, monkeypatch):
    """A row for each code, copies and all; no plan makes a row for each pair."""
    monkeypatch.setattr(S, "BAND_ROWS", 60)
    rng = random.Random(5)
    flip = lambda v: [signed(w & M ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64))) for w in v]
    rows = [(i, vec(rng, 40)) for i in range(100)]
    for i in range(100, 140):  # walks away from its start, so that classes are chains
        rows.append((i, flip(rows[-1][1] if i % 10 else rows[i - 100][1])))
    rows += [(200 + i, rows[7][1]) for i in range(30)]
    df = spark.createDataFrame([(1000 - i, v) for i, v in rows], "entity_id bigint, hv array<bigint>").repartition(5)
    most = 40 * 64 // 7
    pairs = {(r[0], r[1]) for r in S.band_join(df, df.withColumnRenamed("entity_id", "query_id"), most).select("query_id", "entity_id").collect()}
    want = {(1000 - i, 1000 - j) for i, v in rows for j, w in rows if (big(v) ^ big(w)).bit_count() <= most}
    assert pairs <= want and len(pairs) >= 0.98 * len(want)
    reach = {i: i for i, _ in pairs}
    for _ in range(50):
        for i, j in pairs:
            reach[i] = min(reach[i], reach[j])
    got = S.band_classes(df, most).collect()
    assert {(r["entity_id"], r["n_links"], r["class_id"]) for r in got} == {(i, sum(a == i for a, _ in pairs) - 1, reach[i]) for i in reach}
    assert len(got) == len(rows)


def edges_df(spark, rows):
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "subject_id bigint, relation_id bigint, object_id bigint, seq bigint")


def starts(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "query_id bigint, entity_id bigint")


def test_hop_chain_and_overwrite(spark):
    e = edges_df(spark, [(20, 24, 21), (22, 24, 23), (21, 26, 25), (20, 24, 99), (20, 24, 21)])
    assert [(r["object_id"], r["distance"], r["similarity"]) for r in E.hop(starts(spark, 20), 24, e).collect()] == [(21, 0, 1.0)]
    assert E.hop(starts(spark, 7), 24, e).count() == 0
    assert E.hop(starts(spark, 7), 24, e, keep_misses=True).first()["object_id"] is None
    assert [r["entity_id"] for r in E.chain(starts(spark, 20), [24, 26], e).collect()] == [25]
    assert {r["object_id"] for r in E.multi_hop(starts(spark, 20), 24, e).collect()} == {21, 99}
    broken = E.chain(starts(spark, 20), [24, 99, 26], e, path=True).first()
    assert (broken["hop_1"], broken["hop_2"], broken["hop_3"]) == (21, None, None)
    with pytest.raises(ValueError):
        E.chain(starts(spark, 20), [], e)
    # 20 ^ 24 = 21 ^ 25: one key only if asked for
    pair = edges_df(spark, [(20, 24, 1), (21, 25, 2)])
    assert E.latest_edges(pair).count() == 2 and E.latest_edges(pair, compat_xor_key=True).count() == 1


def test_recursive_chain_and_expansion(spark):
    e = edges_df(spark, [(1, 7, 2), (2, 7, 3), (3, 8, 4), (4, 7, 1)])
    asked = spark.createDataFrame([(1, 1, [7, 7, 8, 7]), (2, 3, [8]), (3, 1, [8])], "query_id bigint, entity_id bigint, relations array<bigint>")
    assert {(r["query_id"], r["entity_id"], r["depth"]) for r in E.chain_recursive(asked, e).collect()} == {(1, 1, 4), (2, 4, 1)}
    seen = {r["entity_id"]: r["depth"] for r in E.expand(starts(spark, 1), e, [7, 8], 4).collect()}
    assert seen == {1: 0, 2: 1, 3: 2, 4: 3}
    assert E.probe(edges_df(spark, [(1, 5, 2), (2, 6, 3), (3, 5, 4), (4, 6, 9), (0, 5, 2)])).first()[:] == (5, 6, 0)
    seeds = E.chain_seeds(edges_df(spark, [(1, 5, 2), (1, 6, 3), (2, 5, 1)])).collect()
    assert len(seeds) == 1 and {seeds[0]["rel1"], seeds[0]["rel2"]} == {5, 6}


def test_recursive_chain_of_many_rows_and_long_lists(spark):
    """A recursive table expression stops at 1,000,000 rows."""
    e = edges_df(spark, [(i, 7, (i + 1) % 5) for i in range(5)])
    many = spark.range(300_000).select(F.col("id").alias("query_id"), (F.col("id") % 5).alias("entity_id"), F.array(*[F.lit(7).cast("bigint")] * 3).alias("relations"))
    got = E.chain_recursive(many, e)
    assert got.where((F.col("entity_id") == (F.col("query_id") + 3) % 5) & (F.col("depth") == 3)).count() == got.count() == 300_000
    lists = spark.createDataFrame([(1, 0, [7] * 20), (1, 0, [7] * 20), (2, 3, []), (3, 0, [7, 8]), (4, 0, None), (5, 1, [7, None]), (6, 9, [7])], "query_id bigint, entity_id bigint, relations array<bigint>")
    got = sorted(tuple(r) for r in E.chain_recursive(lists, e).select("query_id", "entity_id", "depth").collect())
    assert got == [(1, 0, 20), (1, 0, 20), (2, 3, 0)]


def test_analogy_is_exact_on_symbols(spark):
    rng = random.Random(6)
    france, england, europe, capital = (vec(rng, 157) for _ in range(4))
    paris, london = ([a ^ capital[i] for i, a in enumerate(x)] for x in (france, england))
    ents = spark.createDataFrame([(20, france), (21, england), (22, europe), (23, capital), (24, paris), (25, london)], "entity_id bigint, hv array<bigint>")
    asked = spark.createDataFrame([(0, 25, 21, 20)], "query_id bigint, a bigint, b bigint, c bigint")
    first = R.analogy(asked, ents, ents, 5).where("rank = 1").first()
    assert (first["entity_id"], first["distance"], first["similarity"]) == (24, 0, 1.0)
    assert R.analogy(asked.withColumn("a", F.lit(999).cast("bigint")), ents, ents, 5).count() == 0
    r = spark.createDataFrame([(0, 23, 20)], "query_id bigint, relation bigint, object bigint")
    assert R.relation_decode(r, ents, ents, 1).first()["entity_id"] == 24
    m = spark.createDataFrame([(0, 20), (0, 20), (0, 21)], "query_id bigint, entity_id bigint")
    assert R.set_query(m, ents, ents, 1).first()["entity_id"] == 20


def test_approximate_hop_decodes_and_flags(spark):
    rng = random.Random(8)
    ents = spark.createDataFrame([(i, vec(rng, 157)) for i in (20, 21, 24, 30)], "entity_id bigint, hv array<bigint>")
    e = edges_df(spark, [(20, 24, 21)])
    stored = E.edge_vectors(e, ents).select(F.col("composite_id").alias("entity_id"), "hv")
    asked = spark.createDataFrame([(0, 20, 24), (1, 30, 24)], "query_id bigint, subject bigint, relation bigint")
    got = R.typed_relation(asked, e, ents, ents.unionAll(stored), 2).collect()
    assert [(r["object_id"], r["rank"]) for r in got if r["exact"]] == [(21, 1)]
    assert len([r for r in got if not r["exact"]]) == 2 and all(r["query_id"] == 1 for r in got if not r["exact"])
    # with no lookup the stored edge vector is found and decodes to the object
    found = R.typed_relation(asked.where("query_id = 0"), e.limit(0), ents, ents.unionAll(stored), 1).first()
    assert (found["object_id"], found["distance"], found["decoded_exists"]) == (21, 0, True)
    walk = R.chain_approx(starts(spark, 20), [24, 24], e, ents, ents.unionAll(stored), 2)
    assert walk.count() == 2


def test_referential_check(spark):
    live = spark.createDataFrame([(1,), (2,), (3,)], "entity_id bigint")
    e = edges_df(spark, [(1, 2, 3), (9, 2, 3), (1, 9, 3), (1, 2, 9), (9, 9, 9)])
    valid, rejected = E.referential_check(e, live)
    assert valid.count() == 1 and E.valid_edges(e, live).count() == 1
    assert sorted(r["missing"] for r in rejected.collect()) == ["object", "relation", "subject", "subject"]
