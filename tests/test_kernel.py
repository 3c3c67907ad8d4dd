import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitgrove.functions import kernel as K
from bitgrove.functions import text as X
from bitgrove.functions import vectors as V
from bitgrove.operators import bundle as B

M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def vec(rng, words):
    return [signed(rng.getrandbits(64)) for _ in range(words)]


def big(v):
    """The bit string with word 0 most significant."""
    out = 0
    for w in v:
        out = out << 64 | w & M
    return out


def small(n, words):
    return [signed(n >> 64 * (words - 1 - i) & M) for i in range(words)]


@pytest.mark.parametrize("words", [4, 157])
def test_bind_hamming_permute_against_integers(spark, words):
    rng = random.Random(words)
    rows = [(i, vec(rng, words), vec(rng, words)) for i in range(6)] + [(6, [-1] * words, [0] * words), (7, [-1] + [0] * (words - 1), [5] * words)]
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>")
    shifts = [0, 1, 2, 3, 63, 64, 65, words * 64, words * 64 + 1, 200]
    got = df.select("i", K.bind("a", "b").alias("bind"), K.hamming("a", "b").alias("h"), K.hamming("a", "a").alias("self"), K.bind(K.bind("a", "b"), "b").alias("back"), *(K.permute("a", n).alias(f"p{n}") for n in shifts)).collect()
    size = words * 64
    for r in got:
        _, a, b = rows[r["i"]]
        assert r["bind"] == small(big(a) ^ big(b), words) and r["back"] == a
        assert r["h"] == (big(a) ^ big(b)).bit_count() and r["self"] == 0
        for n in shifts:
            k = n % size
            assert r[f"p{n}"] == small((big(a) << k | big(a) >> size - k) & (1 << size) - 1, words), n


def test_scalars(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("x")).first()["x"]
    assert [v(K.similarity(F.lit(d))) for d in (0, 10048, 5024)] == [1.0, 0.0, 0.5]
    assert v(K.sim_to_dist(F.lit(0.9))) == 1004
    assert v(K.entity_id(F.lit("Paris"))) == 6760592112134567798
    for name in ("Paris", "Zürich", "", "日本"):
        want = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") & (1 << 63) - 1
        assert v(K.entity_id(F.lit(name))) == want
    assert v(K.relation_id(F.lit("capitalOf"))) == v(K.entity_id(F.lit("REL:capitalOf")))
    assert [v(K.severity(F.lit(s))) for s in (0.59, 0.60, 0.75, 0.90)] == [None, "INFO", "WARNING", "CRITICAL"]
    arr = lambda *x: F.array(*map(F.lit, x))
    assert v(K.clamped_dot(arr(1.0, 2.0), arr(-1.0, 0.0, 9.0))) == 0.0
    assert v(K.dot(arr(1.0, 2.0), arr(3.0, 4.0, 9.0))) == 11.0
    assert v(K.l2_normalise(arr(3.0, 4.0))) == [0.6, 0.8] and v(K.l2_normalise(arr(0.0, 0.0))) == [0.0, 0.0]
    assert v(K.set_word(arr(1, 2, 3), 1, 9)) == [1, 9, 3] and v(K.get_word(arr(1, 2, 3), 2)) == 3
    assert v(K.approx_hamming(F.lit(0.5))) == 2512


def test_typed_edge_vector_ignores_the_object_and_flat_edge_can_vanish(spark):
    rng = random.Random(1)
    france, capital = vec(rng, 4), vec(rng, 4)
    paris = [a ^ b for a, b in zip(france, capital)]
    df = spark.createDataFrame([(paris, capital, france)], "p array<bigint>, r array<bigint>, f array<bigint>")
    row = df.select(K.flat_edge_vector("p", "r", "f").alias("flat"), K.typed_edge_vector("p", "r").alias("typed"), K.role_edge_vector("p", "r", "f").alias("roles")).first()
    assert row["flat"] == [0] * 4
    assert row["roles"] == small(big(row["typed"]) ^ ((big(france) << 3 | big(france) >> 253) & (1 << 256) - 1), 4)


def test_codecs_and_mix(spark):
    df = spark.createDataFrame([([1, -2, 3],), (None,)], "w array<bigint>")
    assert [r["x"] for r in df.select(V.binary_to_words(V.words_to_binary("w")).alias("x")).collect()] == [[1, -2, 3], None]
    f = spark.createDataFrame([([1.5, -2.25],)], "f array<float>").select(V.floats_to_bytes("f").alias("b"))
    assert f.first()["b"] == np.array([1.5, -2.25], "<f4").tobytes()
    with pytest.raises(Exception, match="multiple of 4"):
        spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(V.bytes_to_floats("b")).collect()

    def mix(z):
        z ^= z >> 33
        z = z * 0xFF51AFD7ED558CCD & M
        z ^= z >> 33
        z = z * 0xC4CEB9FE1A85EC53 & M
        return signed(z ^ z >> 33)

    xs = [0, 1, -1, 2**62, -(2**63)]
    assert V.mix64(np.array(xs)).tolist() == [mix(x & M) for x in xs]


def test_encoding_agrees_with_the_angle(spark):
    rng = np.random.default_rng(0)
    config = V.ProjectionConfig(dims=32)
    a, b = rng.standard_normal(32), rng.standard_normal(32)
    b = a + 0.7 * b
    df = spark.createDataFrame([(0, a.tolist()), (1, b.tolist()), (2, [0.0] * 32)], "i int, embedding array<double>")
    rows = [r["hv"] for r in V.encode(df, config).orderBy("i").collect()]
    agree = 1 - (big(rows[0]) ^ big(rows[1])).bit_count() / 10048
    angle = np.arccos(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert abs(agree - (1 - angle / np.pi)) < 0.02
    assert rows[2] == [0] * 157
    raw = V.encode(df, config, binary=True).orderBy("i").first()["hv"]
    assert len(raw) == 1256 and np.frombuffer(raw, "<i8").tolist() == rows[0]
    with pytest.raises(Exception, match="dimensions"):
        V.encode(spark.createDataFrame([([1.0],)], "embedding array<double>"), config).collect()
    with pytest.raises(ValueError):
        V.ProjectionConfig(dims=0)


def test_bundles_of_one_two_three_and_repeats(spark):
    rng = random.Random(2)
    a, b, c = (vec(rng, 4) for _ in range(3))
    groups = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, a, b], 5: [a, b, c, vec(rng, 4), vec(rng, 4)]}
    df = spark.createDataFrame([(k, v) for k, own in groups.items() for v in own], "label int, hv array<bigint>")
    for made in (B.bundle(df, "label"), B.bundle_expr(df, "label")):
        got = {r["label"]: (r["n"], r["hv"]) for r in made.collect()}
        for k, own in groups.items():
            want = B.bundle_local([np.array(v) for v in own]).tolist()
            assert got[k] == (len(own), want)
    assert got[1][1] == a and got[2][1] == [x & y for x, y in zip(a, b)] and got[4][1] == a
    with pytest.raises(ValueError):
        B.bundle_local([])


def test_mean_pool_with_mask(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 1), (1, [99.0, 99.0], 0)], "k int, v array<double>, m int")
    assert B.mean_pool(df, "k", "v", "m").first()["mean"] == [2.0, 3.0]


def test_text(spark):
    vocab = {"hello": 1000, "world": 1001, ",": 1002, "play": 1003, "##ing": 1004}
    assert X.normalise_text("Hello, World\0\n") == "hello ,  world"
    assert X.word_pieces("playing", vocab) == [1003, 1004] and X.word_pieces("zzz", vocab) == [100] and X.word_pieces("playzzz", vocab) == [100]
    df = spark.createDataFrame([("Hello, World",), ("hello " * 300,), (None,)], "t string")
    rows = [r["x"] for r in df.select(X.tokenize(vocab, spark)(F.col("t")).alias("x")).collect()]
    assert rows[0]["input_ids"][:6] == [101, 1000, 1002, 1001, 102, 0] and len(rows[0]["input_ids"]) == 128
    assert rows[1]["input_ids"][126:] == [1000, 102] and sum(rows[1]["attention_mask"]) == 128
    assert rows[2]["input_ids"][:3] == [101, 102, 0]
    e = [r["v"] for r in df.select(X.hashing_encoder(16)(F.col("t")).alias("v")).collect()]
    assert abs(sum(x * x for x in e[0]) - 1) < 1e-5 and e[2] == [0.0] * 16
    same = spark.createDataFrame([("A-b\t c",)], "t string").select(X.normalise_ascii(F.col("t")).alias("x")).first()["x"]
    assert same == X.normalise_text("A-b\t c")


def test_sql_functions(spark):
    names = K.register(spark)
    assert "hv_hamming" in names
    row = spark.sql("SELECT hv_hamming(array(1L, 3L), array(0L, 0L)) AS h, hv_permute(array(1L, -9223372036854775808L)) AS p, hv_sim_to_dist(0.9D) AS d, hv_similarity(5024) AS s, hv_bind(array(1L), array(3L)) AS b").first()
    assert (row["h"], row["p"], row["d"], row["s"], row["b"]) == (3, [3, 0], 1004, 0.5, [2])


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text("[PAD]\n\nhello\n##lo\n")
    assert X.load_vocab(spark, str(tmp_path / "v.txt")) == {"[PAD]": 0, "hello": 2, "##lo": 3}
