"""Hypervector algebra and scalar helpers as column expressions.

A hypervector is array<bigint>: word w holds bits 64w .. 64w+63, lowest bit first. The width is whatever the
arrays have (157 words by default elsewhere). All expressions stay in the JVM; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORDS = 157
WORD_BITS = 64
TOTAL_BITS = WORDS * WORD_BITS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _shl(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x, n if isinstance(n, Column) else F.lit(n))


def _shr(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", x, n if isinstance(n, Column) else F.lit(n))


def bind(a: Column | str, b: Column | str) -> Column:
    """Elementwise XOR; its own inverse."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x.bitwiseXOR(y))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits, as bigint. Null if either is null or the widths differ."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("bigint"), lambda s, x: s + x)


def permute(v: Column | str, n: int = 1) -> Column:
    """Cyclic left shift by n bits of the whole string, word 0 most significant. n >= 0; a multiple of the width is the identity."""
    if n < 0:
        raise ValueError("n must not be negative")
    v = _col(v)
    words, bits = divmod(n, WORD_BITS)
    if words:
        k = F.lit(words) % F.size(v)
        v = F.when(k == 0, v).otherwise(F.concat(F.slice(v, k + 1, F.size(v) - k), F.slice(v, F.lit(1), k)))
    if bits:
        source = v
        v = F.transform(source, lambda x, i: _shl(x, bits).bitwiseOR(_shr(F.element_at(source, (i + 1) % F.size(source) + 1), WORD_BITS - bits)))
    return v


def similarity(distance: Column | str, bits: int = TOTAL_BITS) -> Column:
    return F.lit(1.0) - _col(distance) / F.lit(float(bits))


def sim_to_dist(sim: Column | str, bits: int = TOTAL_BITS) -> Column:
    """Largest distance of a similarity, truncated."""
    return ((F.lit(1.0) - _col(sim)) * F.lit(float(bits))).cast("bigint")


def get_word(v: Column | str, i: int) -> Column:
    """Word i, counted from 0; an error beyond the end."""
    return F.element_at(_col(v), i + 1)


def set_word(v: Column | str, i: int, value: Column | int) -> Column:
    value = value if isinstance(value, Column) else F.lit(value).cast("bigint")
    return F.transform(_col(v), lambda x, k: F.when(k == i, value).otherwise(x))


def typed_edge_vector(subject: Column | str, relation: Column | str) -> Column:
    """The stored form of a typed edge: subject shifted by 1, relation by 2; the object has no part in it."""
    return bind(permute(subject, 1), permute(relation, 2))


def role_edge_vector(subject: Column | str, relation: Column | str, object_: Column | str) -> Column:
    """The three-role form: the object, shifted by 3, is bound as well."""
    return bind(typed_edge_vector(subject, relation), permute(object_, 3))


def flat_edge_vector(subject: Column | str, relation: Column | str, object_: Column | str) -> Column:
    return bind(bind(subject, relation), object_)


def composite_id(s: Column | str, r: Column | str, o: Column | str) -> Column:
    return _col(s).bitwiseXOR(_col(r)).bitwiseXOR(_col(o))


decode_id = composite_id  # hit ^ subject ^ relation gives the object back


def entity_id(name: Column | str) -> Column:
    """First 8 bytes of SHA-256 of the name, sign bit cleared."""
    return F.conv(F.substring(F.sha2(_col(name).cast("binary"), 256), 1, 16), 16, -10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def relation_id(name: Column | str) -> Column:
    return entity_id(F.concat(F.lit("REL:"), _col(name)))


def symbol_vector(key: Column | str, words: int = WORDS) -> Column:
    """A vector for any key: word j is the first 8 bytes of SHA-256 of 'key:j'."""
    key = _col(key).cast("string")
    word = lambda j: F.conv(F.substring(F.sha2(F.concat(key, F.lit(":"), j.cast("string")).cast("binary"), 256), 1, 16), 16, -10).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)


def dot(a: Column | str, b: Column | str) -> Column:
    """Over the dimensions that both have, in double precision."""
    a, b = _col(a), _col(b)
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def clamped_dot(a: Column | str, b: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))


def approx_hamming(sim: Column | str) -> Column:
    return ((F.lit(1.0) - _col(sim)) * F.lit(TOTAL_BITS / 2)).cast("int")


def l2_normalise(v: Column | str) -> Column:
    """Divided by the norm where that is above 1e-12."""
    v = _col(v)
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 1e-12, x.cast("double") / n).otherwise(x.cast("double")))), 1)


def severity(sim: Column | str, info: Column | float = 0.60, warning: Column | float = 0.75, critical: Column | float = 0.90) -> Column:
    """CRITICAL, WARNING, INFO from the highest threshold that is reached, else null."""
    sim = _col(sim)
    return F.when(sim >= critical, "CRITICAL").when(sim >= warning, "WARNING").when(sim >= info, "INFO")


# SQL functions with the same meaning; bodies are SQL, so Catalyst inlines them.
SQL_FUNCTIONS = {
    "hv_bind": "(a array<bigint>, b array<bigint>) RETURNS array<bigint> RETURN zip_with(a, b, (x, y) -> x ^ y)",
    "hv_hamming": "(a array<bigint>, b array<bigint>) RETURNS bigint RETURN aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0L, (s, x) -> s + x)",
    "hv_permute": "(v array<bigint>) RETURNS array<bigint> RETURN transform(v, (x, i) -> shiftleft(x, 1) | shiftrightunsigned(element_at(v, (i + 1) % size(v) + 1), 63))",
    "hv_similarity": f"(d bigint) RETURNS double RETURN 1.0D - d / {float(TOTAL_BITS)}D",
    "hv_sim_to_dist": f"(s double) RETURNS bigint RETURN cast((1.0D - s) * {float(TOTAL_BITS)}D as bigint)",
    "hv_entity_id": "(name string) RETURNS bigint RETURN cast(conv(substr(sha2(name, 256), 1, 16), 16, -10) as bigint) & 9223372036854775807",
}


def register(spark: SparkSession) -> list[str]:
    """Registers SQL_FUNCTIONS in the session and gives their names."""
    for name, rest in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
    return list(SQL_FUNCTIONS)
