"""DuckDB expressions for the kernel, used by the oracle queries. Vectors are lists of UBIGINT there."""

from __future__ import annotations

N = 4


def u64(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 16))::UBIGINT"


def eid(text: str) -> str:
    return f"({u64(text)} & 9223372036854775807::UBIGINT)::BIGINT"


def named(prefix: str, key: str) -> str:
    return eid(f"'{prefix}:' || {key}::VARCHAR")


def rid(name: str) -> str:
    return eid(f"'REL:{name}'")


def symbol(text: str, n: int = N) -> str:
    return f"[{u64(f'{text} || chr(58) || j::VARCHAR')} for j in range({n})]"


def bind(a: str, b: str, n: int = N) -> str:
    return f"[xor(({a})[i], ({b})[i]) for i in range(1, {n + 1})]"


def hamming(a: str, b: str, n: int = N) -> str:
    return f"list_sum([bit_count(xor(({a})[i], ({b})[i]))::BIGINT for i in range(1, {n + 1})])::BIGINT"


def permute(v: str, k: int, n: int = N) -> str:
    words, bits = divmod(k, 64)
    at = lambda i: f"({v})[({i} - 1 + {words}) % {n} + 1]"
    if not bits:
        return f"[{at('i')} for i in range(1, {n + 1})]"
    return f"[(({at('i')} & {2 ** (64 - bits) - 1}::UBIGINT) << {bits}) | ({at('(i + 1)')} >> {64 - bits}) for i in range(1, {n + 1})]"


def signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808::UBIGINT THEN ({x}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {x}::BIGINT END)"


def joined(v: str) -> str:
    return f"array_to_string([{signed('x')}::VARCHAR for x in {v}], ',')"


#: codes(entity_id, hv, label): 256-bit codes of the embeddings by the sign matrix.
CODES = f"""
m AS (SELECT i, list(CASE WHEN (a * b % 10007) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS row FROM (
        SELECT i, d, (i * 7919 + d * 104729 + i * d * 31 + 17) % 10007 AS a, (i * 611 + d * 53 + 29) % 10007 AS b
        FROM range({N * 64}) t(i), range(64) s(d)) GROUP BY i),
bits AS (SELECT vec_id, label, i // 64 AS w, bit_or(CASE WHEN list_dot_product(embedding::DOUBLE[], row) > 0 THEN 1::UBIGINT << (i % 64)::INTEGER ELSE 0::UBIGINT END) AS x
         FROM embeddings, m GROUP BY vec_id, label, i // 64),
codes AS (SELECT vec_id AS entity_id, label, list(x ORDER BY w) AS hv FROM bits GROUP BY vec_id, label)
"""

#: caps(entity_id, hv): nations, capitals and the relation.
CAPS = f"""
caps AS (
  SELECT n_nationkey::BIGINT AS entity_id, {symbol("'nation:' || n_nationkey::VARCHAR")} AS hv FROM nation
  UNION ALL SELECT n_nationkey::BIGINT + 100, {bind(symbol("'nation:' || n_nationkey::VARCHAR"), symbol("'REL:capitalOf'"))} FROM nation
  UNION ALL SELECT 1000::BIGINT, {symbol("'REL:capitalOf'")})
"""

#: edges(subject_id, relation_id, object_id, seq)
EDGES = f"""
edges AS (
  SELECT {named("order", "o_orderkey")} AS subject_id, {rid("placed_by")} AS relation_id, {named("customer", "o_custkey")} AS object_id, o_orderkey::BIGINT AS seq FROM orders
  UNION ALL SELECT {named("customer", "c_custkey")}, {rid("in_nation")}, {named("nation", "c_nationkey")}, c_custkey FROM customer
  UNION ALL SELECT {named("supplier", "s_suppkey")}, {rid("in_nation")}, {named("nation", "s_nationkey")}, s_suppkey FROM supplier
  UNION ALL SELECT {named("nation", "n_nationkey")}, {rid("in_region")}, {named("region", "n_regionkey")}, n_nationkey FROM nation)
"""

#: votes(label, n, hv): the bundled codes of each label.
VOTES = f"""
ones AS (SELECT label, b, count(*) AS n, sum(((hv[(b // 64 + 1)::INTEGER] >> (b % 64)::INTEGER) & 1::UBIGINT)::INTEGER) AS t FROM codes, range({N * 64}) r(b) GROUP BY label, b),
votes AS (SELECT label, n, list(x ORDER BY w) AS hv FROM (
  SELECT label, n, b // 64 AS w, bit_or(CASE WHEN t > n // 2 THEN 1::UBIGINT << (b % 64)::INTEGER ELSE 0::UBIGINT END) AS x FROM ones GROUP BY label, n, b // 64) GROUP BY label, n)
"""
