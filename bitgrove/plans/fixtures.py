"""How the driver's tables become entities, codes and typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..functions.vectors import ProjectionConfig, encode
from ..session import ready

#: Width of the vectors in queries that SQL checks; everything else uses the full width.
NARROW = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def named(prefix: str, key: Column | str) -> Column:
    """Entity id of a row: the hash of 'prefix:key', so that ids of different tables never meet."""
    return K.entity_id(F.concat(F.lit(f"{prefix}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def codes(spark: SparkSession, sf_dir: str, words: int = NARROW, matrix: str = "rademacher") -> DataFrame:
    """(entity_id, hv, label) of the embeddings table."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), "embedding", "label")
    return encode(rows, ProjectionConfig(dims=64, words=words, matrix=matrix)).select("entity_id", "hv", "label")


def relation(name: str) -> Column:
    return K.relation_id(F.lit(name))


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, relation_id, object_id, seq): order placed_by customer, customer and supplier in_nation, nation in_region."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda s, r, o, seq: (s.alias("subject_id"), relation(r).alias("relation_id"), o.alias("object_id"), F.col(seq).cast("bigint").alias("seq"))
    placed = t("orders").select(*edge(named("order", "o_orderkey"), "placed_by", named("customer", "o_custkey"), "o_orderkey"))
    lives = t("customer").select(*edge(named("customer", "c_custkey"), "in_nation", named("nation", "c_nationkey"), "c_custkey"))
    sells = t("supplier").select(*edge(named("supplier", "s_suppkey"), "in_nation", named("nation", "s_nationkey"), "s_suppkey"))
    lies = t("nation").select(*edge(named("nation", "n_nationkey"), "in_region", named("region", "n_regionkey"), "n_nationkey"))
    return placed.unionAll(lives).unionAll(sells).unionAll(lies)


def relation_value(spark: SparkSession, name: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256(f"REL:{name}".encode()).digest()[:8], "big") & 0x7FFFFFFFFFFFFFFF


def orders_as_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), named("order", "o_orderkey").alias("entity_id"))


def capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, hv): nations (id = key), their capitals (100 + key, nation ^ capitalOf), and the relation (1000)."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    vec = K.symbol_vector(F.concat(F.lit("nation:"), F.col("k").cast("string")), NARROW)
    rel = K.symbol_vector(F.lit("REL:capitalOf"), NARROW)
    nations = n.select(F.col("k").alias("entity_id"), vec.alias("hv"))
    cities = n.select((F.col("k") + 100).alias("entity_id"), K.bind(vec, rel).alias("hv"))
    one = spark.range(1).select(F.lit(1000).cast("bigint").alias("entity_id"), rel.alias("hv"))
    return nations.unionAll(cities).unionAll(one)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges user -> type of event in order of event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(named("user", "user_id").alias("subject_id"), relation("last_event_type").alias("relation_id"), named("type", "event_type").alias("object_id"), F.col("event_id").alias("seq"))


def joined_words(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")
