"""File sources: edge and label files, saved query responses, chain seeds, binary edge logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Relation types of the public leaks data, and what everything else is called.
LEAK_RELATIONS = ("officer_of", "intermediary_of", "registered_address", "similar", "same_name_as", "connected_to")
DEFAULT_RELATION = "connected_to"


def normalise_relation(name: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")
    return F.when(clean.isin(*LEAK_RELATIONS), clean).otherwise(F.lit(DEFAULT_RELATION))


def read_edge_csv(spark: SparkSession, path: str) -> DataFrame:
    """(subject_id, relation, object_id) from a CSV whose header has node_id_start, node_id_end and rel_type; rows with bad ids are skipped."""
    rows = spark.read.csv(path, header=True)
    out = rows.select(F.col("node_id_start").try_cast("bigint").alias("subject_id"), normalise_relation(F.coalesce("rel_type", F.lit(""))).alias("relation"), F.col("node_id_end").try_cast("bigint").alias("object_id"))
    return out.where("subject_id is not null and object_id is not null")


def read_labels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, label): split at the first tab; rows without one, or with a bad id, are skipped."""
    line = F.split(F.col("value"), "\t", 2)
    rows = spark.read.text(path).where(F.col("value").contains("\t"))
    return rows.select(F.regexp_replace(line[0], "^Q", "").try_cast("bigint").alias("id"), line[1].alias("label")).where("id is not null")


def read_edges_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(subject_id, property, object_id): lines of exactly three fields."""
    f = F.split(F.col("value"), "\t", -1)
    rows = spark.read.text(path).where(F.size(f) == 3)
    out = rows.select(f[0].try_cast("bigint").alias("subject_id"), f[1].alias("property"), f[2].try_cast("bigint").alias("object_id"))
    return out.where("subject_id is not null and object_id is not null")


def read_chain_seeds(spark: SparkSession, path: str, cap: int = 1000) -> DataFrame:
    """(start, rel1, rel2) from CSV lines; the first cap in order of start."""
    rows = spark.read.csv(path, schema="start string, rel1 string, rel2 string")
    out = rows.select(*(F.col(c).try_cast("bigint").alias(c) for c in ("start", "rel1", "rel2"))).where("start is not null and rel1 is not null and rel2 is not null")
    return out.orderBy("start", "rel1", "rel2").limit(cap)


def write_chain_seeds(seeds: DataFrame, path: str) -> None:
    seeds.select("start", "rel1", "rel2").write.csv(path)


BINDINGS = "results struct<bindings: array<map<string, struct<type: string, value: string>>>>"


def _entity(uri: Column) -> Column:
    return F.regexp_extract(uri, r"/Q(\d+)$", 1).try_cast("bigint")


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    """(item, label, target, property) from saved JSON responses with results.bindings[]; rows without an item are skipped."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", BINDINGS).alias("r"))
    rows = docs.select(F.explode("r.results.bindings").alias("b"))
    value = lambda name: F.col("b")[name]["value"]
    out = rows.select(_entity(value("item")).alias("item"), value("itemLabel").alias("label"), _entity(value("target")).alias("target"), value("pi").alias("property"))
    return out.where("item is not null")


def read_edge_log(spark: SparkSession, path: str) -> DataFrame:
    """(edge_key, object_id, seq) from a binary log of 16-byte little-endian records; an incomplete last record is left out."""
    files = spark.read.format("binaryFile").load(path)
    records = F.explode(F.sequence(F.lit(0), F.floor(F.length("content") / 16).cast("int") - 1))
    rows = files.where(F.length("content") >= 16).select("content", records.alias("seq"))

    def long_at(offset: int) -> Column:
        digits = F.hex(F.substring(F.col("content"), F.col("seq") * 16 + F.lit(offset + 1), F.lit(8)))
        swapped = F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)])
        return F.conv(swapped, 16, -10).cast("bigint")

    return rows.select(long_at(0).alias("edge_key"), long_at(8).alias("object_id"), F.col("seq").cast("bigint").alias("seq"))


def replay(log: DataFrame) -> DataFrame:
    """(edge_key, object_id): the last record of each key."""
    return log.groupBy("edge_key").agg(F.max_by("object_id", "seq").alias("object_id"))


def relation_rows(spark: SparkSession, labels: dict[str, str]) -> DataFrame:
    """(name, label) of the relations that are to be embedded."""
    return spark.createDataFrame(sorted(labels.items()), "name string, label string")
