"""Vector-symbolic queries: analogy, relation decoding, sets, prototypes, hops with a search behind them.

Queries come in batches: a DataFrame of ids with a query_id each. Unknown or retracted ids give no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel as K
from .bundle import bundle
from .edges import latest_edges
from .search import knn_join, width


def resolve(asked: DataFrame, entities: DataFrame, roles: Sequence[str]) -> DataFrame:
    """asked with <role>_hv for each <role> id column; rows with an id that isn't live drop out."""
    out = asked
    for role in roles:
        own = entities.select(F.col("entity_id").alias(f"_{role}"), F.col("hv").alias(f"{role}_hv"))
        out = out.join(own, F.col(role) == F.col(f"_{role}")).drop(f"_{role}")
    return out


def missing(asked: DataFrame, entities: DataFrame, column: str) -> DataFrame:
    """Rows whose id has no live entity."""
    return asked.join(entities.select("entity_id"), F.col(column) == F.col("entity_id"), "left_anti")


def _search(asked: DataFrame, hv: Column, corpus: DataFrame, k: int) -> DataFrame:
    return knn_join(corpus, asked.select("query_id", hv.alias("hv")), k)


def analogy(asked: DataFrame, entities: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """asked (query_id, a, b, c): what is to c as b is to a. Searches a ^ b ^ c."""
    found = resolve(asked, entities, ("a", "b", "c"))
    return _search(found, K.bind(K.bind("a_hv", "b_hv"), "c_hv"), corpus, k)


def relation_decode(asked: DataFrame, entities: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """asked (query_id, relation, object): the subject of a flat-bound fact. Searches relation ^ object."""
    found = resolve(asked, entities, ("relation", "object"))
    return _search(found, K.bind("relation_hv", "object_hv"), corpus, k)


def set_query(members: DataFrame, entities: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """members (query_id, entity_id), one row a member, repeats count: nearest to the members' bundle."""
    own = members.join(entities.select("entity_id", "hv"), "entity_id")
    return knn_join(corpus, bundle(own, "query_id").select("query_id", "hv"), k)


def prototype_scores(members: DataFrame, entities: DataFrame, key: str = "label") -> DataFrame:
    """(entity_id, key, distance, similarity, rank): every entity against the bundled prototype of each key, nearest first.

    members: (key, entity_id). Prototypes are as few as the keys; they go through the kNN kernel as the corpus.
    """
    protos = bundle(members.join(entities.select("entity_id", "hv"), "entity_id"), key)
    n = max(1, protos.count())
    ranked = knn_join(protos.select(F.col(key).cast("long").alias("entity_id"), "hv"), entities.select(F.col("entity_id").alias("query_id"), "hv"), n)
    return ranked.select(F.col("query_id").alias("entity_id"), F.col("entity_id").cast(protos.schema[key].dataType).alias(key), "distance", "similarity", "rank")


def typed_relation(asked: DataFrame, edges: DataFrame, entities: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """asked (query_id, subject, relation): exact lookup; where there is no edge, search and decode.

    (query_id, rank, object_id, distance, similarity, exact, hit_id, decoded_exists). A decoded id is hit ^ subject ^ relation;
    most don't exist, which decoded_exists tells. An exact row stands alone with distance 0 whatever k is.
    """
    direct = latest_edges(edges).withColumnRenamed("subject_id", "_s").withColumnRenamed("relation_id", "_r")
    both = asked.join(direct, (F.col("subject") == F.col("_s")) & (F.col("relation") == F.col("_r")), "left").drop("_s", "_r")
    exact = both.where("object_id is not null").select(
        "query_id", F.lit(1).alias("rank"), "object_id", F.lit(0).cast("bigint").alias("distance"), F.lit(1.0).alias("similarity"),
        F.lit(True).alias("exact"), F.lit(None).cast("bigint").alias("hit_id"), F.lit(True).alias("decoded_exists"),
    )
    rest = resolve(both.where("object_id is null").select("query_id", "subject", "relation"), entities, ("subject", "relation"))
    hits = _search(rest, K.typed_edge_vector("subject_hv", "relation_hv"), corpus, k)
    ids = entities.select(F.col("entity_id").alias("_e")).distinct()
    decoded = hits.join(rest.select("query_id", "subject", "relation"), "query_id").withColumn("object_id", K.decode_id("entity_id", "subject", "relation"))
    decoded = decoded.join(ids, F.col("object_id") == F.col("_e"), "left")
    approx = decoded.select("query_id", "rank", "object_id", "distance", "similarity", F.lit(False).alias("exact"), F.col("entity_id").alias("hit_id"), F.col("_e").isNotNull().alias("decoded_exists"))
    return exact.unionByName(approx)


def chain_approx(starts: DataFrame, relations: Sequence[int], edges: DataFrame, entities: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """A greedy walk: the first of each hop goes on, the last hop gives k. Ids that don't exist end their walk."""
    if not relations:
        raise ValueError("a chain needs a relation")
    at = starts.select("query_id", F.col("entity_id").alias("subject"))
    for n, relation in enumerate(relations):
        last = n + 1 == len(relations)
        found = typed_relation(at.withColumn("relation", F.lit(relation).cast("bigint")), edges, entities, corpus, k if last else 1)
        if last:
            return found
        at = found.where("rank = 1").select("query_id", F.col("object_id").alias("subject"))
    raise AssertionError("unreachable")


def nearest(scores: DataFrame, key: str) -> DataFrame:
    """Of each entity's scores the best one, ties by key."""
    w = Window.partitionBy("entity_id").orderBy("distance", key)
    return scores.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


__all__ = ["analogy", "chain_approx", "missing", "nearest", "prototype_scores", "relation_decode", "resolve", "set_query", "typed_relation", "width"]
