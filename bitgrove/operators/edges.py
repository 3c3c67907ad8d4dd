"""Typed edges: writing with checks, last write wins, hops, chains, traversal.

edges: (subject_id, relation_id, object_id, seq). An edge is functional per (subject, relation): the one with the
highest seq counts. Every operator keeps the pair as join key; compat_xor_key reproduces keys made by XOR.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..session import settled

#: Edges that a hop of data-driven chains broadcasts at most; hops that are planned before a walk is written.
BROADCAST_EDGES, PLANNED_HOPS = 100_000, 8


def latest_edges(edges: DataFrame, compat_xor_key: bool = False) -> DataFrame:
    """One row per (subject, relation): the object of the highest seq, ties by the larger object."""
    newest = F.max_by("object_id", F.struct("seq", "object_id")).alias("object_id")
    if compat_xor_key:
        key = F.col("subject_id").bitwiseXOR(F.col("relation_id")).alias("edge_key")
        return edges.groupBy(key).agg(newest)
    return edges.groupBy("subject_id", "relation_id").agg(newest)


def referential_check(edges: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): edges whose three ids are live entities, and the others with the first missing role."""
    ids = live.select(F.col("entity_id").alias("_id")).distinct().withColumn("_live", F.lit(True))
    joined = edges
    for role in ("subject", "relation", "object"):
        mark = ids.select(F.col("_id").alias(f"_{role}"), F.col("_live").alias(f"_has_{role}"))
        joined = joined.join(mark, F.col(f"{role}_id") == F.col(f"_{role}"), "left").drop(f"_{role}")
    missing = F.when(F.col("_has_subject").isNull(), "subject").when(F.col("_has_relation").isNull(), "relation").when(F.col("_has_object").isNull(), "object")
    marked = joined.withColumn("missing", missing).drop("_has_subject", "_has_relation", "_has_object")
    return marked.where("missing is null").drop("missing"), marked.where("missing is not null")


def valid_edges(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Edges whose three ids are live: semi joins only."""
    ids = live.select("entity_id")
    for role in ("subject_id", "relation_id", "object_id"):
        edges = edges.join(ids, F.col(role) == F.col("entity_id"), "left_semi")
    return edges


def edge_vectors(edges: DataFrame, entities: DataFrame, flat: bool = False) -> DataFrame:
    """edges with composite_id and hv. Typed vectors don't depend on the object; flat ones bind all three."""
    vec = lambda role: entities.select(F.col("entity_id").alias(f"_{role}"), F.col("hv").alias(f"_{role}_hv"))
    out = edges
    for role in ("subject", "relation", "object"):
        out = out.join(vec(role), F.col(f"{role}_id") == F.col(f"_{role}"))
    hv = K.flat_edge_vector("_subject_hv", "_relation_hv", "_object_hv") if flat else K.typed_edge_vector("_subject_hv", "_relation_hv")
    return out.select(*(edges[c] for c in edges.columns), K.composite_id("subject_id", "relation_id", "object_id").alias("composite_id"), hv.alias("hv"))


def hop(starts: DataFrame, relation: Column | int, edges: DataFrame, keep_misses: bool = False) -> DataFrame:
    """starts (query_id, entity_id) -> (query_id, subject_id, object_id, distance, similarity) by exact lookup.

    One row where the edge exists, whatever k is; none where it doesn't, or a row with nulls if misses are kept.
    """
    relation = relation if isinstance(relation, Column) else F.lit(relation).cast("bigint")
    asked = starts.select("query_id", F.col("entity_id").alias("subject_id"), relation.alias("relation_id"))
    found = asked.join(latest_edges(edges), ["subject_id", "relation_id"], "left" if keep_misses else "inner")
    there = F.col("object_id").isNotNull()
    return found.select("query_id", "subject_id", "object_id", F.when(there, F.lit(0).cast("bigint")).alias("distance"), F.when(there, F.lit(1.0)).alias("similarity"))


def multi_hop(starts: DataFrame, relation: int, edges: DataFrame) -> DataFrame:
    """Every distinct object of the relation, older writes as well."""
    own = edges.where(F.col("relation_id") == relation).select("subject_id", "object_id").distinct()
    return starts.select("query_id", F.col("entity_id").alias("subject_id")).join(own, "subject_id")


def chain(starts: DataFrame, relations: Sequence[int], edges: DataFrame, path: bool = False) -> DataFrame:
    """Follows a fixed list of relations: one equi-join a hop on the edges of that relation.

    (query_id, entity_id), with path also hop_1 ... hop_n: null from the hop that has no edge on, and those rows stay.
    """
    if not relations:
        raise ValueError("a chain needs a relation")
    edges_by = latest_edges(edges)
    current = starts.select("query_id", F.col("entity_id").alias("_at"))
    hops: list[str] = []
    for n, relation in enumerate(relations, 1):
        step = edges_by.where(F.col("relation_id") == F.lit(relation).cast("bigint")).select(F.col("subject_id").alias("_from"), F.col("object_id").alias("_to"))
        joined = current.join(step, F.col("_at") == F.col("_from"), "left" if path else "inner")
        current = joined.select("query_id", *hops, *([F.col("_to").alias(f"hop_{n}")] if path else []), F.col("_to").alias("_at"))
        hops += [f"hop_{n}"] if path else []
    return current.select("query_id", *hops, F.col("_at").alias("entity_id"))


def chain_recursive(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """Data-driven chains: chains (query_id, entity_id, relations array<bigint>) -> (query_id, entity_id, depth) of those that end.

    One equi-join a hop, as many as the longest list has; a recursive table expression would stop at spark.sql.cteRecursionRowLimit.
    Each hop meets the edges of the relations that stand at its place in some list; few of those are broadcast. Walks are
    written where some end, and every few hops, so that neither the plan nor repeated work grows with the lists.
    """
    spark = chains.sparkSession
    walk = chains.select("query_id", "entity_id", F.col("relations").alias("rest")).where(F.col("rest").isNotNull())
    lengths = {r["n"] for r in walk.select(F.size("rest").alias("n")).distinct().collect()}
    asked = settled(walk.select(F.posexplode("rest").alias("place", "relation_id")).distinct(), "asked")
    latest = settled(latest_edges(edges.join(asked.select("relation_id").distinct(), "relation_id", "left_semi")), "edges")
    sizes = {r["place"]: r["count"] for r in latest.join(asked, "relation_id").groupBy("place").count().collect()}
    ended = [walk.where(F.size("rest") == 0).select("query_id", "entity_id", F.lit(0).alias("depth"))] if 0 in lengths or not lengths else []
    for depth in range(1, max(lengths, default=0) + 1):
        own = latest.join(asked.where(F.col("place") == depth - 1), "relation_id", "left_semi")
        step = own.select(F.col("subject_id").alias("_from"), F.col("relation_id").alias("_over"), F.col("object_id").alias("_to"))
        step = F.broadcast(step) if sizes.get(depth - 1, 0) <= BROADCAST_EDGES else step
        joined = walk.where(F.size("rest") > 0).join(step, (F.col("entity_id") == F.col("_from")) & (F.get("rest", F.lit(0)) == F.col("_over")))
        walk = joined.select("query_id", F.col("_to").alias("entity_id"), F.slice("rest", F.lit(2), F.size("rest") - 1).alias("rest"))
        more = depth < max(lengths)
        if more and (depth in lengths or depth % PLANNED_HOPS == 0):
            walk = settled(walk, "walk")
        if depth in lengths:
            ended.append(walk.where(F.size("rest") == 0).select("query_id", "entity_id", F.lit(depth).alias("depth")))
    return reduce(DataFrame.unionAll, ended)


def chain_intersection(first: DataFrame, second: DataFrame) -> DataFrame:
    """Entities that two chains of the same query both end at."""
    return first.select("query_id", "entity_id").intersect(second.select("query_id", "entity_id"))


def expand(seeds: DataFrame, edges: DataFrame, relations: Sequence[int], rounds: int = 4) -> DataFrame:
    """(entity_id, depth): breadth-first from the seeds over the given relations, each entity at its first depth; stops at an empty frontier."""
    usable = latest_edges(edges).where(F.col("relation_id").isin([int(r) for r in relations])).select("subject_id", "object_id")
    seen = seeds.select("entity_id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, rounds + 1):
        step = frontier.join(usable, F.col("entity_id") == F.col("subject_id")).select(F.col("object_id").alias("entity_id")).distinct()
        frontier = step.join(seen, "entity_id", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen


def chain_seeds(edges: DataFrame, cap: int = 10_000) -> DataFrame:
    """(start, rel1, rel2): entities with two relations or more, and two of them picked by a hash; cap of them in hash order."""
    own = edges.select("subject_id", "relation_id").distinct().withColumn("h", F.xxhash64("subject_id", "relation_id"))
    picked = own.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("h", "relation_id"))).alias("r")).where(F.size("r") >= 2)
    rows = picked.select(F.col("subject_id").alias("start"), F.col("r")[0]["relation_id"].alias("rel1"), F.col("r")[1]["relation_id"].alias("rel2"))
    return rows.orderBy(F.xxhash64("start"), "start").limit(cap)


def probe(edges: DataFrame) -> DataFrame:
    """(rel1, rel2, start): the first pair rel1 < rel2 for which rel1, rel2, rel1, rel2 can be followed, and its smallest start."""
    e = latest_edges(edges)
    first = e.select(F.col("subject_id").alias("start"), F.col("relation_id").alias("rel1"), F.col("object_id").alias("a1"))
    second = e.select(F.col("subject_id").alias("a1"), F.col("relation_id").alias("rel2"), F.col("object_id").alias("a2"))
    third = e.select(F.col("subject_id").alias("a2"), F.col("relation_id").alias("rel1"), F.col("object_id").alias("a3"))
    fourth = e.select(F.col("subject_id").alias("a3"), F.col("relation_id").alias("rel2"))
    walks = first.join(second, "a1").where("rel1 < rel2").join(third, ["a2", "rel1"]).join(fourth, ["a3", "rel2"])
    return walks.groupBy("rel1", "rel2").agg(F.min("start").alias("start")).orderBy("rel1", "rel2").limit(1)
