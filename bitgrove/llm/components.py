"""Connected components of a table of links, without collecting links or labels.

Every round contracts the graph. Each node points at the smallest node among itself and its
neighbours; pointers strictly decrease, so they form a forest whose roots are found by pointer
jumping. Links are then rewritten between roots, and repeated ones and loops go. The number of nodes
with links at least halves in a round. Before each round, links are thinned to a spanning forest
inside each task, which shortens paths and removes most repeated links early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_schema, map_arrow, materialise

LINKS = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: (member, smallest member), members that are not smallest."""
    if not len(a):
        return a, b
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label = nxt
        if np.array_equal(before, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join what those of a task join, a spanning forest of some million at a time."""
    schema = arrow_schema(LINKS)
    # a bounded number of links at a time, whatever the size of the task
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
        if len(a) >= 1 << 20:
            a, b = forest(a, b)
            if len(a) >= 1 << 19:
                yield pa.record_batch([pa.array(a), pa.array(b)], schema=schema)
                a, b = a[:0], b[:0]
    a, b = forest(a, b)
    if len(a):
        yield pa.record_batch([pa.array(a), pa.array(b)], schema=schema)


def _jump(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by its root."""
    while True:
        up = parents.select(F.col("node").alias("_p"), F.col("parent").alias("_pp"))
        jumped = parents.join(up, parents["parent"] == up["_p"], "left").select("node", F.coalesce("_pp", "parent").alias("parent"), (F.col("_pp").isNotNull() & (F.col("_pp") != F.col("parent"))).alias("_moved"))
        jumped = materialise(jumped, "jump", narrow=True)
        moved = not jumped.where("_moved").isEmpty()
        parents = jumped.drop("_moved")
        if not moved:
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (columns a, b: long) that is not itself the smallest of its component."""
    spark = links.sparkSession
    links = materialise(map_arrow(links.select("a", "b").where("a <> b"), thin, LINKS), "links", narrow=True)
    found: DataFrame | None = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select("b", "a"))
        low = both.groupBy("node").agg(F.min("other").alias("parent")).where("parent < node")
        roots = _jump(materialise(low, "parents", narrow=True))
        found = roots if found is None else _follow(found, roots).unionAll(roots)
        found = materialise(found, "labels", narrow=True)
        to_a = roots.select(F.col("node").alias("_na"), F.col("parent").alias("_ra"))
        to_b = roots.select(F.col("node").alias("_nb"), F.col("parent").alias("_rb"))
        moved = links.join(to_a, F.col("a") == F.col("_na"), "left").join(to_b, F.col("b") == F.col("_nb"), "left")
        moved = moved.select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b")).where("a <> b")
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = materialise(map_arrow(moved, thin, LINKS), "links", narrow=True)
    if found is None:
        return spark.createDataFrame([], "node long, component long")
    return found.select("node", F.col("parent").alias("component"))


def _follow(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Labels found so far, moved to the roots that their own labels now have."""
    up = roots.select(F.col("node").alias("_p"), F.col("parent").alias("_pp"))
    return found.join(up, found["parent"] == up["_p"], "left").select("node", F.coalesce("_pp", "parent").alias("parent"))
