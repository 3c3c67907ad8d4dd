"""Embedding near-deduplication by counting collisions of one-dimensional projections.

Vectors are projected on M random directions. Around each query's value on a sorted projection lies a
window; every vector inside is a collision of the pair. For two unit vectors at distance d the difference on a
Gaussian direction is normal with deviation d, so a pair at the wanted cosine collides on each projection
with a known probability, and the number of collisions that a pair must reach follows from the wanted
recall (the binomial's lower quantile). Pairs that pass are verified in double precision.

Windows of all vectors against all are quadratic. So vectors first meet in T coarse tables, by the signs of
some further projections; the number of sign bits follows the number of vectors and T the wanted recall. A pair is
counted in the first table where it meets, so counts need no distinct pass. Hot cells are spread; equal
vectors are one vector with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_schema, grouped, map_arrow, materialise, spread, table
from .components import components, forest

COSINE = 0.9
#: Projections that are counted, and half the width of a window.
PROJECTIONS, WINDOW = 24, 0.6
#: Recall of the tables, and of the collision count, for a pair just at the wanted cosine.
TABLE_RECALL, COUNT_RECALL = 0.985, 0.985
#: Vectors that a cell of a table should hold; above SPREAD a cell is cut.
CELL, SPREAD = 1024, 1024
SEED = 42


def collision_probability(cosine: float, window: float) -> float:
    """That two unit vectors at this cosine collide on one projection."""
    return math.erf(window / math.sqrt(2 * (2 - 2 * cosine))) if cosine < 1 else 1.0


def threshold(cosine: float, projections: int, window: float, recall: float) -> int:
    """The largest number of collisions that a pair at the cosine reaches with the given probability."""
    p = collision_probability(cosine, window)
    tail = 1.0
    for k in range(projections + 1):
        if tail < recall:
            return k - 1
        tail -= math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
    return projections


def table_plan(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """(sign bits of a table, tables)."""
    bits = max(0, math.ceil(math.log2(max(1, vectors) / CELL)))
    if not bits:
        return 0, 1
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - TABLE_RECALL) / math.log(1 - meet))


def directions(dims: int, count: int, stream: int) -> np.ndarray:
    return np.random.default_rng([SEED, stream, dims]).standard_normal((dims, count))


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)  # keeps the squares of huge and tiny components in range
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _codes(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables): the sign bits of each table as one number."""
    if not bits:
        return np.zeros((len(unit), 1), np.int64)
    signs = unit @ directions(unit.shape[1], bits * tables, 1) > 0
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def collisions(queries: np.ndarray, others: np.ndarray, window: float) -> np.ndarray:
    """Collisions of every query with every other row: for each sorted projection the run of rows within the window."""
    q, n = len(queries), len(others)
    counts = np.zeros((q, n), np.uint8)
    for p in range(others.shape[1]):
        order = np.argsort(others[:, p], kind="stable")
        value = others[order, p]
        low = np.searchsorted(value, queries[:, p] - window, "left")
        high = np.searchsorted(value, queries[:, p] + window, "right")
        # a run adds one between its ends: marks at both, summed along the sorted order, brought back to row order
        marks = np.zeros((q, n + 1), np.int8)
        row = np.arange(q)
        marks[row, low] += 1
        marks[row, high] -= 1
        inside = np.cumsum(marks[:, :n], axis=1, dtype=np.int8).view(np.uint8)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        counts += inside[:, back]
    return counts


def near_pairs(unit: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, cosine: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (one of left, one of right) with cosine or more, found by their collisions. same: left and right are the same rows."""
    proj = unit @ directions(unit.shape[1], PROJECTIONS, 2)
    a, b = [], []
    for at in range(0, len(left), 256):
        mine = left[at : at + 256]
        count = collisions(proj[mine], proj[right], WINDOW)
        i, j = (count >= need).nonzero()
        if same:
            keep = j > i + at
            i, j = i[keep], j[keep]
        x, y = mine[i], right[j]
        for k in range(0, len(x), 1 << 16):
            u, v = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            sure = np.einsum("ij,ij->i", unit[u], unit[v]) >= cosine
            a.append(u[sure])
            b.append(v[sure])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id_col, n_links, component_id, kept) per row of vectors.

    n_links: other rows linked directly; component_id: the smallest id reachable; kept: whether that is the row itself.
    Null, empty or zero vectors and those with null or non-finite components link with nothing, nor do vectors of different
    length with each other. Rows with equal vectors link. A null id is never the smallest; a row alone with one has a null component.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    # single precision stays so until the cosine is computed: half the bytes, the same numbers
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    raw = F.col(vector_col).cast(f"array<{kind}>")
    fit = raw.isNotNull() & (F.size(raw) > 0) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(raw, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("_id"), F.when(fit, raw).alias("_v"))
    # one representative for each distinct vector
    keyed = rows.select("_id", "_v", F.xxhash64("_v", F.lit(1)).alias("_h1"), F.xxhash64("_v", F.lit(2)).alias("_h2"))
    distinct = keyed.where("_v is not null and _id is not null").groupBy("_v", "_h1").agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    distinct = materialise(distinct.select("node", "copies", F.col("_v").alias("v"), F.size("_v").alias("dims")), "vectors")
    bits, tables = table_plan(distinct.count(), cosine)
    need = threshold(cosine, PROJECTIONS, WINDOW, COUNT_RECALL)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    keyed_schema = f"bucket long, tbl int, node long, copies long, codes array<long>, v array<{kind}>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(keyed_schema)
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                codes = _codes(_unit(_matrix(part.column(2), part.num_rows)), bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
                for t in range(codes.shape[1]):
                    bucket = codes[:, t] + (int(d) << 44) + (t << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(codes), t, np.int32)), part.column(0), part.column(1), lists, part.column(2)], schema=shape)

    placed = map_arrow(distinct.repartition(tasks).select("node", "copies", "v", "dims"), place, keyed_schema)
    cells = spread(materialise(placed, "placed"), "bucket", "node", SPREAD)
    cells = cells.repartition(tasks, "cell").sortWithinPartitions("cell", "node")

    # n: links of the row; a, b: links that join the task's components
    link_schema = "node long, n long, a long, b long"

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(link_schema)
        for whole in grouped(batches, "cell", 1):
            cell = whole.column("cell").to_numpy()
            starts = np.append(0, (cell[1:] != cell[:-1]).nonzero()[0] + 1)
            for s, e in zip(starts, np.append(starts[1:], len(cell))):
                if e - s < 2:
                    continue
                part = whole.slice(s, e - s)
                unit = _unit(_matrix(part.column("v"), part.num_rows))
                chunk = part.column("chunk").to_numpy()
                node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
                low = chunk == chunk.min()
                every = np.arange(len(chunk))
                same = bool(low.all())
                x, y = near_pairs(unit, every if same else every[low], every if same else every[~low], same, cosine, need)
                if not len(x):
                    continue
                a, b = forest(node[x], node[y])  # links join the cell's rows whichever table counts them
                codes = _matrix(part.column("codes"), part.num_rows)
                t = int(part.column("tbl")[0].as_py())
                first = ~(codes[x, :t] == codes[y, :t]).any(axis=1)
                x, y = x[first], y[first]
                n = np.bincount(x, copies[y], minlength=len(node)) + np.bincount(y, copies[x], minlength=len(node))
                own = n.nonzero()[0]
                yield pa.record_batch([pa.array(node[own]), pa.array(n[own].astype(np.int64)), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64())], schema=shape)
                yield pa.record_batch([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], schema=shape)

    found = materialise(map_arrow(cells.select("cell", "chunk", "tbl", "node", "copies", "codes", "v"), link, link_schema), "found")
    counts = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("n")).withColumnRenamed("node", "_cn")
    labels = components(found.where("a is not null").select("a", "b")).withColumnRenamed("node", "_ln")
    classes = distinct.select("v", "node", "copies").join(counts, F.col("node") == F.col("_cn"), "left").join(labels, F.col("node") == F.col("_ln"), "left")
    classes = classes.select(F.xxhash64("v", F.lit(1)).alias("_c1"), F.xxhash64("v", F.lit(2)).alias("_c2"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))
    classes = materialise(classes, "classes", narrow=True)
    joined = keyed.select("_id", "_h1", "_h2", F.col("_v").isNotNull().alias("_fit")).join(classes, F.col("_fit") & (F.col("_h1") == F.col("_c1")) & (F.col("_h2") == F.col("_c2")), "left")
    return joined.select(
        F.col("_id").alias(id_col), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "_id").alias("component_id"),
        F.coalesce(F.col("_id") == F.coalesce("component", "_id"), F.lit(True)).alias("kept"),
    )


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
