"""A store of entities and edges: append-only Parquet with versions.

Layout: <root>/entities and <root>/edges hold appended parts; <root>/versions/<n>.json says up to which seq version n
reaches. A write is appended first and becomes visible when its version file is there (written under another name, then renamed),
so readers see whole versions only. Everything goes through Spark's file systems.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import ProjectionConfig, encode
from ..operators import edges as E

FORMAT = 3
READABLE = (2, 3)

ENTITY_SCHEMA = "entity_id bigint, hv array<bigint>, kind string, deleted boolean, seq bigint"
EDGE_SCHEMA = "subject_id bigint, relation_id bigint, object_id bigint, kind string, seq bigint"


class IncompatibleStore(ValueError):
    """The store's projection isn't the one that was asked for, or its format can't be read."""


class Store:
    def __init__(self, spark: SparkSession, root: str, config: ProjectionConfig | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        meta = self._read(f"{self.root}/store.json")
        if meta is None:
            self.config = config or ProjectionConfig()
            self._write(f"{self.root}/store.json", {"format": FORMAT, **asdict(self.config)})
        else:
            if meta.pop("format") not in READABLE:
                raise IncompatibleStore("unknown store format")
            self.config = ProjectionConfig(**meta)
            if config is not None and config != self.config:
                raise IncompatibleStore(f"store has {self.config}, asked for {config}")
        self.version = self._latest()

    # ---- files
    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, path: str) -> dict | None:
        where, fs = self._path(path)
        if not fs.exists(where):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))

    def _write(self, path: str, value: dict) -> None:
        where, fs = self._path(path)
        part, _ = self._path(f"{path}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not fs.rename(part, where):
            raise FileExistsError(path)

    def _latest(self) -> int:
        where, fs = self._path(f"{self.root}/versions")
        if not fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)

    def versions(self) -> list[dict]:
        return [self._read(f"{self.root}/versions/{v}.json") for v in range(1, self.version + 1)]

    # ---- writes
    def _append(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").parquet(f"{self.root}/{table}/v={self.version + 1}")

    def put_binary(self, entities: DataFrame, kind: str = "entity") -> int:
        """Appends (entity_id, hv: array<bigint>); widths must be the store's. A later row of an id replaces the earlier one."""
        n = self.config.words
        hv = F.when(F.size("hv") == n, F.col("hv")).otherwise(F.raise_error(F.lit(f"vectors must have {n} words")))
        self._append(entities.select(F.col("entity_id").cast("bigint").alias("entity_id"), hv.alias("hv"), F.lit(kind).alias("kind"), F.lit(False).alias("deleted"), self._seq()), "entities")
        return self.commit()

    def put_float(self, entities: DataFrame, vector: str = "embedding", kind: str = "entity") -> int:
        """Encodes and appends (entity_id, vector)."""
        return self.put_binary(encode(entities.select("entity_id", vector), self.config, vector, "hv"), kind)

    def retract(self, ids: DataFrame) -> int:
        """Appends tombstones for (entity_id); unknown ids do no harm."""
        gone = ids.select(F.col("entity_id").cast("bigint").alias("entity_id"), F.lit(None).cast("array<bigint>").alias("hv"), F.lit("entity").alias("kind"), F.lit(True).alias("deleted"), self._seq())
        self._append(gone, "entities")
        return self.commit()

    def put_edges(self, rows: DataFrame, kind: str = "typed", strict: bool = True) -> DataFrame:
        """Appends the edges (subject_id, relation_id, object_id) whose ids are live and gives the rejected ones; strict raises instead if there are any."""
        valid, rejected = E.referential_check(rows.select("subject_id", "relation_id", "object_id"), self.entities())
        if strict and not rejected.isEmpty():
            raise KeyError("an edge names an entity that isn't live")
        self._append(valid.withColumn("kind", F.lit(kind)).withColumn("seq", self._seq()), "edges")
        self.commit()
        return rejected

    def put_batch(self, rows: DataFrame, vector: str = "embedding") -> DataFrame:
        """Stores the rows that are valid and gives the others with an error text; nothing stops the batch."""
        good, bad = split_batch(rows, self.config.dims, vector)
        self.put_float(good, vector)
        return bad

    def _seq(self):
        # order within a write follows the rows' place in it; later versions always come after
        return (F.monotonically_increasing_id() % (1 << 40) + F.lit(self.version + 1).cast("bigint") * (1 << 40)).alias("seq")

    def commit(self) -> int:
        self._write(f"{self.root}/versions/{self.version + 1}.json", {"version": self.version + 1, "at": time.time()})
        self.version += 1
        return self.version

    # ---- reads
    def _table(self, table: str, schema: str, version: int | None) -> DataFrame:
        version = self.version if version is None else version
        where, fs = self._path(f"{self.root}/{table}")
        if not fs.exists(where):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema + ", v int").option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")
        return rows.where(F.col("v") <= version).drop("v")  # partition pruning: only whole versions

    def log(self, version: int | None = None) -> DataFrame:
        return self._table("entities", ENTITY_SCHEMA, version)

    def entities(self, version: int | None = None, include_retracted: bool = False) -> DataFrame:
        """Latest row of each entity that isn't retracted; include_retracted keeps the last vector of retracted ones."""
        return live_view(self.log(version), include_retracted)

    def edges(self, version: int | None = None) -> DataFrame:
        return self._table("edges", EDGE_SCHEMA, version)

    def edge_corpus(self, version: int | None = None) -> DataFrame:
        """Edge vectors as (entity_id, hv, kind): what a search over everything sees beside the entities."""
        live, edges = self.entities(version), self.edges(version)
        made = [E.edge_vectors(edges.where(F.col("kind") == kind), live, flat=kind == "flat").select(F.col("composite_id").alias("entity_id"), "hv", F.lit(f"{kind}_edge").alias("kind")) for kind in ("typed", "flat")]
        return made[0].unionByName(made[1])

    def corpus(self, version: int | None = None) -> DataFrame:
        return self.entities(version).select("entity_id", "hv", "kind").unionByName(self.edge_corpus(version))

    def counts(self) -> DataFrame:
        return self.corpus().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

    def status(self) -> DataFrame:
        c = self.config
        return self.spark.createDataFrame([(True, self.version, c.dims, c.seed, c.bits, c.matrix)], "alive boolean, version int, dims int, seed bigint, output_bits int, matrix string")

    def ping(self) -> bool:
        return self._latest() >= self.version

    # ---- a transaction commits when its block ends without an error
    def __enter__(self) -> Store:
        return self

    def __exit__(self, kind: type[BaseException] | None, value: BaseException | None, trace: TracebackType | None) -> None:
        if kind is None:
            self.commit()


def live_view(log: DataFrame, include_retracted: bool = False) -> DataFrame:
    """Of (entity_id, hv, kind, deleted, seq) the row of the highest seq per id, without retracted ones.

    An aggregation, not a window: each task sends one row per id.
    """
    row = F.struct("hv", "kind", "deleted", "seq")
    newest = F.max_by(row, "seq").alias("r")
    if include_retracted:
        newest = F.max_by(row, F.when(F.col("hv").isNotNull(), F.col("seq"))).alias("r")
    out = log.groupBy("entity_id").agg(newest).select("entity_id", "r.hv", "r.kind", "r.deleted", "r.seq")
    return (out if include_retracted else out.where("not deleted")).where("hv is not null").drop("deleted")


def split_batch(rows: DataFrame, dims: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with error): an id and a vector of the right length without null or non-finite components."""
    v = F.col(vector)
    error = (
        F.when(F.col("entity_id").isNull(), "missing id").when(v.isNull(), "missing embedding").when(F.size(v) != dims, F.concat(F.lit("wrong dimensions: "), F.size(v).cast("string")))
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "non-finite component")
    )
    marked = rows.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def batch_counts(rows: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    good, bad = split_batch(rows, dims, vector)
    marked = good.select(F.lit(1).alias("ok")).unionAll(bad.select(F.lit(0).alias("ok")))
    return marked.agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("succeeded"), F.coalesce(F.sum(1 - F.col("ok")), F.lit(0)).alias("failed"), F.count(F.lit(1)).alias("total"))


def raise_if_any(rejected: DataFrame) -> None:
    n = rejected.count()
    if n:
        raise ValueError(f"{n} rows were rejected")


def audit(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """rows with version (the stored one plus 1), created (kept if it was stored) and last_modified."""
    now = F.current_timestamp()
    if stored is None:
        return rows.withColumns({"version": F.lit(1).cast("bigint"), "created": now, "last_modified": now})
    old = stored.select(F.col("entity_id").alias("_id"), F.col("version").alias("_v"), F.col("created").alias("_c"))
    joined = rows.join(old, F.col("entity_id") == F.col("_id"), "left")
    return joined.withColumns({"version": F.coalesce(F.col("_v"), F.lit(0)) + 1, "created": F.coalesce("_c", now), "last_modified": now}).drop("_id", "_v", "_c")


def write_versions(writes: DataFrame, key: str, order: str) -> DataFrame:
    """Version number of every write of a key, in the given order."""
    return writes.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("bigint"))
