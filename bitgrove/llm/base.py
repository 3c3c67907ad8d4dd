"""What several operators share: shared-folder tables, Arrow batch mapping, spreading of hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ready, scratch

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and survives lost executors.

    narrow: rows of a few numbers, made by little work after a shuffle. They go to an eighth of the shuffle partitions, or two files a
    core if that is more (16 at least): many files of a few kilobytes cost the store, and the executors that make them, more than they save.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    if narrow:
        df = df.coalesce(max(16, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    ready(df.sparkSession)
    return df.mapInArrow(fn, schema)


_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a flat DDL string; workers have no session that could parse it."""
    fields = [f.split() for f in schema.split(",")]
    return pa.schema([(n, pa.list_(_ARROW[t[6:-1]]) if t.startswith("array<") else _ARROW[t]) for n, t in fields])


def spread(rows: DataFrame, key: str, ident: str, cap: int) -> DataFrame:
    """Cells of at most about 2*cap rows that together hold every pair of rows with equal key.

    Keys with more than cap rows are cut into g chunks by a hash of ident, and each pair of chunks is a
    cell of its own: no key, however hot, meets in one task. Adds `cell` (long) and `chunk` (int); rows of
    a cell (a, b) with a < b have chunk a or b, and only pairs across chunks, or all pairs where a == b,
    belong to it. Sizes are counted over all rows; the table of hot keys has at most rows/cap entries.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap)
    hot = materialise(hot.select(F.col(key).alias("_k"), F.ceil(F.col("_n") / cap).cast("int").alias("_g")), "hot", narrow=True)
    if hot.isEmpty():
        return rows.withColumns({"chunk": F.lit(0), "cell": F.xxhash64(key, F.lit(0), F.lit(0))})
    joined = rows.join(hot, rows[key] == hot["_k"], "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    joined = joined.withColumn("chunk", F.pmod(F.xxhash64(F.col(ident)), F.col("_g")).cast("int"))
    joined = joined.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return joined.withColumn("cell", F.xxhash64(key, F.least("chunk", "_o"), F.greatest("chunk", "_o"))).drop("_k", "_g", "_o")


def grouped(batches: Iterator[pa.RecordBatch], key: str, at_least: int) -> Iterator[pa.Table]:
    """Tables of whole, adjacent groups of key, each of at_least rows unless it is the last. Input sorted by key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < at_least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(key).to_numpy()
        last = int((keys != keys[-1]).nonzero()[0][-1]) + 1 if keys[0] != keys[-1] else 0
        if last:
            yield whole.slice(0, last)
            held, n = whole.slice(last).combine_chunks().to_batches(), len(keys) - last
        else:
            held = whole.to_batches()
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
