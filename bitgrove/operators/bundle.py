"""Majority-vote bundles and prototypes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import stack_words

TALLY = pa.schema([("key", pa.string()), ("n", pa.int64()), ("tally", pa.list_(pa.int64()))])


def bundle(df: DataFrame, key: str, hv: str = "hv") -> DataFrame:
    """(key, n, hv): a bit is set where more than floor(n/2) of the key's vectors have it; a repeated vector counts again.

    Tallies are added per task and key in NumPy, so each task sends one row per key; the rows are summed by bit.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.unpackbits(np.ascontiguousarray(stack_words(batch.column(1), batch.num_rows)).view(np.uint8), axis=1, bitorder="little")
            keys = np.array(batch.column(0).to_pylist(), dtype=object)
            for k in dict.fromkeys(keys.tolist()):
                mine = keys == k
                entry = sums.setdefault(k, [0, 0])
                entry[0] += int(mine.sum())
                entry[1] = entry[1] + bits[mine].sum(axis=0, dtype=np.int64)
            if len(sums) > 512:  # many keys: send what there is, memory stays bounded
                yield _tallies(sums)
                sums = {}
        if sums:
            yield _tallies(sums)

    def _tallies(sums: dict) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(sums), pa.string()), pa.array([n for n, _ in sums.values()]), pa.array([t for _, t in sums.values()], pa.list_(pa.int64()))], schema=TALLY)

    partial = df.select(F.col(key).cast("string").alias("key"), F.col(hv).alias("hv")).mapInArrow(tally, "key string, n long, tally array<long>")
    counts = partial.groupBy("key").agg(F.sum("n").alias("n"))
    bits = partial.select("key", F.posexplode("tally").alias("bit", "t")).groupBy("key", "bit").agg(F.sum("t").alias("t"))
    # 64 sums make a word
    voted = bits.join(counts, "key").select("key", "n", "bit", (F.col("t") > F.floor(F.col("n") / 2)).alias("on"))
    words = voted.groupBy("key", "n", F.floor(F.col("bit") / 64).alias("w")).agg(F.bit_or(F.when(F.col("on"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))).otherwise(F.lit(0).cast("bigint"))).alias("x"))
    made = words.groupBy("key", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "x"))), lambda s: s["x"]).alias("hv"))
    return made.select(F.col("key").cast(df.schema[key].dataType).alias(key), "n", "hv")


def bundle_expr(df: DataFrame, key: str, hv: str = "hv") -> DataFrame:
    """The same by DataFrame functions alone; slower, for engines without Python workers."""
    words = df.select(F.col(key).alias("_k"), F.posexplode(hv).alias("w", "x"))
    bits = [F.sum(F.bit_get("x", F.lit(b)).cast("bigint")) for b in range(64)]
    per_word = words.groupBy("_k", "w").agg(F.count(F.lit(1)).alias("n"), F.array(*bits).alias("t"))
    on = F.aggregate(F.transform("t", lambda t, i: F.when(t > F.floor(F.col("n") / 2), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))
    made = per_word.select("_k", "n", "w", on.alias("x")).groupBy("_k", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "x"))), lambda s: s["x"]).alias("hv"))
    return made.select(F.col("_k").alias(key), "n", "hv")


def mean_pool(df: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """(key, mean): per dimension the mean over the key's rows whose mask is set."""
    rows = df.where(F.col(mask) != 0) if mask else df
    dims = rows.select(key, F.posexplode(vector).alias("d", "x")).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return dims.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("mean"))


def bundle_local(vectors: list[np.ndarray]) -> np.ndarray:
    """Bundle of a few vectors on the driver, for query construction."""
    if not vectors:
        raise ValueError("a bundle needs a vector")
    bits = np.unpackbits(np.stack(vectors).astype("<i8").view(np.uint8), axis=1, bitorder="little").sum(axis=0)
    return np.packbits(bits > len(vectors) // 2, bitorder="little").view("<i8")



