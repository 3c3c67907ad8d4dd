"""NumPy side of the kernel: binary vectors (little-endian 64-bit words), codecs, projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import WORDS

# Seed and dimensions of the default projection.
DEFAULT_SEED = 0xC0FFEE_FACADE_42
DEFAULT_DIMS = 384


@dataclass(frozen=True)
class ProjectionConfig:
    """What makes codes comparable: all of it must agree."""

    seed: int = DEFAULT_SEED
    dims: int = DEFAULT_DIMS
    words: int = WORDS
    matrix: str = "gaussian"

    def __post_init__(self):
        if self.dims <= 0 or self.words <= 0:
            raise ValueError("dims and words must be positive")
        if self.matrix not in ("gaussian", "rademacher"):
            raise ValueError(f"unknown matrix: {self.matrix}")

    @property
    def bits(self) -> int:
        return self.words * 64


def rademacher(bits: int, dims: int) -> np.ndarray:
    """Signs from integer arithmetic on (bit, dimension): the same numbers in any SQL engine."""
    i, d = np.arange(bits, dtype=np.int64)[:, None], np.arange(dims, dtype=np.int64)[None, :]
    a = (i * 7919 + d * 104729 + i * d * 31 + 17) % 10007
    b = (i * 611 + d * 53 + 29) % 10007
    return np.where(a * b % 10007 % 2 == 0, 1.0, -1.0)


def matrix(config: ProjectionConfig) -> np.ndarray:
    """bits x dims. Gaussian entries come from a seeded generator whose name is part of the stored configuration."""
    if config.matrix == "rademacher":
        return rademacher(config.bits, config.dims)
    return np.random.Generator(np.random.PCG64(config.seed)).standard_normal((config.bits, config.dims), dtype=np.float32)


def pack(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(rows, bits/64) words: a bit is 1 where the dot product is above zero. Zero vectors give zero."""
    out = np.empty((len(x), m.shape[0] // 64), np.int64)
    for at in range(0, len(x), 1024):
        out[at : at + 1024] = np.packbits((x[at : at + 1024].astype(m.dtype) @ m.T) > 0, axis=1, bitorder="little").view("<i8")
    return out


def encode(df: DataFrame, config: ProjectionConfig, vector: str = "embedding", out: str = "hv", binary: bool = False) -> DataFrame:
    """df with the code of each vector: array<bigint>, or binary. The matrix has a fixed size and is broadcast.

    A vector of another length, or none, is an error: filter with size(vector) = dims first.
    """
    shipped = df.sparkSession.sparkContext.broadcast(matrix(config))
    dims = config.dims

    def words(v: pd.Series) -> np.ndarray:
        if any(x is None or len(x) != dims for x in v):
            raise ValueError(f"vectors must have {dims} dimensions")
        return pack(np.stack(v.to_numpy()) if len(v) else np.empty((0, dims)), shipped.value)

    if binary:

        @F.pandas_udf("binary")
        def code(v: pd.Series) -> pd.Series:
            return pd.Series([x.tobytes() for x in words(v)], dtype=object)

    else:

        @F.pandas_udf("array<bigint>")
        def code(v: pd.Series) -> pd.Series:
            return pd.Series(list(words(v)), dtype=object)

    return df.withColumn(out, code(F.col(vector)))


@F.pandas_udf(T.BinaryType())
def words_to_binary(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<i8").tobytes())


@F.pandas_udf(T.ArrayType(T.LongType()))
def binary_to_words(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.frombuffer(x, "<i8").tolist())


@F.pandas_udf(T.BinaryType())
def floats_to_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


def _floats(x: bytes | None) -> list[float] | None:
    if x is None:
        return None
    if len(x) % 4:
        raise ValueError("a float vector's bytes must be a multiple of 4")
    return np.frombuffer(x, "<f4").tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def bytes_to_floats(v: pd.Series) -> pd.Series:
    return v.map(_floats)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, wrapping."""
    z = x.astype(np.uint64)
    z ^= z >> np.uint64(33)
    z *= np.uint64(0xFF51AFD7ED558CCD)
    z ^= z >> np.uint64(33)
    z *= np.uint64(0xC4CEB9FE1A85EC53)
    return (z ^ (z >> np.uint64(33))).view(np.int64)


@F.pandas_udf(T.LongType())
def mix_hash64(x: pd.Series) -> pd.Series:
    return pd.Series(mix64(x.to_numpy(np.int64)))


def stack_words(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """(rows, words) of uint64 from an Arrow list or binary column of equal widths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(rows, -1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(rows, -1)


def batches_of(table: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in table:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
