"""What a session must offer: the package on the workers' path, and a folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

#: Bytes of the Arrow batches that go to Python workers, unless the session says otherwise: rows with whole texts are large,
#: and a worker holds a batch several times over.
BATCH_BYTES = 8 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", str(64 << 20), str((1 << 31) - 1))

_written: list[tuple[SparkSession, str]] = []


def ready(spark: SparkSession) -> SparkSession:
    """Puts the folder that holds the package on the path of workers that start from now on, and bounds their batches.

    That is enough where executors see the same folder (a local session, a shared file system); elsewhere the
    package is shipped with --py-files or installed.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    if spark.conf.get(_BATCH_KEY, None) in (None, *_BATCH_DEFAULT):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may lack it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints/bitgrove"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settled(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: what follows neither repeats its work nor carries its plan."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session is over; what is left is only disk space
            return


atexit.register(_drop_written)
