"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One space-like byte set, as in ``[\x20\x09-\x0D]``.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where no folder is configured, one is made if all runs in this process (tests); a cluster must name one."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (context.master or "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table: every executor can reread it after a loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of an Arrow batch on its way to a Python worker, while a table is stashed.
BATCH = 2000


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH`` rows, so that whole texts don't add up on either side; the session's own setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table as Parquet in the shared folder and reads it back.

    Columnar and compressed, so it is the choice where text or many rows are kept. The
    folder is scratch space of the cluster; tables there live as long as the application's
    checkpoints do."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stash_path = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Removes stashed tables that no later step reads."""
    for df in kept:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Frees the shuffle files of finished steps. Spark drops them once the driver has collected the plans that made
    them, which a driver with room to spare may not do before the disks of the executors are full."""
    for _ in range(2):  # the first round lets go of Python's handles, the second of what they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def trimmed(kernel):
    """An Arrow kernel that gives freed memory back when its partition ends, as idle workers live on."""

    def run(batches):
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return run


def places(key: str, text: str) -> tuple[F.Column, F.Column]:
    """Two independent hashes of a row's key and text: rows equal in both are copies of each other."""
    return F.xxhash64(F.col(key), F.col(text)), F.xxhash64(F.lit(1), F.col(key), F.col(text))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: file bytes where the plan is a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shards(df: DataFrame, per_shard: int, least: int = 1, most: int = 100_000) -> int:
    """How many shards of about ``per_shard`` input bytes a table of this size needs."""
    return max(least, min(most, input_bytes(df) // per_shard + 1))


def texts(column: pa.Array) -> Iterator[str]:
    """Python strings of a column, null as empty."""
    return ("" if x is None else x for x in column.to_pylist())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_column(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array, natively; null has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))
