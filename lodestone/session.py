"""Spark sessions for tests, benches and scripts; on a cluster the given session is used as it is."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "lodestone", cpus: str | None = None, memory: str = "8g") -> SparkSession:
    """A local session with ANSI mode, UTC and adaptive execution."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus if cpus != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one where all runs in this process."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (context.master or "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, and read again by any executor after a loss."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
