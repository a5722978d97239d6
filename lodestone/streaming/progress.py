"""Sample rows as they arrive: running statistics and progress by mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.sinks import replace_rows


def stream_table(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def running_stats(rows: DataFrame, mode: str, value: str) -> DataFrame:
    """Count, mean and deviation so far; an exact median needs all rows and is a batch job."""
    return rows.groupBy(mode).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def start(stats: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return stats.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stats(stats: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The whole result so far as a table, written anew with each batch: a row per group, as many as the stream has groups."""
    return stats.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track(rows: DataFrame, mode: str, at: str, totals: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Progress by mode in a table (mode, completed, total, last_updated), kept while rows arrive.

    Counts and latest times are the stream's state; a batch brings the modes that changed, and their rows are replaced, so a
    batch that is repeated after a restart leaves the same table. ``totals``: (mode, total), null where a mode has none.
    Read the table with ``sinks.read_replaced``. Rows are counted as they come; a sample that is made twice is two rows."""
    running = rows.groupBy(F.col(mode).alias("mode")).agg(F.count("*").alias("completed"), F.max(at).alias("last_updated"))
    known = totals.select(F.col(mode).alias("mode"), "total")

    def batch(df: DataFrame, _: int) -> None:
        replace_rows(df.join(known, "mode", "left").select("mode", "completed", "total", "last_updated"), target, ["mode"], order="completed", buckets=1)

    return running.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_new(rows: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends rows whose keys the target table does not hold; a repeated batch adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(keys)
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
