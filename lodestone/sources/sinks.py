"""Sinks. Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

import hashlib
import json

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import analysis
from lodestone.operators.retrieval import index_stats
from lodestone.session import stored
from lodestone.sources.files import exists, write_text


#: The statistics beside an index's postings: lengths of documents, counts of terms, totals of fields.
INDEX_TABLES = ("lengths", "terms", "fields")


def write_samples(df: DataFrame, path: str, drop: tuple[str, ...] = ("prompt",)) -> None:
    """JSON rows by mode; large text columns can be left out."""
    df.drop(*drop).write.mode("overwrite").partitionBy("mode").json(path)


def write_records(df: DataFrame, path: str, layout: str | None = None, summary: DataFrame | None = None) -> None:
    """JSON lines, or for names other than ``*.jsonl`` one JSON array, nulls included.

    The array is one file by nature: its rows pass through one task a row at a time, none is
    gathered. Lines are the layout for large results. ``summary``, a table of one row, is
    written to ``<path>.summary.json``."""
    layout = layout or ("jsonl" if path.endswith(".jsonl") else "json")
    if layout == "jsonl":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif layout == "json":
        rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        listed = rows.unionByName(df.sparkSession.createDataFrame([(None,)], "row string")).coalesce(1)
        placed = listed.withColumn("first", F.monotonically_increasing_id() == 0)  # in one partition the numbers are places
        placed.select(F.when(F.col("row").isNull(), F.when(F.col("first"), "[]").otherwise("]")).otherwise(F.concat(F.when(F.col("first"), "[").otherwise(","), "row")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no such layout: {layout}")
    if summary is not None:
        write_document(summary, f"{path.rstrip('/')}.summary.json")


def write_document(df: DataFrame, path: str) -> None:
    """A table of one row as one JSON document: a data set's index, a response, a summary."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).take(2)
    if len(rows) != 1:
        raise ValueError("a document is exactly one row")
    write_text(df.sparkSession, path, rows[0].value)


def write_methods(methods: DataFrame, path: str) -> None:
    """Method rows as JSON lines, a file per partition, which ``read_methods(..., lines=True)`` splits among tasks."""
    methods.write.mode("overwrite").json(path)


def write_slices(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("slice").json(path)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_index(posted: DataFrame, path: str) -> None:
    """Postings, sorted by field and term so that a lookup reads few row groups, and the statistics that scores need.

    Written anew as a whole; the statistics are counted from the written postings."""
    posted.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/postings")
    kept = posted.sparkSession.read.parquet(f"{path}/postings")
    for name, table in zip(INDEX_TABLES, index_stats(kept), strict=True):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def replace_rows(rows: DataFrame, path: str, keys: Sequence[str], order: str | None = None, buckets: int = 64) -> None:
    """Rows into a table that holds one row for each key: those of keys that it has are replaced, others are added.

    Of several new rows of a key the last by ``order`` is taken (of equal ones, that of the greatest hash). The table is
    dealt into ``buckets`` folders by its keys, and only those that a batch touches are read, merged and overwritten, so a batch that is
    replayed, in whole or after half of it was written, leaves the same table. Null keys are keys. Another number of buckets than
    the table's is an error. An empty batch changes nothing."""
    spark, bucket = rows.sparkSession, f"bucket_of_{buckets}"
    ordered = [*([F.col(order).desc_nulls_last()] if order else []), F.xxhash64(*rows.columns).desc()]
    latest = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered))).filter("__n = 1").drop("__n")
    new = stored(latest.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    touched = [r[0] for r in new.select(bucket).distinct().collect()]  # ``buckets`` numbers at most
    if not touched:
        return
    if exists(spark, path):
        old = spark.read.parquet(path)
        if bucket not in old.columns:
            raise ValueError(f"{path} is not dealt into {buckets} buckets")
        marked = new.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(bucket).alias("__b"))
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        kept = old.filter(F.col(bucket).isin(touched)).join(marked, [F.col(bucket) == F.col("__b"), *same], "left_anti")
        new = stored(kept.unionByName(new, allowMissingColumns=True))  # read in full before its folders are overwritten
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def read_replaced(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table of ``replace_rows``."""
    table = spark.read.parquet(path)
    return table.drop(*(c for c in table.columns if c.startswith("bucket_of_")))


def manifest(config: dict) -> str:
    """Content address of a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, root: str, config: dict, make) -> DataFrame:
    """The table of a configuration: read if it was completed before, else made and written."""
    path = f"{root}/{manifest(config)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def markdown_table(rows: list[dict]) -> str:
    """A small result as a Markdown table; null as ``N/A``, numbers with four places."""
    if not rows:
        return ""
    show = lambda v: "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    names = list(rows[0])
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows)])


def report(stats: DataFrame) -> str:
    """Markdown of a table of statistics: a row per mode and metric."""
    return markdown_table([r.asDict() for r in stats.collect()])


def write_report(samples: DataFrame, mode: str, modes: Sequence[str], metrics: Sequence[str], root: str) -> None:
    """``<mode>/aggregate.json``, ``summary.json``, ``comparison_table.txt`` and ``report.md`` under a folder.

    Statistics are computed once, by mode and metric; only they (modes x metrics rows) reach the
    driver. A metric without values in a mode is null there and ``N/A`` in tables."""
    spark = samples.sparkSession
    stats = analysis.long_stats(samples, mode, metrics).collect()
    counts = {r[0]: r["n"] for r in samples.groupBy(mode).agg(F.count("*").alias("n")).collect()}
    found = {(r[mode], r["metric"]): {x: round(r[f"v_{x}"], 4) for x in ("mean", "median", "std")} for r in stats if r["n"]}
    summary = {m: {"sample_count": counts.get(m, 0)} | {x: found.get((m, x)) for x in metrics} for m in modes}
    show = lambda s: "N/A" if s is None else f"{s['mean']:.4f} (std={s['std']:.4f})"
    table = markdown_table([{"Metric": x} | {m: show(summary[m][x]) for m in modes} for x in metrics])
    for m in modes:
        write_text(spark, f"{root}/{m}/aggregate.json", json.dumps(summary[m], indent=2))
    write_text(spark, f"{root}/summary.json", json.dumps(summary, indent=2))
    write_text(spark, f"{root}/comparison_table.txt", table)
    write_text(spark, f"{root}/report.md", "\n".join(["# Results", "", *(f"- {m}: {counts.get(m, 0)} samples" for m in modes), "", table, ""]))
