"""Single small files through Spark's file systems, so that a path may lie in any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _at(spark, path)
    return store.exists(place)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, in order: a class path without entries that are gone."""
    return [p for p in paths if p and exists(spark, p)]


def read_text(spark: SparkSession, path: str) -> str:
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then moved there, so that readers never see half of it."""
    place, store = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.new")
    out = store.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    store.delete(place, False)
    if not store.rename(beside, place):
        raise OSError(f"could not write {path}")
