"""Sources: method documents, sample trees, coverage and test reports, source trees, request batches, slices."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import jvm_types
from lodestone.sources.documents import read_elements
from lodestone.sources.files import exists, read_text
from lodestone.sources.schemas import METHOD, SAMPLE


def read_methods(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Method rows of extraction documents, with ``ord`` (document, place); missing arrays are empty.

    Only ``methods`` is parsed, by as many tasks as the files have splits (``documents.read_elements``). A document without
    a ``methods`` array is an error. ``lines`` reads a method per line instead (``sinks.write_methods``), and has no ``ord``."""
    if lines:
        rows = spark.read.schema(METHOD).json(path)
        return rows.withColumns({f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in rows.schema.fields if f.dataType.typeName() == "array"})
    found = read_elements(spark, path, "methods", METHOD)
    rows = found.select(F.struct(F.col("file").alias("__file"), F.col("ord")).alias("ord"), "element.*")
    arrays = [f for f in rows.schema.fields if f.dataType.typeName() == "array"]
    return rows.withColumns({f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in arrays})


def read_samples(spark: SparkSession, root: str, modes: list[str] | None = None) -> DataFrame:
    """Sample rows of ``<root>/<mode>/samples/sample_NNN.json`` with ``mode_dir`` and ``sample_index``.

    Malformed files are rows with ``invalid`` true, so that they can be counted."""
    paths = [f"{root}/{m}/samples" for m in modes] if modes else f"{root}/*/samples"
    raw = spark.read.json(paths, multiLine=True, schema=f"{SAMPLE}, _corrupt string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", pathGlobFilter="sample_*.json")
    path = F.col("_metadata.file_path")
    return raw.withColumns({"mode_dir": F.regexp_extract(path, "([^/]+)/samples/[^/]*$", 1), "sample_index": F.expr("try_cast(regexp_extract(_metadata.file_path, 'sample_([0-9]+)[.]json$', 1) AS int)"), "invalid": F.col("_corrupt").isNotNull()}).drop("_corrupt")


def with_verdict(samples: DataFrame) -> DataFrame:
    """Samples with ``compilability`` (success, error_messages, exit_code) from their metrics; null where compilation is unknown."""
    m = lambda c: F.col(f"metrics.{c}")
    verdict = F.struct(m("compilable").alias("success"), F.coalesce(m("compile_errors"), F.array().cast("array<string>")).alias("error_messages"), F.coalesce(m("compile_exit_code"), F.lit(0)).alias("exit_code"))
    return samples.withColumn("compilability", F.when(m("compilable").isNotNull(), verdict))


def read_coverage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(methods, lines) of a coverage report: LINE counters by method, and instructions by source line."""
    counter = "array<struct<_type: string, _missed: int, _covered: int>>"
    schema = f"_name string, class array<struct<_name: string, method: array<struct<_name: string, _desc: string, counter: {counter}>>>>, sourcefile array<struct<_name: string, line: array<struct<_nr: int, _mi: int, _ci: int>>>>"
    packages = spark.read.format("xml").option("rowTag", "package").schema(schema).load(path)
    classes = packages.select(F.posexplode("class").alias("c_ord", "c"))
    methods = classes.select("c_ord", "c._name", F.posexplode("c.method").alias("m_ord", "m"))
    counted = methods.withColumn("k", F.try_element_at(F.filter("m.counter", lambda x: x["_type"] == "LINE"), F.lit(-1))).filter("k is not null")
    types = jvm_types("m._desc")
    method_rows = counted.select(F.translate("_name", "/", ".").alias("class_name"), F.col("m._name").alias("method_name"), types["params"].alias("params"), types["returns"].alias("returns"), F.col("k._covered").alias("covered_lines"), (F.col("k._covered") + F.col("k._missed")).alias("total_lines"), F.struct("c_ord", "m_ord").alias("ord"))
    files = packages.select("_name", F.explode("sourcefile").alias("f"))
    line_rows = files.select(F.concat("_name", F.lit("/"), "f._name").alias("source_key"), F.explode("f.line").alias("l")).select("source_key", F.col("l._nr").alias("line"), F.col("l._ci").alias("covered"), F.col("l._mi").alias("missed"))
    return method_rows, line_rows


def read_test_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(tests_run, tests_failed, failed_test_names) per suite of test reports; unreadable suites are skipped."""
    schema = "_tests int, _failures int, _errors int, testcase array<struct<_classname: string, _name: string, failure: array<string>, error: array<string>>>, _corrupt_record string"
    suites = spark.read.format("xml").option("rowTag", "testsuite").schema(schema).load(paths if isinstance(paths, str) else ",".join(paths)).filter("_corrupt_record is null")
    failed = F.filter(F.coalesce("testcase", F.array()), lambda t: t["failure"].isNotNull() | t["error"].isNotNull())
    zero = lambda c: F.coalesce(c, F.lit(0))
    return suites.select(zero("_tests").alias("tests_run"), (zero("_failures") + zero("_errors")).alias("tests_failed"), F.transform(failed, lambda t: F.concat_ws(".", t["_classname"], t["_name"])).alias("failed_test_names"))


def test_totals(suites: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return suites.agg(zero("tests_run").alias("tests_run"), zero("tests_failed").alias("tests_failed"), F.array_sort(F.flatten(F.collect_list("failed_test_names"))).alias("failed_test_names")).withColumn("tests_passed", F.col("tests_run") - F.col("tests_failed"))


def read_sources(spark: SparkSession, root: str, with_tests: bool = False, glob: str = "*.java", only_tests: bool = False) -> DataFrame:
    """(path, text) of a source tree without build folders and, by default, tests; ``only_tests`` reads just those."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files = files.filter(~F.col("path").rlike("/(?:build|[.]gradle)/"))
    is_test = F.contains("path", F.lit("/src/test/"))
    return files.filter(is_test) if only_tests else files if with_tests else files.filter(~is_test)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Search requests of a batch file (an array of entries)."""
    schema = "request struct<methodSignature: string, classFqn: string, supertypes: array<string>, imports: array<string>, classFields: array<string>, siblingOwnerTypes: array<string>, targetFilePath: string, targetBodyStartOffset: int, topK: int>, targetMethodBody string"
    return spark.read.json(path, multiLine=True, schema=schema).select("request.*", "targetMethodBody")


def read_slices(spark: SparkSession, root: str) -> DataFrame:
    """(slice, sample_index) of slice files; the slice of all is left out."""
    return spark.read.json(root, multiLine=True, schema="name string, indices array<int>", pathGlobFilter="*.json").filter("name <> 'all'").select(F.col("name").alias("slice"), F.explode("indices").alias("sample_index"))


def largest_report(spark: SparkSession, root: str, cached: str | None = None, glob: str = "jacoco*.xml", least: int = 1000) -> str | None:
    """The coverage report to read: a cached one if it exists, else the largest file of that name under ``root``.

    Files of ``least`` bytes or fewer are configuration. Of equal sizes the first path; None without any.
    Only names and lengths are listed, no content is read."""
    if cached and exists(spark, cached):
        return cached
    files = spark.read.format("binaryFile").load(root, recursiveFileLookup=True, pathGlobFilter=glob).select("path", "length")
    found = files.filter(F.col("length") > least).orderBy(F.desc("length"), "path").first()
    return found and found["path"]


def read_summary(spark: SparkSession, root: str) -> dict | None:
    """The ``summary.json`` of a results folder; None if there is none."""
    path = f"{root}/summary.json"
    return json.loads(read_text(spark, path)) if exists(spark, path) else None


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a batch of generated bodies: index, filePath, fileContent, bodyStartOffset, bodyEndOffset, generatedBody.

    A document without a ``samples`` array is an error."""
    entry = "index int, filePath string, fileContent string, bodyStartOffset int, bodyEndOffset int, generatedBody string"
    raw = spark.read.json(path, multiLine=True, schema=f"samples array<struct<{entry}>>")
    return raw.select(F.explode(F.when(F.col("samples").isNull(), F.raise_error(F.lit("no array of samples"))).otherwise(F.col("samples"))).alias("s")).select("s.*")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """(postings, (lengths, terms, fields)) as ``sinks.write_index`` left them, for ``retrieval.score``."""
    postings, lengths, terms, fields = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "lengths", "terms", "fields"))
    return postings, (lengths, terms, fields)


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/vertices"), spark.read.parquet(f"{root}/edges")


#: What a configuration's sections hold where a file does not say.
DEFAULTS = {
    "project": {"fallback_tag": "", "build_system": "gradle", "repo": "", "test_command": ""},
    "extraction": {"require_non_void": False, "require_parameters": False, "require_test_coverage": False, "min_coverage_ratio": 0.0, "require_public": False, "max_file_tokens": 0},
    "llm": {"context_window": 0, "max_concurrent_requests": 1},
    "compilability": {"source_version": "21", "java_home": None},
    "test_evaluation": {"enabled": False, "timeout_seconds": 300, "build_system": "maven"},
}
RETRIEVER_DEFAULTS = {
    "top_k": 5, "max_augmentation_tokens": 2048, "max_results_in_prompt": -1, "max_body_lines": 50, "include_body": True, "near_duplicate_threshold": 0.8,
    "min_score_ratio": 0.3, "retriever_type": "lucene", "external_retriever_class": "", "external_retriever_jars": [], "project_source_roots": [],
}


def load_config(path: str) -> dict:
    """A YAML configuration with its defaults. An old single ``retrieval`` section is the default retriever unless one is named so.

    A negative number of results in the prompt means as many as are fetched."""
    import yaml

    config = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    filled = {name: DEFAULTS.get(name, {}) | (section or {}) if isinstance(section, dict | None) else section for name, section in config.items()}
    filled.setdefault("test_evaluation", dict(DEFAULTS["test_evaluation"]))
    named = config.get("retrievers") or {}
    if "retrieval" in config:
        named = {"default": config["retrieval"]} | named
    made = {name: RETRIEVER_DEFAULTS | (section or {}) for name, section in named.items()}
    filled["retrievers"] = {name: r | {"max_results_in_prompt": r["top_k"]} if r["max_results_in_prompt"] < 0 else r for name, r in made.items()}
    filled.pop("retrieval", None)
    return filled
