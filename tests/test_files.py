"""Sinks and sources of single files, indexes, batches and reports."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import enrich, graph, retrieval
from lodestone.sources import files, readers, sinks

SAMPLES = "mode string, em boolean, es double, codebleu double"


def text_of(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


@pytest.mark.parametrize("n", [0, 1, 25])
def test_records_as_one_array(spark, tmp_path, n):
    path = str(tmp_path / "r.json")
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "x").alias("v")).repartition(3)
    sinks.write_records(df, path, summary=spark.createDataFrame([(n,)], "n int"))
    got = json.loads(text_of(path))
    assert sorted(r["id"] for r in got) == list(range(n)) and all(set(r) == {"id", "v"} for r in got)
    assert json.loads(Path(f"{path}.summary.json").read_text()) == {"n": n}


def test_records_as_lines_and_other_layouts(spark, tmp_path):
    sinks.write_records(spark.range(3), str(tmp_path / "r.jsonl"))
    assert sorted(json.loads(x)["id"] for x in text_of(tmp_path / "r.jsonl").split()) == [0, 1, 2]
    with pytest.raises(ValueError, match="layout"):
        sinks.write_records(spark.range(3), str(tmp_path / "r"), "xml")
    with pytest.raises(ValueError, match="one row"):
        sinks.write_document(spark.range(3), str(tmp_path / "d.json"))


def test_texts_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "a" / "t.txt")
    for text in ("one", "zwei ä"):
        files.write_text(spark, path, text)
        assert files.read_text(spark, path) == text
    assert files.existing(spark, [path, str(tmp_path / "none"), "", path]) == [path, path]


def test_largest_report(spark, tmp_path):
    assert readers.largest_report(spark, str(tmp_path)) is None
    for name, n in (("a/jacoco.xml", 1000), ("b/jacocoTest.xml", 1500), ("c/jacoco.xml", 1500), ("d/other.xml", 9000)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * n)
    assert readers.largest_report(spark, str(tmp_path)).endswith("/b/jacocoTest.xml")
    assert readers.largest_report(spark, str(tmp_path), cached=str(tmp_path / "gone.xml")).endswith("/b/jacocoTest.xml")
    assert readers.largest_report(spark, str(tmp_path), cached=str(tmp_path / "a" / "jacoco.xml")) == str(tmp_path / "a" / "jacoco.xml")


def test_bodies_with_errors(spark, tmp_path):
    entry = {"index": 1, "filePath": "A.java", "fileContent": "class A { void a() { } }", "bodyStartOffset": 19, "bodyEndOffset": 22, "generatedBody": "{ b(); c.d(); }"}
    (tmp_path / "in.json").write_text(json.dumps({"samples": [entry, entry | {"index": 2, "bodyEndOffset": 99}, entry | {"index": 3, "generatedBody": None}]}))
    got = {r["index"]: r for r in enrich.calls_of_bodies(readers.read_bodies(spark, str(tmp_path / "in.json"))).collect()}
    assert [c["signature"] for c in got[1]["invocations"]] == ["b", "c.d"] and got[1]["error"] is None
    assert got[2]["invocations"] == [] and got[2]["error"] == "offsets outside the file" and got[3]["error"] == "no generated body"
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="no array of samples"):
        readers.read_bodies(spark, str(tmp_path / "bad.json")).collect()


def test_index_tables_score_alike(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "b c d"), (3, None)], "doc int, text string")
    posted = retrieval.postings(docs, "doc", F.create_map(F.lit("body"), F.col("text")))
    terms = spark.createDataFrame([(9, "body", 1.0, "body", "b", 1), (9, "body", 1.0, "body", "d", 2)], "query int, clause string, boost double, field string, term string, mult long")
    sinks.write_index(posted, str(tmp_path / "i"))
    kept, stats = readers.read_index(spark, str(tmp_path / "i"))
    rows = lambda df: sorted((r["doc"], round(r["score"], 9)) for r in df.collect())
    assert rows(retrieval.score(terms, kept, stats)) == rows(retrieval.score(terms, posted)) != []


def test_report_files(spark, tmp_path):
    assert readers.read_summary(spark, str(tmp_path)) is None
    rows = spark.createDataFrame([("a", True, 0.5, None), ("a", False, 1.0, None), ("b", None, None, 0.25)], SAMPLES)
    sinks.write_report(rows, "mode", ["a", "b", "c"], ["em", "es", "codebleu"], str(tmp_path))
    got = readers.read_summary(spark, str(tmp_path))
    assert got["a"] == {"sample_count": 2, "em": {"mean": 0.5, "median": 0.5, "std": 0.7071}, "es": {"mean": 0.75, "median": 0.75, "std": 0.3536}, "codebleu": None}
    assert got["b"]["codebleu"] == {"mean": 0.25, "median": 0.25, "std": 0.0} and got["c"]["sample_count"] == 0
    assert json.loads((tmp_path / "a" / "aggregate.json").read_text()) == got["a"]
    assert "| es | 0.7500 (std=0.3536) | N/A | N/A |" in (tmp_path / "comparison_table.txt").read_text() and "2 samples" in (tmp_path / "report.md").read_text()


def test_seeded_pick(spark):
    degree = spark.createDataFrame([(i, i % 3) for i in range(30)], "vertex int, out_degree int").repartition(3)
    able = [i for i in range(30) if i % 3]
    for seed in (1, 42):
        got = [r["vertex"] for r in graph.seeded_pick(degree, "vertex", seed).orderBy("sample_pos").collect()]
        assert got == random.Random(seed).sample(able, 5)
    few = [r["vertex"] for r in graph.seeded_pick(degree.filter("vertex < 6"), "vertex", 3).orderBy("sample_pos").collect()]
    assert few == random.Random(3).sample([1, 2, 4, 5], 4)


def test_method_lines(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"methods": [{"methodName": "a", "usedTypes": ["x"]}, {"methodName": "b"}]}))
    sinks.write_methods(readers.read_methods(spark, str(tmp_path / "doc.json")).drop("ord"), str(tmp_path / "lines"))
    got = readers.read_methods(spark, str(tmp_path / "lines"), lines=True)
    assert sorted((r["methodName"], r["usedTypes"]) for r in got.collect()) == [("a", ["x"]), ("b", [])]


def test_only_tests(spark, tmp_path):
    for name in ("src/main/A.java", "src/test/B.java", "build/C.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class X {}")
    assert [r["path"].rsplit("/", 1)[-1] for r in readers.read_sources(spark, str(tmp_path), only_tests=True).collect()] == ["B.java"]
