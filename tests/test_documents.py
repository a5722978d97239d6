"""Documents read by many tasks: as ``json`` reads them, wherever the splits fall."""

import json
import random

import pytest

from lodestone.sources.documents import read_elements, write_elements

SCHEMA = "name string, body string, parts array<struct<x: int>>"


def made(rng, n):
    bits = ['{"', "}", "]", "[", "\\", '"', '\\"', "é", "🙂", "methods", '"methods": [', "\n", " ", "}}", "\\\\", ","]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    element = lambda: {"name": text(), "body": text(), "parts": [{"x": rng.randint(0, 9)} for _ in range(rng.randint(0, 3))]}
    other = {"projectName": text(), "meta": {"a": {"methods": [{"name": "no"}]}, text(): [1, {"b": "}"}]}, "classpath": [text() for _ in range(3)], "others": [element() for _ in range(rng.randint(0, 4))]}
    items = list(other.items())
    rng.shuffle(items)
    at = rng.randint(0, len(items))
    return dict([*items[:at], ("methods", [element() for _ in range(n)]), *items[at:]])


@pytest.fixture
def tiny_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def to(size):
        for k in keys:
            spark.conf.set(k, str(size))

    yield to
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


@pytest.mark.parametrize(("split", "ascii_only", "indent"), [(37, True, None), (64, False, None), (200, False, 1), (1 << 20, True, 2)])
def test_elements_wherever_splits_fall(spark, tmp_path, tiny_splits, split, ascii_only, indent):
    rng = random.Random(split)
    want = []
    for k, n in enumerate((0, 1, 7, 12)):
        document = made(rng, n)
        (tmp_path / f"{k}.json").write_text(json.dumps(document, ensure_ascii=ascii_only, indent=indent))
        want += [(f"{k}.json", i, e["name"], e["body"], [p["x"] for p in e["parts"]]) for i, e in enumerate(document["methods"])]
    tiny_splits(split)
    got = read_elements(spark, str(tmp_path), "methods", SCHEMA)
    assert sorted((r["file"].rsplit("/", 1)[-1], r["ord"], r["element"]["name"], r["element"]["body"], [p["x"] for p in r["element"]["parts"]]) for r in got.collect()) == sorted(want)


def test_states_met_by_a_shuffle(spark, tmp_path, tiny_splits, monkeypatch):
    import lodestone.sources.documents as documents

    document = made(random.Random(3), 9)
    (tmp_path / "d.json").write_text(json.dumps(document))
    tiny_splits(50)
    monkeypatch.setattr(documents, "FEW", 0)
    got = read_elements(spark, str(tmp_path), "methods", SCHEMA).orderBy("ord").collect()
    assert [(r["ord"], r["element"]["name"]) for r in got] == [(i, e["name"]) for i, e in enumerate(document["methods"])]


def test_one_document_has_many_tasks(spark, tmp_path, tiny_splits):
    (tmp_path / "d.json").write_text(json.dumps({"methods": [{"name": f"m{i}", "body": "x" * 300} for i in range(400)]}))
    tiny_splits(8000)
    found = read_elements(spark, str(tmp_path), "methods", SCHEMA)
    assert found.count() == 400
    from lodestone.sources.documents import _pieces

    assert _pieces(spark, str(tmp_path)).rdd.getNumPartitions() >= 10


@pytest.mark.parametrize("text", ["{}", '{"methods": 3}', '{"methods": {"a": {}}}', '{"a": [{"methods": []}]}', "[]"])
def test_without_the_array(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match="no array of methods"):
        read_elements(spark, str(tmp_path), "methods", SCHEMA)


def test_elements_that_do_not_fit(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"methods": [{"name": "a", "parts": [{"x": "no number"}]}]}')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_elements(spark, str(tmp_path), "methods", SCHEMA).collect()


def test_written_documents(spark, tmp_path):
    for n in (0, 1, 30):
        rows = spark.range(n).selectExpr("'m' || id as name", "'\"}' as body", "array(struct(int(id) as x)) as parts").repartition(4)
        write_elements(rows, str(tmp_path / f"d{n}"), "methods", {"meta": {"n": n}})
        text = "".join(p.read_text() for p in (tmp_path / f"d{n}").glob("part-*"))
        assert json.loads(text)["meta"] == {"n": n} and len(json.loads(text)["methods"]) == n
        assert sorted(r["element"]["name"] for r in read_elements(spark, str(tmp_path / f"d{n}"), "methods", SCHEMA).collect()) == sorted(f"m{i}" for i in range(n))
