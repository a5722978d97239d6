"""Sources of one shape have one tree, and rows of a small table are dealt before sources are spelled from them."""

from pyspark.sql import functions as F

from lodestone.operators import syntax
from lodestone.plans import source_queries

SF = "/root/testdata/sf0.001"
TEXTS = ["class A { int x = 1; }", "class Bcd { int yy = 'c'; }", "class A { int x = y; }", "", None, "#\x01 a \x01b", "1é = .5f; x = é1 + \"a\\"]
WANT = ["class A { int _ = _; }", "class Bcd { int _ = _; }", "class A { int _ = _; }", None, None, "#\x01 _ \x01_", '__ = _; _ = _ + __\\']


def sources(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "path int, text string")


def test_crowded_and_other_shapes(spark):
    for crowd in (0, 1, 1 << 10):  # all broadcast, both ways, none
        got = {r["file"]: r["stripped"] for r in syntax.strip_by_syntax(sources(spark), crowd=crowd).collect()}
        assert got == {i: w for i, w in enumerate(WANT) if w is not None}


def test_one_tree_a_shape(spark, monkeypatch):
    seen, whole = [], syntax._tree
    monkeypatch.setattr(syntax, "_tree", lambda tokens: seen.append(tokens) or whole(tokens))
    syntax.strip_by_syntax(sources(spark)).collect()
    assert [x.select("file").distinct().count() for x in seen] == [4]


def test_sources_are_dealt_first(spark):
    for rows in (source_queries._sources(spark, SF), source_queries._sources(spark, SF).filter(F.length("text") > 0)):
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
