"""Sources that differ in names, literals and comments alone are taken apart once; names are put back and resolved across all sources."""

import pytest

from lodestone.operators import syntax
from lodestone.plans import source_queries

IN = "class {0} {{ class {1} {{ class In {{ In() {{ }} }} }} class {2} {{ class In {{ In() {{ }} }} }} void m() {{ new In(); }} }}"
TEXTS = {
    "a": "package p; class A { void run(Q q) { add(1); new Box(2); q.go(); } int add(int n) { return n; } }",
    "b": "package p; class Bé { void x1_(R x9_) { sum(7); new Hut('{'); x9_.at(); } /* { */\n int sum(int m) { return m; } }",
    "c": "package p; class Box { Box(int n) { } }",
    "d": IN.format("D", "Z", "Y"),
    "e": IN.format("E", "B", "C"),
    "none": None,
    "empty": "// no token",
}
WANT = {
    ("a", "void run(Q q)"): ["p.A::add(int) -> int", "p.Box::<init>(int) -> p.Box", "UNRESOLVED<go>"],
    ("b", "void x1_(R x9_)"): ["p.Bé::sum(int) -> int", "UNRESOLVED<<init>(Hut)>", "UNRESOLVED<at>"],
    ("d", "void m()"): ["D.Y.In::<init>() -> D.Y.In"],
    ("e", "void m()"): ["E.B.In::<init>() -> E.B.In"],
}


def sources(spark):
    return spark.createDataFrame(list(TEXTS.items()), "path string, text string").repartition(3)


@pytest.mark.parametrize("crowd", [0, 1, 1 << 10])  # all broadcast, both ways, none
def test_names_are_put_back(spark, crowd):
    rows = {(r["filePath"], r["classFqn"], r["methodSignature"]): r for r in syntax.extract(sources(spark), crowd=crowd).collect()}
    assert len(rows) == 11
    assert {(f, s): [i["signature"] for i in r["invocations"]] for (f, _, s), r in rows.items() if r["invocations"]} == WANT
    assert rows["b", "p.Bé", "int sum(int m)"]["methodBody"] == "{ return m; }" and rows["b", "p.Bé", "int sum(int m)"]["bodyStartOffset"] == TEXTS["b"].index("{ return")


def test_one_tree_a_shape(spark, monkeypatch):
    seen, whole = [], syntax._tree
    monkeypatch.setattr(syntax, "_tree", lambda tokens: seen.append(tokens) or whole(tokens))
    syntax.extract(sources(spark))
    assert [x.select("file").distinct().count() for x in seen] == [3]


def test_extracted_methods_have_one_tree(spark, monkeypatch):
    seen, whole = [], syntax._tree
    monkeypatch.setattr(syntax, "_tree", lambda tokens: seen.append(tokens) or whole(tokens))
    source_queries.extracted_methods(spark, "/root/testdata/sf0.001")
    assert [x.select("file").distinct().count() for x in seen] == [1]


def test_bodies_in_place_have_one_tree(spark, monkeypatch):
    seen, whole = [], syntax._tree
    monkeypatch.setattr(syntax, "_tree", lambda tokens: seen.append(tokens) or whole(tokens))
    source_queries.body_calls_in_place(spark, "/root/testdata/sf0.001")
    assert [x.select("file").distinct().count() for x in seen] == [1]
