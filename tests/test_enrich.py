from pyspark.sql import functions as F

from lodestone.operators import enrich

CODE = """package a.b;
class FooTest {
  @Test void one() { foo.bar(1); new Baz<X>(2); if (x) { qux(); } /* no() */ String s = "not()"; }
  @ParameterizedTest
  void two(int i) throws Exception { a.b().c(); }
  void helper() { never(); }
}"""


def test_calls_and_tests():
    assert [c["signature"] for c in enrich.calls_in('foo.bar(1); new Baz(2); while (x) { qux(); } // no()\n"not()"')] == ["foo.bar", "<init>(Baz)", "qux"]
    assert enrich.calls_in(None) == []
    got = enrich.tests_in("p", CODE)
    assert [(t["test_class"], t["test_method"]) for t in got] == [("a.b.FooTest", "one"), ("a.b.FooTest", "two")]
    assert got[0]["called"] == ["bar", "<init>(Baz)", "qux"] and "never" not in got[1]["called"]


def test_matching_of_results(spark):
    methods = spark.createDataFrame([(0, "src/a/Foo.java", "a.Foo", "get", "int get(int x)", ["int"]), (1, "src/a/Foo.java", "a.Foo", "get", "int get(String s, int y)", ["java.lang.String", "int"]), (2, "src/a/Foo.java", "a.Foo", "put", "void put()", []), (3, "src/b/Bar.java", "b.Bar", "only", "void only()", [])], "ord int, path string, class_fqn string, name string, signature string, params array<string>")
    results = spark.createDataFrame([(1, "src/a/Foo.java", "a.Foo#put"), (2, "a/Foo.java", "get(String, int)"), (3, "x/src/b/Bar.java", "whatever"), (4, "src/a/Foo.java", "get"), (5, None, "x"), (6, "src/a/Foo.java", ""), (7, "q/Zed.java", "x"), (8, "src/a/Foo.java", "zzz")], "result int, path string, id string")
    got = {r["result"]: (r["method_ord"], r["error"]) for r in enrich.match_methods(results, methods).collect()}
    assert got == {1: (2, None), 2: (1, None), 3: (3, None), 4: (1, None), 5: (None, "no path"), 6: (None, "no id"), 7: (None, "no such file"), 8: (1, None)}


def test_overlap_and_comparison(spark):
    row = spark.range(1).select(F.array(F.lit("Foo"), F.lit("String")).alias("query_types"), F.array(F.lit("foo")).alias("query_owners"), F.lit("Bar f(Foo x)").alias("query_signature"), F.expr("array(named_struct('owner', 'Foo', 'method', 'get'), named_struct('owner', 'Zed', 'method', 'x'))").alias("oracle"), F.lit("Foo Baz").alias("type_profile"), F.lit("a.Foo::get(int) x2\nbigram: Foo::get -> Foo::get\n").alias("invocation_profile"), F.lit("Foo g()").alias("signature"), F.lit("card").alias("card"))
    r = enrich.overlap(row).first()
    assert (r["type_iou"], r["owner_iou"], r["shared_types"], r["shared_terms"], r["oracle_recall"]) == (0.5, 1.0, ["foo"], 1, 0.5)
    call = "array<struct<signature: string, resolutionMode: string, orderIndex: int>>"
    df = spark.createDataFrame([([("a.B::m(int)", "EXACT", 0)], [("b.m", "UNRESOLVED", 0)]), ([], [])], f"o {call}, g {call}")
    assert [(x["signature_iou"], x["name_iou"], x["name_recall"], x["primary"]) for x in enrich.compare_calls(df, "o", "g").collect()] == [(0.0, 1.0, 1.0, "name"), (1.0, 1.0, 1.0, "name")]


def test_blocks_of_results(spark):
    df = spark.createDataFrame([(1, 1, "p/A.java", "a.A", "public void f()", "{\n  x();\n}", None), (1, 2, "p/B.java", "a.B", "void g()", None, "content"), (1, 3, "p/C.java", "a.C", "void h()", None, "y" * 400)], "query int, rank int, path string, class_fqn string, signature string, method_body string, content string")
    block = enrich.result_block(df, max_tokens=60).first()["block"]
    assert block == "<|file_sep|>p/A.java\npackage a;\n// class A\nvoid f()\nx();\n<|file_sep|>p/B.java\ncontent"
