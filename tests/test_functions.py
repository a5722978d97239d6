import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import kernels, metrics, text

CASES = ["int x = 1; // c\n/* b\n */ y", "", "  a  \n\n b\t c ", "fooé_1 2.5 'q'", "http://x 漢字 é😀"]


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def many(spark, expr, rows, schema):
    return [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", expr.alias("x")).orderBy("i").collect()]


def test_normalisation(spark):
    assert many(spark, text.normalize_code("c"), [(c,) for c in CASES], "c string") == ["int x = 1;\ny", "", "a\nb c", "fooé_1 2.5 'q'", "http:"]


def test_tokens(spark):
    assert many(spark, text.tokens("c"), [(c,) for c in CASES[2:4]], "c string") == [["a", "b", "c"], ["fooé_1", "2.5", "'", "q", "'"]]
    assert one(spark, text.tokens("c", True), c="fooé") == ["foo", "é"]
    assert many(spark, text.count_tokens("c"), [("",), ("a b",), ("_é",)], "c string") == [1, 3, 1]


def test_signatures(spark):
    cases = [("a.B::m(x.Y,  int) ->  boolean", "a.B::m(x.Y,int) -> boolean"), ("A::<init>() -> A", "A::<init>() -> A"), ("a::f( )", "a::f( )"), ("A::g(Map<K, V>) -> X", "A::g(Map<K,V>) -> X")]
    assert many(spark, text.canonical_invocation("s"), [(a,) for a, _ in cases], "s string") == [b for _, b in cases]
    assert one(spark, text.vertex_id("c", "n", F.array(F.lit("java.lang.String"), F.lit("int")), F.lit("boolean")), c="Foo", n="bar") == "Foo::bar(java.lang.String,int) -> boolean"
    assert one(spark, text.vertex_id("c", "n", F.array().cast("array<string>"), F.lit(None).cast("string")), c="Foo", n="bar") == "Foo::bar() -> void"
    assert one(spark, text.short_invocation("s"), s="a.b.Foo::bar(int)") == "Foo::bar"
    assert one(spark, text.invocation_method("s"), s="a.b.Foo::bar(int)") == "bar"
    assert one(spark, text.invocation_method("s"), s="bar") == ""
    assert many(spark, text.call_simple_name("s"), [("UNRESOLVED<x>",), ("a::b(c)",), ("o.m",)], "s string") == ["x", "b", "m"]
    assert one(spark, text.simplify_signature("s"), s="public java.util.List f(a.b.C c)") == "List f(C c)"


def test_names(spark):
    assert many(spark, text.simple_name("s"), [("a.B<c.D>",), ("B",)], "s string") == ["B", "B"]
    assert many(spark, text.class_simple_name("s"), [("a.FooTests",), ("a.FooTest",), ("a.FooIT",), ("a.Test",), ("a.Foo$Bar",)], "s string") == ["Foo", "Foo", "Foo", "Test", "Foo"]
    assert many(spark, text.test_class_of_path("s"), [("m/src/test/java/a/FooTest.java",), ("x/Foo.java",)], "s string") == ["a.FooTest", None]
    assert tuple(one(spark, text.failed_test("s"), s="a.FooTest.bar(int)[1]")) == ("a.FooTest", "bar")
    assert many(spark, text.module_of_path("s"), [("core/src/A.java",), ("src/A.java",), ("A.java",)], "s string") == ["core", None, None]
    assert many(spark, text.package_of("s"), [("a.b.C",), ("C",)], "s string") == ["a.b", "(default)"]
    assert one(spark, text.line_of_offset("c", F.lit(4)), c="a\nb\nc") == 3
    assert one(spark, text.type_tokens("s"), s="List<Foo> bar FooBar Ab") == ["list", "foo", "foobar"]
    assert one(spark, text.query_terms(F.array("s")), s="getFoo public Bar ab") == ["getfoo", "bar"]
    many_ids = many(spark, text.short_id("s", 5), [("abcdef",), ("abc",)], "s string")
    assert many_ids == ["abcd…", "abc"]


def test_descriptors(spark):
    got = many(spark, text.jvm_types("d"), [("(I[Ljava/lang/String;)V",), ("()[[J",), ("bad",)], "d string")
    assert [(r["params"], r["returns"]) for r in got] == [(["int", "java.lang.String[]"], "void"), ([], "long[][]"), ([], "void")]


def test_paths(spark):
    got = many(spark, text.path_is_suffix("a", "b"), [("x/y/A.java", "y/A.java"), ("A.java", "BA.java"), ("x\\A.java", "x/A.java"), ("a", "b")], "a string, b string")
    assert got == [True, False, True, False]


def test_stripping_and_cut(spark):
    assert one(spark, text.strip_identifiers("c"), c='int foo = bar(1, "s", null); Type t;') == "int _ = _(_, _, _); Type _;"
    assert one(spark, text.cut_completion("c"), c="x = 1;  \n<|endoftext|>rest") == "x = 1;"


def test_record_hash(spark):
    import hashlib
    import json

    want = hashlib.sha256(json.dumps({"generated": 'a"b\n', "method_id": "m"}, sort_keys=True).encode()).hexdigest()
    assert one(spark, text.record_hash("g", "m"), g='a"b\n', m="m") == want


def brute_lcs(a, b):
    best = 0
    for n in range(len(a), 0, -1):
        for pick in itertools.combinations(range(len(a)), n):
            it = iter(b)
            if all(a[i] in it for i in pick):
                return n
    return best


def test_sequence_kernels():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        n = brute_lcs(a, b)
        assert kernels.lcs_length(a, b) == n
        back = kernels.lcs_tokens(a, b)
        assert len(back) == n and all(x in it for it in [iter(a)] for x in back) and all(x in it for it in [iter(b)] for x in back)
        runs = [b[i:j] for i in range(len(b)) for j in range(i + 1, len(b) + 1) if any(a[k : k + j - i] == b[i:j] for k in range(len(a)))]
        common = kernels.common_substring(a, b)
        assert len(common) == max(map(len, runs), default=0) <= n and (not common or common in runs)


def test_identifier_unification(spark):
    assert one(spark, text.unify_identifiers("c"), c="int b = a; String c; Foo d = b; int var1 = 2;") == "int var1 = a; String var2; Foo var3 = var1; int var4 = 2;"
    assert one(spark, text.unify_identifiers("c"), c="x + y") == "x + y" and one(spark, text.unify_identifiers("c"), c="var permits = 1;") == "var permits = 1;"


def test_declared_names_are_found_once_a_row(spark):
    rows = spark.createDataFrame([("int b = a; " * 3,)], "c string").select(text.unify_identifiers("c").alias("u"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("|boolean|") == 1  # else anew for each word
    assert rows.first()["u"] == "int var1 = a; " * 3
    assert rows.select(text.unify_identifiers(F.lit(None).cast("string"))).first()[0] is None and one(spark, text.unify_identifiers("c"), c="") == ""


def test_body_block(spark):
    assert one(spark, text.body_block("c"), c="{\n\n    a();\n      b();\n\n}") == "a();\n  b();"
    assert one(spark, text.body_block("c"), c="{ }") is None and one(spark, text.body_block("c"), c="  {\n  if (x) {\n\n  }\n }\n") == "if (x) {\n\n}"
    assert one(spark, text.body_block("c", 2), c="{\na\nb\nc\n}") == "a\nb\n    // ..."


def test_failed_test_names(spark):
    got = many(spark, text.failed_test("n"), [("pkg.FooTests.test[1]",), ("FooTest",), ("a.b.run(int)",), ("a.B.",)], "n string")
    assert [(r["test_class"], r["test_method"]) for r in got] == [("pkg.FooTests", "test"), ("FooTest", None), ("a.b", "run"), ("a.B", None)]


def test_knapsacks():
    assert kernels.pick_within([1, 3, 2], [4, 5, 9], 9) == [0, 1]
    assert kernels.pick_within([1, 3, 2], [4, 5, 9], 9, stop=True) == [1]


def test_seeded_order_matches_shuffle():
    items = list("abcdef")
    random.Random(7).shuffle(items)
    assert [list("abcdef")[i] for i in kernels.seeded_order(6, 7)] == items


def test_similarities(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abé😀") for _ in range(rng.randint(0, 6))), "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 6)))) for _ in range(60)]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    got = many(spark, metrics.edit_similarity("a", "b"), rows, "a string, b string")
    assert got == pytest.approx([1 - lev(a, b) / max(len(a), len(b)) if a or b else 1.0 for a, b in rows])
    split = [(sorted(a), sorted(b)) for a, b in rows]
    iou = [1.0 if not a and not b else (Counter(a) & Counter(b)).total() / (Counter(a) | Counter(b)).total() for a, b in split]
    assert many(spark, metrics.token_iou_sorted(F.sort_array("a"), F.sort_array("b")), split, "a array<string>, b array<string>") == pytest.approx(iou)


def test_retrieval_metrics(spark):
    assert one(spark, metrics.ndcg(F.array(F.lit(1.0), F.lit(2.0)))) == pytest.approx((1 + 2 / 1.5849625) / (2 + 1 / 1.5849625))
    assert one(spark, metrics.ndcg(F.array(F.lit(0.0)))) == 0.0
    results = F.array(F.struct(F.lit(2).alias("rank"), F.lit(0.5).alias("similarity")))
    assert one(spark, metrics.mean_reciprocal_rank(results)) == 0.5
    empty = F.array().cast("array<string>")
    assert one(spark, metrics.set_iou(empty, empty)) == 0.0 and one(spark, metrics.set_iou(empty, empty, 1.0)) == 1.0
    calls = F.array(F.struct(F.lit("Foo").alias("owner"), F.lit("get").alias("method")), F.struct(F.lit("Bar").alias("owner"), F.lit("x").alias("method")))
    assert one(spark, metrics.invocation_recall(calls, F.lit("foo target"))) == 0.5
    assert one(spark, metrics.invocation_recall(calls, F.lit(""))) == 0.0


def test_pearson_needs_three_rows_and_spread(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 1.0, 1.0), ("c", 1.0, 5.0), ("c", 1.0, 6.0), ("c", 1.0, 7.0)], "k string, x double, y double")
    got = {r["k"]: r["r"] for r in df.groupBy("k").agg(metrics.pearson("x", "y").alias("r")).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 0.0, "c": 0.0})


def test_common_subsequence_takes_the_walk_of_the_full_table():
    def full(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        i, j, out = len(a), len(b), []
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j, out = i - 1, j - 1, [a[i - 1], *out]
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out

    rng = random.Random(1)
    for _ in range(400):
        a, b = (rng.choices("abcd", k=rng.randint(0, 25)) for _ in range(2))
        assert kernels.lcs_tokens(a, b) == full(a, b)
    long = [rng.randrange(50) for _ in range(20_000)]
    assert len(kernels.lcs_tokens(long, long[::-1])) == kernels.lcs_length(long, long[::-1])


def test_unified_pages_look_for_names_once(spark):
    from lodestone.plans.queries import QUERIES

    plan = QUERIES["unified_identifiers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|boolean|byte|char|short|String") == 1


def test_arrays_are_sorted_once_a_merge(spark):
    rows = spark.createDataFrame([(["b", "a", "b"], ["b", "c", "b", "a"])], "a array<string>, b array<string>")
    made = rows.select(metrics.common_sorted(F.sort_array("a"), F.sort_array("b")).alias("n"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("sort_array(") == 2 and made.first()["n"] == 3  # else anew for each step
