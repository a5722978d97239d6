import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import analysis, dataset, graph, mining, plugins, prompt, retrieval
from lodestone.sources import readers, sinks
from lodestone.sources.schemas import METHOD, SAMPLE


def inv(signature, mode="EXACT", order=0):
    return {"signature": signature, "resolutionMode": mode, "orderIndex": order}


def method(**k):
    base = {"filePath": "a/Foo.java", "fileContent": "class Foo { void bar() { } }", "classFqn": "com.x.Foo", "methodSignature": "public void bar()", "methodName": "bar", "methodBody": "{ }", "bodyStartOffset": 24, "bodyEndOffset": 27, "statementCount": 3, "category": "NORMAL", "invocations": [], "parameterTypes": [], "returnType": None, "siblingMethods": [], "usedTypes": [], "imports": [], "classFields": [], "supertypes": [], "thrownExceptions": []}
    return base | k


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[x.split(" ")[0]] for x in METHOD.split(", ") if x.split(" ")[0] in r) for r in rows], METHOD) if False else spark.read.schema(METHOD).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


@pytest.fixture(scope="module")
def two_methods(spark):
    helper = {"signature": "void helper()", "methodName": "helper", "parameterTypes": [], "returnType": "void", "invocations": [inv("com.x.Foo::bar() -> void")], "usedTypes": []}
    bar = {"signature": "void bar()", "methodName": "bar", "parameterTypes": [], "returnType": "void", "invocations": [], "usedTypes": []}
    rows = [
        method(returnType="void", invocations=[inv("com.x.Foo::helper() -> void"), inv("com.x.Foo::helper() ->  void", order=1), inv("java.util.List::size() -> int", order=2), inv("zzz", "UNRESOLVED", 3)], siblingMethods=[helper]),
        method(methodName="helper", returnType="void", siblingMethods=[bar]),
    ]
    return frame(spark, rows).withColumn("ord", F.monotonically_increasing_id()).coalesce(1)


def test_graph(two_methods, spark, tmp_path):
    v = graph.flatten_vertices(two_methods, "ord")
    e = graph.edges(v)
    assert [(r["idx"], r["vertex_id"], len(r["invocations"])) for r in v.orderBy("idx").collect()] == [(0, "com.x.Foo::bar() -> void", 4), (1, "com.x.Foo::helper() -> void", 1)]
    assert {(r["src"][11:14], r["dst"][11:14], r["weight"]) for r in e.collect()} == {("bar", "hel", 2), ("hel", "bar", 1)}
    assert {(r["src_idx"], r["dst_idx"], r["weight"]) for r in graph.adjacency(v, e).collect()} == {(0, 1, 2), (1, 0, 1)}
    d = graph.degrees(v, e)
    s = graph.stats(d, e).first()
    assert (s["n_vertices"], s["n_edges"], s["total_weight"], s["n_self_loops"], s["n_isolated"], s["density"]) == (2, 2, 3, 0, 0, 0.5)
    assert all(r["ok"] for r in graph.sanity(v, e).collect())
    sinks.write_graph(v, e, str(tmp_path / "g"))
    v2, e2 = readers.read_graph(spark, str(tmp_path / "g"))
    assert v2.count() == 2 and e2.agg(F.sum("weight")).first()[0] == 3
    bad = e.unionByName(e.limit(1)).unionByName(spark.createDataFrame([("q", "r", -1)], "src string, dst string, weight long"))
    assert {r["check_name"] for r in graph.sanity(v, bad).filter("not ok").collect()} == {"ends_known", "weights_positive", "pairs_unique"}


def test_histogram_of_equal_values(spark):
    assert [tuple(r) for r in graph.histogram(spark.createDataFrame([(5,), (5,)], "v int"), "v").collect()] == [(0, 5.0, 5.0, 2)]


def sample(index, **k):
    base = {"method_id": "com.x.Foo#bar", "mode": "a", "generated": "x", "ground_truth": "y", "metrics": {"em": False, "es": 0.5, "compilable": True}, "test_eval": {"success": False, "tests_failed": 1, "failed_test_names": ["com.x.FooTest.testBar"], "build_success": True}, "test_file_paths": ["src/test/java/com/x/FooTest.java"], "direct_test_methods": [{"test_file": "src/test/java/com/x/FooTest.java", "test_class": "FooTest", "test_method": "testBar"}], "coverage_ratio": None}
    return {**base, **k, "ord": index}


def samples(spark, rows):
    return spark.read.schema(f"{SAMPLE}, ord int").json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 1))


def test_mining_keeps_with_reasons_in_order(spark):
    kept, counts = mining.mine_failures(samples(spark, [sample(0)]), "ord")
    r = kept.first()
    assert r["relation_score"] == 8 and r["related"][0]["reasons"] == ["direct_test_method", "referenced_test_file", "target_class_test_class_match", "method_name_overlap"]
    assert counts.count() == 0


def test_mining_rejects_with_counts(spark):
    ok = sample(0)
    rows = [sample(0, metrics=ok["metrics"] | {"compilable": False}), sample(1, metrics=ok["metrics"] | {"em": True}), sample(2, test_eval=ok["test_eval"] | {"success": True}), sample(3, test_eval=ok["test_eval"] | {"build_success": False}), sample(4, test_eval=None), sample(5, test_eval=ok["test_eval"] | {"failed_test_names": []})]
    kept, counts = mining.mine_failures(samples(spark, rows), "ord")
    assert kept.count() == 0 and {r["reason"]: r["n"] for r in counts.collect()} == dict.fromkeys(["not_compilable_or_unchecked", "exact_match_or_unchecked", "tests_passed", "test_build_failed", "missing_test_eval", "test_command_failed_without_failed_tests"], 1)


def test_mining_requires_relation(spark):
    other = sample(0)["test_eval"] | {"failed_test_names": ["org.Other.test"]}
    kept, counts = mining.mine_failures(samples(spark, [sample(0, test_eval=other), sample(1)]), "ord", require_related=True)
    assert [r["ord"] for r in kept.collect()] == [1] and counts.first()["reason"] == "unrelated_test_failure"


@pytest.mark.parametrize(("dedupe", "n"), [("method_generated", 1), ("generated", 1), ("none", 2)])
def test_mining_dedupes(spark, dedupe, n):
    kept, counts = mining.mine_failures(samples(spark, [sample(0), sample(1, mode="b")]), "ord", dedupe=dedupe)
    assert kept.count() == n and counts.count() == 2 - n


def test_cascade_order_and_reasons(spark):
    rows = [method(category="TEST", statementCount=0), method(statementCount=1), method(), method(invocations=[inv("a", "UNRESOLVED")]), method(invocations=[inv("a")])]
    got = dataset.cascade(frame(spark, rows), dataset.method_reasons())
    assert [r["reject_reason"] for r in got.collect()] == ["category", "statements", "no_invocations", "not_exact", None]
    strict = dataset.cascade(frame(spark, rows[-1:]), dataset.method_reasons(public_only=True, no_void=True, need_params=True))
    assert strict.first()["reject_reason"] == "void"


def test_seeded_sample_is_the_library_sample(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 3).repartition(7)
    got = [r["id"] for r in dataset.seeded_sample(df, ["id"], 20, 42).orderBy("sample_pos").collect()]
    assert got == random.Random(42).sample(range(1000), 20)
    assert dataset.seeded_sample(df.limit(3), ["id"], 20, 42).count() == 3


def test_coverage_and_lines(spark, tmp_path):
    (tmp_path / "r.xml").write_text("""<report name="r"><package name="com/x"><class name="com/x/Foo"><method name="bar" desc="(Ljava/util/List;)V"><counter type="LINE" missed="1" covered="3"/></method>
    <method name="bar" desc="()V"><counter type="BRANCH" missed="1" covered="0"/><counter type="LINE" missed="2" covered="0"/></method></class><sourcefile name="Foo.java"><line nr="3" mi="0" ci="2"/><line nr="9" mi="1" ci="0"/></sourcefile></package></report>""")
    m, lines = readers.read_coverage(spark, str(tmp_path / "r.xml"))
    assert {(r["class_name"], tuple(r["params"]), r["covered_lines"], r["total_lines"]) for r in m.collect()} == {("com.x.Foo", ("java.util.List",), 3, 4), ("com.x.Foo", (), 0, 2)}
    rows = frame(spark, [method(parameterTypes=["java.util.List<String>"]), method(), method(methodName="none")])
    got = {(len(r["parameterTypes"]), r["methodName"]): (r["is_covered"], r["coverage_ratio"]) for r in dataset.join_coverage(rows, m).collect()}
    assert got == {(1, "bar"): (True, 0.75), (0, "bar"): (False, 0.0), (0, "none"): (False, None)}
    spans = spark.createDataFrame([("m", "com/x/Foo.java", 2, 8)], "method_id string, source_key string, first_line int, last_line int")
    assert [tuple(x) for x in dataset.line_coverage(spans, lines).first()["lines"]] == [(3, 2, 0)]


def test_test_reports(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<testsuite tests="3" failures="1" errors="1"><testcase classname="A" name="x"><failure>f</failure></testcase><testcase classname="A" name="y"><error>e</error></testcase><testcase classname="A" name="z"/></testsuite>')
    r = readers.test_totals(readers.read_test_reports(spark, str(tmp_path))).first()
    assert (r["tests_run"], r["tests_failed"], r["tests_passed"], r["failed_test_names"]) == (3, 2, 1, ["A.x", "A.y"])


def test_sample_tree(spark, tmp_path):
    for mode in ("a", "b"):
        (tmp_path / mode / "samples").mkdir(parents=True)
        (tmp_path / mode / "samples" / "sample_007.json").write_text(json.dumps(sample(0, mode=mode), indent=1))
    (tmp_path / "a" / "samples" / "sample_008.json").write_text("{broken")
    got = readers.read_samples(spark, str(tmp_path))
    assert {(r["mode_dir"], r["sample_index"], r["invalid"]) for r in got.collect()} == {("a", 7, False), ("b", 7, False), ("a", 8, True)}
    assert readers.read_samples(spark, str(tmp_path), ["b"]).count() == 1
    sinks.write_samples(got.filter("not invalid").select("mode", "method_id", "prompt"), str(tmp_path / "out"))
    assert "prompt" not in spark.read.json(str(tmp_path / "out")).columns


def test_method_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"projectName": "p", "meta": {"x": 1}, "methods": [{"methodName": "a"}, {"methodName": "b", "imports": ["q"]}]}))
    rows = readers.read_methods(spark, str(tmp_path / "m.json")).orderBy("ord").collect()
    assert [(r["methodName"], r["imports"], r["returnType"]) for r in rows] == [("a", [], None), ("b", ["q"], None)]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="no array of methods"):
        readers.read_methods(spark, str(tmp_path / "bad.json")).collect()


def test_source_tree_and_cache(spark, tmp_path):
    for p in ("m/src/main/A.java", "m/src/test/B.java", "m/build/C.java"):
        (tmp_path / "s" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "s" / p).write_text("class X {}\n")
    assert readers.read_sources(spark, str(tmp_path / "s")).count() == 1
    assert readers.read_sources(spark, str(tmp_path / "s"), with_tests=True).count() == 2
    calls = []
    for _ in range(2):
        got = sinks.cached(spark, str(tmp_path / "c"), {"a": 1}, lambda: calls.append(1) or spark.range(3))
    assert got.count() == 3 and len(calls) == 1


def test_comparison_text(spark):
    lines = spark.createDataFrame([("+---+",), ("| es | 0.45 (std=0.10) | N/A |",)], "value string")
    assert [tuple(r) for r in analysis.parse_table(lines).orderBy("position").collect()] == [("es", 0, 0.45, 0.1), ("es", 1, None, None)]


def test_helped_is_strict(spark):
    df = spark.createDataFrame([(0.02,), (0.021,), (-0.02,), (-0.03,), (None,)], "d double").select(analysis.helped(F.col("d")).alias("h"))
    assert [r["h"] for r in df.collect()] == ["neutral", "helped", "neutral", "hurt", "unknown"]


def test_profiles_and_search(spark):
    rows = frame(spark, [method(filePath="p/A.java", classFqn="redis.Conn", methodName="connect", usedTypes=["net.Socket"], invocations=[inv("net.Socket::open()", order=1), inv("net.Socket::open()", order=2), inv("net.Socket::read()", order=3)]), method(filePath="p/B.java", classFqn="cache.Manager", methodName="get", usedTypes=["cache.Store"])])
    profile = rows.select(retrieval.invocation_profile().alias("p")).collect()
    assert profile[0]["p"] == "net.Socket::open() x2\nnet.Socket::read()\nbigram: Socket::open -> Socket::open\nbigram: Socket::open -> Socket::read\ntrigram: Socket::open -> Socket::open -> Socket::read\n" and profile[1]["p"] == ""
    docs = retrieval.index_documents(rows)
    requests = spark.createDataFrame([(1, "void f(Socket s)", "x.Y", [], ["net.Socket"], [], ["Socket"]), (2, None, "x.Manager", [], [], [], [])], "query int, methodSignature string, classFqn string, supertypes array<string>, imports array<string>, classFields array<string>, siblingOwnerTypes array<string>")
    scored = retrieval.score(retrieval.build_query_terms(requests), retrieval.postings(docs, "doc_id", F.col("fields")))
    found = scored.join(docs.withColumnRenamed("doc_id", "doc"), "doc")
    top = retrieval.top_k(found, F.lit(False), "class_fqn", 5).orderBy("query", "rank").collect()
    assert [(r["query"], r["class_fqn"]) for r in top if r["query"] == 1] == [(1, "redis.Conn")] and all(r["score"] > 0 for r in top)
    assert retrieval.top_k(found, F.col("path") == "p/A.java", "class_fqn", 5).filter("query = 1").count() == 0


def test_class_cap_and_over_fetch(spark):
    df = spark.createDataFrame([(1, i, 100.0 - i, "same" if i < 30 else "other") for i in range(40)], "query int, doc int, score double, g string")
    assert [r["doc"] for r in retrieval.top_k(df, F.lit(False), "g", 5).orderBy("rank").collect()] == [0, 1]


def test_external_leak(spark):
    df = spark.createDataFrame([("a/b/C.java", "b/C.java", "x.C", "y.C"), ("a.java", "b.java", "x.C", "x.C"), ("a.java", "b.java", "", "")], "p string, q string, c string, d string")
    assert [r["x"] for r in df.select(retrieval.external_leak("p", "q", "c", "d").alias("x")).collect()] == [True, True, False]


def test_retriever_registry(spark):
    r = retrieval.Retrievers()
    r.register_rows("two", "query int, doc int", lambda q: [{"query": q["query"], "doc": i} for i in range(2)])
    r.register("default", lambda df: df)
    assert r.mode("rag_two")(spark.createDataFrame([(7,)], "query int")).count() == 2
    assert r.mode("retrieval_augmentation")(spark.range(3)).count() == 3


FILE = "package p;\n\nimport a.Used;\nimport b.*;\nimport c.Other;\n\npublic class Foo {\n  private Used u; // {\n  Foo() { }\n  int x;\n  void sib() { String s = \"}\"; }\n  // note\n  public void bar() {\n    u.go();\n  }\n  void after() { }\n}\n"


def fim(**k):
    start = FILE.index("{", FILE.index("bar()"))
    return {"fileContent": FILE, "bodyStartOffset": start, "bodyEndOffset": FILE.index("}", FILE.index("u.go")) + 1, "classFqn": "p.Foo", "invocations": [{"signature": "p.Foo::sib()", "resolutionMode": "EXACT", "orderIndex": 1}, {"signature": "a.Used::go()", "resolutionMode": "EXACT", "orderIndex": 0}], "usedTypes": ["a.Used"]} | k


def test_prompt_blocks():
    b = prompt.blocks(FILE, fim()["bodyStartOffset"])
    assert b.package + "".join(b.imports) + b.head + "".join(b.members) + b.method == FILE[: fim()["bodyStartOffset"] + 1]
    assert len(b.imports) == 3 and len(b.members) == 4 and b.method.endswith("public void bar() {")


def test_prompt_without_budget():
    p = prompt.build(fim(), "no_augmentation")
    assert p["prefix"] + p["ground_truth"] + p["suffix"] == FILE and p["augmentation_block"] is None
    ordered = prompt.build(fim(), "ordered_augmentation")["augmentation_block"]
    assert ordered.index("Used::go") < ordered.index("Foo::sib")


def test_prompt_fits_budget_and_marks_once():
    big = fim(fileContent=FILE.replace("  int x;\n", "".join(f"  int x{i} = {i};\n" for i in range(500))))
    big["bodyStartOffset"] = big["fileContent"].index("{", big["fileContent"].index("bar()"))
    big["bodyEndOffset"] = big["fileContent"].index("}", big["fileContent"].index("u.go")) + 1
    for budget in (64, 200, 400, 1000):
        p = prompt.build(big, "ordered_augmentation", budget=budget)
        assert prompt.price(p["full_prompt"]) <= budget
        assert all(p["full_prompt"].count(t) == 1 for t in (prompt.PREFIX, prompt.SUFFIX, prompt.MIDDLE))
    assert "Used u" in prompt.build(big, "no_augmentation", budget=400)["prefix"]
    with pytest.raises(ValueError):
        prompt.build(fim(fileContent=FILE + prompt.MIDDLE), "no_augmentation")


def test_results_are_dropped_from_the_end():
    fragments = [prompt.fragment(f"f{i}", "word " * 100) for i in range(5)]
    made, n = prompt.fit_results(fim(), "rag_x", fragments, 700)
    assert 0 < n < 5 and made["full_prompt"].count(prompt.FILE) == n


def test_steps_mark_errors(spark):
    def step(batch):
        if (batch["id"] == 2).any():
            raise RuntimeError("no")
        return batch.assign(y=batch["id"] + 1)

    got = {r["id"]: (r["y"], r["step_error"]) for r in plugins.with_step(spark.range(4).repartitionByRange(4, "id"), step, "y long", attempts=2, wait=0).collect()}
    assert got[1] == (2, None) and got[2] == (None, "RuntimeError: no")
    assert plugins.resume(spark.range(4), spark.range(2), ["id"]).count() == 2


def test_fill_missing(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 5, None), (3, None, None)], "k int, n int, s string")
    b = spark.createDataFrame([(1, 7, "y"), (2, 8, None)], "k int, n int, s string")
    got = {r["k"]: (r["n"], r["s"], r["changed"]) for r in mining.fill_missing(a, b, "k", ["n", "s"]).collect()}
    assert got == {1: (7, "x", True), 2: (5, None, False), 3: (None, None, False)}


def test_config(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("retrieval:\n  top_k: 7\nretrievers:\n  own:\n    max_results_in_prompt: 2\nllm:\n  seed: 1\n")
    got = readers.load_config(str(tmp_path / "c.yaml"))
    assert got["retrievers"]["default"]["max_results_in_prompt"] == 7 and got["retrievers"]["own"]["max_results_in_prompt"] == 2
    assert got["retrievers"]["own"]["top_k"] == 5 and got["llm"] == {"seed": 1, "context_window": 0, "max_concurrent_requests": 1}
    assert got["test_evaluation"]["enabled"] is False and "retrieval" not in got


def test_contains_join_takes_names_of_any_length(spark):
    texts = ["is a Box of ids", "List.of(x) id_of", "été.naïveÉté() $ref a$b", "", "of", "x", None]
    names = ["of", "id", "is", "x", "a", "été", "té", "ï", "$", "$b", "a$b", "Box", "id_of", "List", "absent", "zz", "of", None]
    got = dataset.contains_join(spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), spark.createDataFrame([(n,) for n in names], "name string"), "text", "name").collect()
    assert sorted(map(tuple, got)) == sorted({(i, n) for i, t in enumerate(texts) for n in names if t and n and n in t})
