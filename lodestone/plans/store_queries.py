"""Queries that write tables derived from the given ones with the engine's sinks and read them back with its readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import analysis, dataset, enrich, graph, mining
from lodestone.plans.code_queries import _CE, _V, _call_graph, _methods
from lodestone.plans.queries import query, r6, t
from lodestone.session import shared_folder
from lodestone.sources import readers, sinks
from lodestone.sources.documents import write_elements

s = lambda c: F.col(c).cast("string")
NONE = lambda: F.array().cast("array<string>")


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Reports as XML ----------------------------------------------------------------------------------


@query("""select 'org.n' || s_nationkey || '.C' || s_suppkey as class_name, m as method_name, case m when 'run' then 'int,java.lang.String[]' else '' end as params, case m when 'run' then 'void' else 'q.R' end as returns, cast(s_suppkey % 7 as int) as covered_lines, cast(s_suppkey % 7 + s_suppkey % 3 as int) as total_lines
 from supplier, (select unnest(['run', 'get']) as m)""")
def coverage_methods(spark, sf):
    path, k = _place(spark, "coverage"), F.col("s_suppkey")
    counter = lambda kind, missed, covered: F.struct(F.lit(kind).alias("_type"), missed.cast("int").alias("_missed"), covered.cast("int").alias("_covered"))
    counters = F.array(counter("INSTRUCTION", k, k), counter("LINE", k % 3, k % 7))
    method = lambda name, desc: F.struct(F.lit(name).alias("_name"), F.lit(desc).alias("_desc"), counters.alias("counter"))
    bare = F.struct(F.lit("none").alias("_name"), F.lit("()V").alias("_desc"), F.array(counter("BRANCH", k, k)).alias("counter"))
    one = F.struct(F.concat(F.lit("org/n"), s("s_nationkey"), F.lit("/C"), s("s_suppkey")).alias("_name"), F.array(method("run", "(I[Ljava/lang/String;)V"), method("get", "()Lq/R;"), bare).alias("method"))
    rows = t(spark, sf, "supplier").select(F.concat(F.lit("org/n"), s("s_nationkey")).alias("_name"), F.array(one).alias("class"))
    rows.write.format("xml").option("rootTag", "report").option("rowTag", "package").save(path)
    return readers.read_coverage(spark, path)[0].select("class_name", "method_name", F.array_join("params", ",").alias("params"), "returns", "covered_lines", "total_lines")


@query("""with c as (select n_nationkey, n_regionkey, count(c_custkey) as n, count(c_custkey) filter (where c_custkey % 4 = 0) as failed, count(c_custkey) filter (where c_custkey % 4 = 1) as errors, list('p.T' || n_nationkey || '.m' || c_custkey order by 'p.T' || n_nationkey || '.m' || c_custkey) filter (where c_custkey % 4 < 2) as names from nation join customer on c_nationkey = n_nationkey group by all)
select cast(sum(n) as bigint) as tests_run, cast(sum(failed + errors) as bigint) as tests_failed, cast(sum(n) - sum(failed + errors) as bigint) as tests_passed, md5(array_to_string(list_sort(flatten(list(names))), ';')) as names from c""")
def test_report_totals(spark, sf):
    path, k = _place(spark, "tests"), F.col("c_custkey") % 4
    case = F.struct(F.concat(F.lit("p.T"), s("c_nationkey")).alias("_classname"), F.concat(F.lit("m"), s("c_custkey")).alias("_name"), F.when(k == 0, F.array(F.lit("no"))).alias("failure"), F.when(k == 1, F.array(F.lit("oops"))).alias("error"))
    suites = t(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").cast("int").alias("_tests"), F.count_if(k == 0).cast("int").alias("_failures"), F.count_if(k == 1).cast("int").alias("_errors"), F.collect_list(case).alias("testcase")).drop("c_nationkey")
    suites.write.format("xml").option("rootTag", "testsuites").option("rowTag", "testsuite").save(path)
    return readers.test_totals(readers.read_test_reports(spark, path)).select("tests_run", "tests_failed", "tests_passed", F.md5(F.array_join("failed_test_names", ";")).alias("names"))


test_report_totals.__test__ = False


# Graphs, slices, reports -------------------------------------------------------------------------


@query(f"with {_V}, {_CE} select a.idx as src_idx, b.idx as dst_idx, weight from ce join i a on a.vertex_id = src join i b on b.vertex_id = dst")
def stored_graph(spark, sf):
    path = _place(spark, "graph")
    sinks.write_graph(*_call_graph(spark, sf), path)
    return graph.adjacency(*readers.read_graph(spark, path))


@query("select 'size' || p_size % 5 as slice, p_partkey as sample_index from part union all select 'brand' || substr(p_brand, 7), p_partkey from part")
def slice_files(spark, sf):
    path = _place(spark, "slices")
    p = t(spark, sf, "part")
    named = p.select(F.explode(F.array(F.concat(F.lit("size"), (F.col("p_size") % 5).cast("string")), F.concat(F.lit("brand"), F.substring("p_brand", 7, 9)), F.lit("all"))).alias("slice"), F.col("p_partkey").cast("int").alias("i"))
    sinks.write_slices(named.groupBy("slice").agg(F.collect_list("i").alias("indices"), F.count("*").alias("count")).withColumn("name", F.col("slice")), path)
    return readers.read_slices(spark, path).select("slice", F.col("sample_index").cast(dict(p.dtypes)["p_partkey"]).alias("sample_index"))


@query("""with m as (select distinct event_type as mode from events), v as (select event_type as mode, value, case when value > 50 then 1e0 else 0e0 end as hot from events), l as (select mode, 'value' as metric, value as x from v union all select mode, 'hot', hot from v),
 a as (select mode, metric, round(avg(x), 4) as mean, round(coalesce(stddev_samp(x), 0), 4) as std from l where x is not null group by all) select metric, cast(row_number() over (partition by metric order by mode) - 1 as int) as position, mean, std from a""")
def report_table(spark, sf):
    path = _place(spark, "report")
    e = t(spark, sf, "events").select(F.col("event_type").alias("mode"), "value", (F.col("value") > 50).alias("hot"))
    modes = sorted(r["mode"] for r in e.select("mode").distinct().collect())
    sinks.write_report(e, "mode", modes, ["value", "hot"], path)
    return analysis.parse_table(spark.read.text(f"{path}/comparison_table.txt")).filter("metric in ('value', 'hot')").select("metric", "position", "mean", "std")


@query("select event_type as mode, count(*) as samples, round(avg(value), 4) as mean, round(median(value), 4) as median, round(coalesce(stddev_samp(value), 0), 4) as std from events group by event_type")
def report_summary(spark, sf):
    path = _place(spark, "summary")
    e = t(spark, sf, "events").select(F.col("event_type").alias("mode"), "value")
    sinks.write_report(e, "mode", sorted(r["mode"] for r in e.select("mode").distinct().collect()), ["value"], path)
    found = readers.read_summary(spark, path)
    rows = [(m, x["sample_count"], x["value"]["mean"], x["value"]["median"], x["value"]["std"]) for m, x in found.items()]
    return spark.createDataFrame(rows, "mode string, samples long, mean double, median double, std double")


# Batches, lines, caches --------------------------------------------------------------------------


@query("select 'void m' || p_partkey || '()' as signature, 'a.C' || p_size as fqn, p_brand || ';x' as imports, 'f' || p_partkey % 7 as path, cast(p_size as int) as at, '{\"' || p_name || '\\}' as body from part")
def request_batch(spark, sf):
    path = f"{_place(spark, 'requests')}.json"
    request = F.struct(F.concat(F.lit("void m"), s("p_partkey"), F.lit("()")).alias("methodSignature"), F.concat(F.lit("a.C"), s("p_size")).alias("classFqn"), F.array("p_brand", F.lit("x")).alias("imports"), F.concat(F.lit("f"), (F.col("p_partkey") % 7).cast("string")).alias("targetFilePath"), F.col("p_size").cast("int").alias("targetBodyStartOffset"))
    sinks.write_records(t(spark, sf, "part").select(request.alias("request"), F.concat(F.lit('{"'), "p_name", F.lit("\\}")).alias("targetMethodBody")), path)
    return readers.read_requests(spark, path).select(F.col("methodSignature").alias("signature"), F.col("classFqn").alias("fqn"), F.array_join("imports", ";").alias("imports"), F.col("targetFilePath").alias("path"), F.col("targetBodyStartOffset").alias("at"), F.col("targetMethodBody").alias("body"))


@query("select cast(s_suppkey as int) as index, 'F' || s_nationkey || '.java' as path, s_name || '{}' as content, cast(s_suppkey % 9 as int) as at, '{ x(\"}\"); }' as body from supplier")
def body_batch(spark, sf):
    path = _place(spark, "bodies")
    rows = t(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("index"), F.concat(F.lit("F"), s("s_nationkey"), F.lit(".java")).alias("filePath"), F.concat("s_name", F.lit("{}")).alias("fileContent"), (F.col("s_suppkey") % 9).cast("int").alias("bodyStartOffset"), F.lit('{ x("}"); }').alias("generatedBody"))
    write_elements(rows, path, "samples", {"classpath": ["a.jar"], "sourceRoots": []})
    return readers.read_bodies(spark, path).select("index", F.col("filePath").alias("path"), F.col("fileContent").alias("content"), F.col("bodyStartOffset").alias("at"), F.col("generatedBody").alias("body"))


@query("select 'm' || p_partkey as method, 'src/K' || p_size || '.java' as path, 'pkg.c' || p_size || '.K' || p_partkey % 10 as fqn, 'int;java.lang.String' as params, '' as thrown, 3 as n_calls, 'void s' || p_partkey || '()' as sibling from part")
def method_lines(spark, sf):
    path = _place(spark, "methods")
    sinks.write_methods(_methods(spark, sf).drop("p_partkey", "p_size", "is_covered"), path)
    rows = readers.read_methods(spark, path, lines=True)
    return rows.select(F.regexp_extract("methodSignature", r"(m\d+)\(", 1).alias("method"), F.col("filePath").alias("path"), F.col("classFqn").alias("fqn"), F.array_join("parameterTypes", ";").alias("params"), F.array_join("thrownExceptions", ";").alias("thrown"), F.size("invocations").alias("n_calls"), F.get("siblingMethods", F.lit(0))["signature"].alias("sibling"))


@query("select s_nationkey, count(*) as n, round(sum(s_acctbal), 2) as total from supplier group by s_nationkey")
def cached_table(spark, sf):
    """Made once by its configuration; the second call reads what the first has written, and another configuration is another table."""
    root, made = _place(spark, "cache"), []

    def make():
        made.append(1)
        return t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))

    for _ in range(2):
        sinks.cached(spark, root, {"seed": 1, "k": [5]}, make)
    found = sinks.cached(spark, root, {"k": [5], "seed": 1}, make)
    return found.filter(F.lit(len(made) == 1))


@query("select count(*) as samples, cast(42 as int) as seed, cast(sum(p_size) as bigint) as statements, md5(string_agg('m' || p_partkey, ';' order by p_partkey)) as names from part")
def dataset_index(spark, sf):
    rows = t(spark, sf, "part").select(F.col("p_partkey").alias("sample_pos"), F.lit("f").alias("filePath"), F.lit("a.B").alias("classFqn"), F.concat(F.lit("m"), s("p_partkey")).alias("methodName"), F.col("p_size").cast("int").alias("statementCount"), NONE().alias("invocations"))
    one = dataset.index_of(rows, 42)
    return one.select(F.col("sample_count").alias("samples"), "seed", F.aggregate("methods", F.lit(0).cast("long"), lambda a, m: a + m["statement_count"]).alias("statements"), F.md5(F.array_join(F.transform("methods", lambda m: m["method_name"]), ";")).alias("names"))


# Filling and comparing ---------------------------------------------------------------------------


@query("""select c_custkey, coalesce(case when c_custkey % 3 > 0 then c_name end, case when c_custkey % 2 = 0 then c_mktsegment end) as name, c_custkey % 3 = 0 and c_custkey % 2 = 0 as changed, coalesce(nullif(case when c_custkey % 5 = 0 then '' else c_mktsegment end, ''), c_name) as other from customer""")
def filled_samples(spark, sf):
    k, c = F.col("c_custkey"), t(spark, sf, "customer")
    samples = c.select("c_custkey", F.when(k % 3 > 0, F.col("c_name")).alias("name"), F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), "c_name")
    found = c.filter(k % 2 == 0).select("c_custkey", F.col("c_mktsegment").alias("name"))
    return mining.fill_missing(samples, found, "c_custkey", ["name"]).select("c_custkey", "name", "changed", text.or_else("segment", "c_name").alias("other"))


@query("""with e as (select event_type || user_id % 9 as name, 'T' || user_id % 4 as class, 't' || event_id % 6 as method from events), n as (select distinct event_type || k as name from events, (select unnest(range(0, 12)) as k))
select name, count(*) as n, md5(string_agg(class || '.' || method, ';' order by class, method)) as tests from (select distinct * from e) join n using (name) group by name""")
def tests_by_name(spark, sf):
    e = t(spark, sf, "events")
    name = F.concat("event_type", (F.col("user_id") % 9).cast("string"))
    tests = e.select(F.lit("f").alias("test_file"), F.concat(F.lit("T"), (F.col("user_id") % 4).cast("string")).alias("test_class"), F.concat(F.lit("t"), (F.col("event_id") % 6).cast("string")).alias("test_method"), F.array(name, name).alias("called"))
    names = e.select("event_type").distinct().select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat("event_type", i.cast("string")))).alias("name"))
    found = mining.tests_index(tests, names)
    return found.select("name", F.size("tests").cast("long").alias("n"), F.md5(F.array_join(F.transform("tests", lambda x: F.concat_ws(".", x["test_class"], x["test_method"])), ";")).alias("tests"))


@query("""with x as (select c_custkey as k, ['a.B::m' || c_custkey % 4 || '(int) -> void', 'a.B::n() -> void', 'a.B::n() -> void'] as o, list_filter(['a.B::m' || c_custkey % 3 || '(int) -> void', case when c_custkey % 2 = 0 then 'a.B::n() -> void' end], lambda v: v is not null) as g, case when c_custkey % 5 = 0 then ['q.m' || c_custkey % 4] else [] end as u from customer),
 y as (select k, list_distinct(o) as o, list_distinct(g) as g, list_distinct(list_transform(o, lambda v: split_part(split_part(v, '::', 2), '(', 1))) as po, list_distinct(list_concat(list_transform(g, lambda v: split_part(split_part(v, '::', 2), '(', 1)), list_transform(u, lambda v: v[3:]))) as pg from x)
select k as c_custkey, round(len(list_intersect(o, g)) / len(list_distinct(list_concat(o, g))), 6) as signature_iou, round(len(list_intersect(o, g)) / len(o), 6) as signature_recall, round(len(list_intersect(po, pg)) / len(list_distinct(list_concat(po, pg))), 6) as name_iou, round(len(list_intersect(po, pg)) / len(po), 6) as name_recall, 'signature' as "primary" from y""")
def call_comparison(spark, sf):
    k = F.col("c_custkey")
    call = lambda signature, mode="EXACT": F.struct((F.lit(signature) if isinstance(signature, str) else signature).alias("signature"), F.lit(mode).alias("resolutionMode"), F.lit(0).alias("orderIndex"))
    numbered = lambda n: F.concat(F.lit("a.B::m"), (k % n).cast("string"), F.lit("(int) -> void"))
    oracle = F.array(call(numbered(4)), call("a.B::n() -> void"), call("a.B::n() -> void"))
    made = F.concat(F.array(call(numbered(3))), F.when(k % 2 == 0, F.array(call("a.B::n() -> void"))).otherwise(F.slice(F.array(call("x")), 1, 0)), F.when(k % 5 == 0, F.array(call(F.concat(F.lit("q.m"), (k % 4).cast("string")), "UNRESOLVED"))).otherwise(F.slice(F.array(call("x")), 1, 0)))
    rows = enrich.compare_calls(t(spark, sf, "customer").select("c_custkey", oracle.alias("o"), made.alias("g")), "o", "g")
    return rows.select("c_custkey", *(r6(c, c) for c in ("signature_iou", "signature_recall", "name_iou", "name_recall")), "primary")
