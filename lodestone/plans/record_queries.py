"""Queries over records that are kept, replaced, explained and checked: progress, reruns, consistency, coverage by path, explanations, words."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import kernels, metrics, text
from lodestone.operators import analysis, dataset, graph, plugins, prompt, retrieval, scoring
from lodestone.operators.codebleu import codebleu
from lodestone.plans.queries import _RETRIEVAL, _TERM, _postings, _results, _terms, query, r6, t
from lodestone.plans.source_queries import _sources
from lodestone.session import shared_folder, stored
from lodestone.sources import readers, sinks
from lodestone.streaming import progress

s = lambda c: F.col(c).cast("string")


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Progress and reruns -----------------------------------------------------------------------------


@query("select event_type as mode, count(*) as completed, 100 * count(distinct user_id) as total, max(ts) as last_updated from events group by event_type")
def progress_rows(spark, sf):
    """Progress of a stream by mode; the stream is started twice over one checkpoint, as after a restart."""
    events, place = t(spark, sf, "events"), _place(spark, "progress")
    totals = events.groupBy("event_type").agg((F.lit(100) * F.count_distinct("user_id")).alias("total"))
    rows = progress.stream_table(spark, sf, events.schema, "events.parquet")
    for _ in range(2):
        progress.track(rows, "event_type", "ts", totals, f"{place}/table", f"{place}/checkpoint").awaitTermination()
    return sinks.read_replaced(spark, f"{place}/table")


def _repaired(batch):
    return batch.assign(c_acctbal=-batch["was"], again=True)


@query("select c_custkey, c_name, case when c_acctbal < 0 then -c_acctbal else c_acctbal end as c_acctbal, c_acctbal < 0 as again from customer")
def rerun_samples(spark, sf):
    """Broken rows are made anew and replaced by key, the batch twice."""
    path, columns = _place(spark, "samples"), ["c_custkey", "c_name", "c_acctbal"]
    sinks.replace_rows(t(spark, sf, "customer").select(*columns, F.col("c_acctbal").alias("was"), F.lit(False).alias("again")), path, ["c_custkey"], buckets=8)
    samples = sinks.read_replaced(spark, path)
    kind = dict(samples.dtypes)["c_acctbal"]
    made, _ = plugins.rerun(samples, samples.filter("c_acctbal < 0"), ["c_custkey"], _repaired, f"c_acctbal {kind}, again boolean")
    for _ in range(2):
        sinks.replace_rows(made, path, ["c_custkey"], buckets=8)
    return sinks.read_replaced(spark, path).drop("was")


# Consistency and recomputation -------------------------------------------------------------------


@query("""with e as (select user_id, case when event_type in ('view', 'click') then 'ordered_' else '' end || event_type as mode, event_id, value from events),
 g as (select user_id, mode, max(value) > 95 as hot, list(event_id % 7 order by event_id % 5, event_id) as placed, list(event_id % 7 order by event_id desc) as back from e group by all),
 w as (select *, case when user_id % 3 = 0 then back else placed end as used, count(*) over (partition by user_id) as modes, first_value(hot) over (partition by user_id order by mode) as first from g)
select user_id, mode, 'hot' as field from w where modes > 1 and hot is distinct from first union all select user_id, mode, 'used' from w where modes > 1 and contains(mode, 'ordered') and placed <> used""")
def consistency_issues(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.concat(F.when(F.col("event_type").isin("view", "click"), "ordered_").otherwise(""), "event_type").alias("mode"), "event_id", "value")
    call = F.struct("event_id", (F.col("event_id") % 7).cast("string").alias("signature"), (F.col("event_id") % 5).cast("int").alias("order_index"))
    g = e.groupBy("user_id", "mode").agg((F.max("value") > 95).alias("hot"), F.array_sort(F.collect_list(call)).alias("ordered"))
    placed = F.array_sort(F.transform("ordered", lambda c: F.struct(c["order_index"].alias("o"), c["event_id"].alias("e"), c["signature"].alias("signature"))))
    used = F.when(F.col("user_id") % 3 == 0, F.transform(F.reverse("ordered"), lambda c: c["signature"])).otherwise(F.transform(placed, lambda c: c["signature"]))
    rows = g.withColumn("used", F.transform(used, lambda x: F.struct(x.alias("signature")))).withColumn("block", F.lit("/* */"))
    return analysis.consistency_issues(rows, "user_id", "mode", ["hot"], "block", "ordered", "used")


_TIDY = "array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '//[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10))"
_TOK = "[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+(?:\\.[0-9]+)?|[^\\s]"


@query(f"""with b as (select item_id, regexp_replace(text, '[^ -~]', '?', 'g') || ' // idle' || chr(10) || '  /* ' || item_id || ' */ end' as x from benchmark), p as (select a.item_id, {_TIDY.format('a.x')} as x, {_TIDY.format('b.x')} as y from b a join b on b.item_id = a.item_id + 1),
 w as (select item_id, 0 as side, unnest(regexp_extract_all(x, '{_TOK}')) as k from p union all select item_id, 1, unnest(regexp_extract_all(y, '{_TOK}')) from p), n as (select item_id, k, count(*) filter (where side = 0) as g, count(*) filter (where side = 1) as r from w group by all),
 i as (select item_id, sum(least(g, r)) as shared, sum(g) as gs, sum(r) as rs from n group by all)
select item_id, md5(x) as normalized_generated, md5(y) as normalized_ground_truth, round(shared / (gs + rs - shared), 6) as iou, 0.25e0 as mrr from p join i using (item_id)""")
def recomputed_texts(spark, sf):
    b = t(spark, sf, "benchmark").select("item_id", F.concat(F.regexp_replace("text", "[^ -~]", "?"), F.lit(" // idle\n  /* "), s("item_id"), F.lit(" */ end")).alias("generated"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("generated").alias("ground_truth")), "item_id")
    old = F.struct(F.lit(0.25).alias("mrr"), F.lit(-1.0).alias("iou"))
    made = scoring.recompute(pairs.select("*", old.alias("metrics"), F.lit("stale").alias("normalized_generated")), unify=False)
    return made.select("item_id", F.md5("normalized_generated").alias("normalized_generated"), F.md5("normalized_ground_truth").alias("normalized_ground_truth"), r6("metrics.iou", "iou"), F.col("metrics.mrr").alias("mrr"))


def codebleu_pairs(spark, sf):
    """CodeBLEU of each source against the one of the next customer: 1 for parts that agree, less by names and numbers."""
    a = _sources(spark, sf)
    # By a shuffle: the size of a side is guessed from its table, without the texts that are spelled from it.
    pairs = a.select("path", F.col("text").alias("generated")).join(a.select((F.col("path") - 1).alias("path"), F.col("text").alias("ground_truth")).hint("merge"), "path")
    return codebleu(pairs, "path").select("path", r6("ngram", "ngram"), r6("weighted", "weighted"), r6("syntax", "syntax"), r6("dataflow", "dataflow"), "codebleu")


query()(codebleu_pairs)


# Coverage by path --------------------------------------------------------------------------------

_METHOD = """p_partkey, case when p_partkey % 4 > 0 then 'mod' || p_size % 3 || '/src/main/java/org/k' || p_size || '/C' || p_partkey % 10 || '.java' end as path, 1 + p_partkey % 20 as first_line, 1 + p_partkey % 20 + p_size % 9 as last_line"""


@query(f"""with m as (select {_METHOD}, 'org/k' || p_size || '/C' || p_partkey % 10 || '.java' as source_key from part), l as (select distinct 'org/k' || s_suppkey % 50 || '/C' || s_suppkey % 10 || '.java' as source_key, 1 + s_suppkey % 30 as line, s_suppkey % 3 as covered from supplier)
select p_partkey, string_agg(line || ':' || covered, ',' order by line, covered) as lines from m join l using (source_key) where line between first_line and last_line group by p_partkey""")
def coverage_by_path(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    path = F.when(k % 4 > 0, F.concat(F.lit("mod"), (z % 3).cast("string"), F.lit("/src/main/java/org/k"), s("p_size"), F.lit("/C"), (k % 10).cast("string"), F.lit(".java")))
    head, body = F.repeat(F.lit("\n"), (k % 20).cast("int")), F.repeat(F.lit("\n"), (z % 9).cast("int"))
    methods = t(spark, sf, "part").select("p_partkey", path.alias("filePath"), F.concat(F.lit("org.k"), s("p_size"), F.lit(".C"), (k % 10).cast("string"), F.lit(".Inner")).alias("classFqn"), F.concat(head, body, F.lit("} tail\n")).alias("fileContent"), F.length(head).alias("bodyStartOffset"), (F.length(head) + F.length(body)).alias("bodyEndOffset"))
    lines = t(spark, sf, "supplier").select(F.concat(F.lit("org/k"), (F.col("s_suppkey") % 50).cast("string"), F.lit("/C"), (F.col("s_suppkey") % 10).cast("string"), F.lit(".java")).alias("source_key"), (F.lit(1) + F.col("s_suppkey") % 30).cast("int").alias("line"), (F.col("s_suppkey") % 3).cast("int").alias("covered"), F.lit(0).alias("missed")).distinct()
    found = dataset.method_line_coverage(methods, lines, "p_partkey")
    return found.select(F.col("method_id").alias("p_partkey"), F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["line"].cast("string"), x["covered"].cast("string"))), ",").alias("lines"))


@query("select distinct case p_size % 3 when 0 then '' else 'mod' || p_size % 3 || '/' end || 'src/main/java' as root from part where p_size % 5 > 0")
def source_roots(spark, sf):
    z = F.col("p_size")
    files = t(spark, sf, "part").select(F.concat(F.when(z % 3 == 0, "").otherwise(F.concat(F.lit("mod"), (z % 3).cast("string"), F.lit("/"))), F.when(z % 5 > 0, "src/main/java").otherwise("src/test"), F.lit("/q/A"), s("p_partkey"), F.lit(".java")).alias("path"))
    return dataset.source_roots(files, "path", ".")


# Explanations and results ------------------------------------------------------------------------

_PARTS = _TERM.split("\n + ")


@query(f"""{_RETRIEVAL} select t.query, doc, count(*) as n_terms, round(sum(mult * ({_PARTS[0]})), 6) as bm25, round(sum(mult * ({_PARTS[1]})), 6) as jelinek_mercer, round(sum(mult * ({_PARTS[2]})), 6) as dirichlet, round(any_value(t.score), 6) as score
 from (select query, doc, score from top where rank <= 2) t join q using (query) join post using (doc, term) join ts using (term) join dl using (doc), fs group by all""")
def score_explanations(spark, sf):
    path = _place(spark, "postings")
    _postings(spark, sf).write.parquet(path)  # read by scores, statistics and explanations; smaller than a checkpoint
    posted = spark.read.parquet(path)
    stats = retrieval.index_stats(posted)
    winners = stored(_results(spark, sf, posted, stats).filter("rank <= 2").select("query", "doc"))
    told = retrieval.explain(winners, _terms(spark, sf), posted, stats)
    x = F.get("clauses", F.lit(0))["terms"]
    add = lambda c: F.aggregate(x, F.lit(0.0), lambda a, y: a + y["weight"] * y[c])
    return told.select("query", "doc", F.size(x).cast("long").alias("n_terms"), r6(add("bm25"), "bm25"), r6(add("jelinek_mercer"), "jelinek_mercer"), r6(add("dirichlet"), "dirichlet"), r6("score", "score"))


@query("""with p as (select p_partkey, p_brand, string_split(p_name, ' ') as w, lower(p_name || ' ' || p_brand || ' ' || p_type) as card from part), j as (select a.p_partkey, a.w, a.p_brand, b.card as one, c.card as two from p a join p b on b.p_partkey = a.p_partkey + 1 join p c on c.p_partkey = a.p_partkey + 2),
 n as (select p_partkey, one, two, list_distinct([struct_pack(o := 'x.' || w[1], m := w[2]), struct_pack(o := 'x.' || w[1], m := p_brand), struct_pack(o := 'y.' || left(w[2], 2), m := left(w[1], 2)), struct_pack(o := 'x.' || w[1], m := w[2])]) as need from j)
select p_partkey, round(len(list_filter(need, lambda x: (contains(one, lower(x.o[3:])) and contains(one, lower(x.m))) or (contains(two, lower(x.o[3:])) and contains(two, lower(x.m))))) / len(need), 6) as coverage from n""")
def api_coverage_by_text(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("w"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("card"))
    later = lambda n: p.select((F.col("p_partkey") - n).alias("p_partkey"), F.col("card").alias(f"card{n}"))
    w = lambda i: F.get("w", F.lit(i))
    call = lambda package, owner, method: F.struct(F.concat(F.lit(package), owner).alias("owner"), method.alias("method"))
    oracle = F.array(call("x.", w(0), w(1)), call("x.", w(0), F.col("p_brand")), call("y.", F.left(w(1), F.lit(2)), F.left(w(0), F.lit(2))), call("x.", w(0), w(1)))
    rows = p.join(later(1), "p_partkey").join(later(2), "p_partkey")
    return rows.select("p_partkey", r6(metrics.api_coverage(F.array("card1", "card2"), oracle), "coverage"))


@query("""select p_partkey, round((case when p_partkey % 3 = 0 then 1 else 0 end + case when p_size % 2 = 0 then 1 else 0 end) / 2e0, 6) as recall, case when p_size % 2 = 0 then 'q.s' || p_size || '<t>::go;' else '' end || 'a.b::f' as apis from part""")
def owner_type_recalls(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    profile = F.concat(F.when(z % 2 == 0, F.concat(F.lit("q.S"), s("p_size"), F.lit("<T>::Go(int) -> void x3\n"))).otherwise(""), F.lit("a.B::f\nbigram: S::go -> x.Y::z\n\n"))
    other = F.when(k % 3 == 0, F.lit("x.Own::m() -> int\n")).otherwise("")
    call = lambda owner: F.struct(owner.alias("owner"), F.lit("any").alias("method"))
    oracle = F.array(call(F.concat(F.lit("q.S"), s("p_size"), F.lit("<T>"))), call(F.lit("x.own")), call(F.lit("x.Own")))
    apis = F.array_join(F.transform(metrics.profile_apis(profile), lambda x: F.concat_ws("::", x["owner"], x["method"])), ";")
    return t(spark, sf, "part").select("p_partkey", r6(metrics.owner_type_recall(F.array(profile, other), oracle), "recall"), apis.alias("apis"))


@query("""with r as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as n from events), c as (select *, row_number() over (partition by user_id order by n) as rank from r where n <= 8 and not value > 80)
select user_id, event_id, cast(rank as int) as rank from c where rank <= 5""")
def external_top_results(spark, sf):
    from pyspark.sql import Window

    e = t(spark, sf, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return retrieval.external_results(e, F.col("value") > 80, 5, "user_id").select("user_id", "event_id", "rank")


# Texts -------------------------------------------------------------------------------------------


@query("""select p_partkey, 'Map<K, List<V' || p_size || '>>' || case when p_partkey % 2 = 0 then ';int[]' else '' end || case when p_partkey % 3 = 0 then ';Set<R, T' || p_partkey || '>' else '' end || case when p_partkey % 5 = 0 then ';final Foo;Bar...' else '' end as types from part""")
def parameter_type_lists(spark, sf):
    k = F.col("p_partkey")
    listed = F.concat(F.lit("java.util.Map<K, List<V"), s("p_size"), F.lit(">> m"), F.when(k % 2 == 0, " ,int[]  n").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit(", java.util.Set<q.R, T"), s("p_partkey"), F.lit(">"))).otherwise(""), F.when(k % 5 == 0, ", final a.b.Foo x, Bar... more,").otherwise(""))
    return t(spark, sf, "part").select("p_partkey", F.array_join(text.parameter_types(listed), ";").alias("types"))


@query("""with d as (select p_partkey, repeat('// x' || chr(10), p_size % 3) || 'class A {' || chr(10) || '  int x;' || chr(10) as head, case when p_partkey % 2 = 0 then '  /** it' || chr(10) || '   * does */' || chr(10) else '' end || case when p_partkey % 3 = 0 then '  @Override' || chr(10) else '' end as over,
 '  void m' || p_partkey || '() ' || case when p_partkey % 5 = 0 then chr(10) || '  ' else '' end as own from part)
select p_partkey, case when p_partkey % 7 = 0 then 0 else length(head) end as start from d""")
def declaration_starts(spark, sf):
    k, nl = F.col("p_partkey"), F.lit("\n")
    head = F.concat(F.repeat(F.lit("// x\n"), (F.col("p_size") % 3).cast("int")), F.lit("class A {\n  int x;\n"))
    over = F.concat(F.when(k % 2 == 0, "  /** it\n   * does */\n").otherwise(""), F.when(k % 3 == 0, "  @Override\n").otherwise(""))
    own = F.concat(F.lit("  void m"), s("p_partkey"), F.lit("() "), F.when(k % 5 == 0, F.concat(nl, F.lit("  "))).otherwise(""))
    before = F.when(k % 7 == 0, F.repeat(F.lit("y"), F.length(F.concat(head, over, own)))).otherwise(F.concat(head, over, own))
    return t(spark, sf, "part").select("p_partkey", before.alias("before")).select("p_partkey", text.declaration_start(F.concat("before", F.lit("{ body }")), F.length("before")).alias("start"))


def _joined(x: str) -> str:
    """SQL that marks single signs between two letters or two digits; twice, as neighbours share a letter."""
    marks = [(sign, f"chr({i + 1})", "a-z") for i, sign in enumerate(".:'")] + [(sign, f"chr({i + 11})", "0-9") for i, sign in enumerate(".',;")]
    for sign, mark, kind in marks * 2:
        quoted = sign.replace("'", "''").replace(".", "[.]")
        x = f"regexp_replace({x}, '([{kind}]){quoted}([{kind}])', '\\1' || {mark} || '\\2', 'g')"
    return x


@query(rf"""with d as (select doc_id, {_joined("regexp_replace(lower(text), '[^ -~]', ' ', 'g') || ' a.b:c''s 1,234.5;6 x::y _z a.1 1.a b..c ''q'' 3.x_4'")} as x from documents),
 w as (select doc_id, list_transform(regexp_extract_all(x, '[a-z0-9_\x01-\x0f]+'), lambda k: translate(k, chr(1) || chr(2) || chr(3) || chr(11) || chr(12) || chr(13) || chr(14), '.:''.'',;')) as ws from d)
select doc_id, len(ws) as n, md5(array_to_string(ws, ' ')) as words from w""")
def word_terms(spark, sf):
    said = F.concat(F.regexp_replace(F.lower("text"), "[^ -~]", " "), F.lit(" a.b:c's 1,234.5;6 x::y _z a.1 1.a b..c 'q' 3.x_4"))
    words = retrieval.analyze(said)
    return t(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, " ")).alias("words"))


# A store that is broken --------------------------------------------------------------------------


@query("""with v as (select n_nationkey % 20 as vertex_id, n_nationkey * 2 as idx from nation), e as (select n_nationkey as src, (n_regionkey * 7) % 27 as dst, n_nationkey % 4 - 0.5 * (n_nationkey % 2) as weight from nation union all select n_nationkey, (n_regionkey * 7) % 27, 1.0 from nation where n_nationkey % 5 = 0)
select 'ends_known' as check_name, count(*) = 0 as ok from (select src as x from e union all select dst from e) where x not in (select vertex_id from v) union all select 'weights_positive', bool_and(weight > 0) from e union all select 'pairs_unique', bool_and(n = 1) from (select count(*) as n from e group by src, dst)
 union all select 'ids_unique', bool_and(n = 1) from (select count(*) as n from v group by vertex_id) union all select 'weights_integer', bool_and(weight = floor(weight)) from e union all select 'numbers_dense', min(idx) = 0 and max(idx) = count(*) - 1 from v""")
def graph_checks_of_a_broken_store(spark, sf):
    n = t(spark, sf, "nation")
    key = F.col("n_nationkey")
    vertices = n.select((key % 20).alias("vertex_id"), (key * 2).alias("idx"))
    edges = n.select(key.alias("src"), ((F.col("n_regionkey") * 7) % 27).alias("dst"), (key % 4 - F.lit(0.5) * (key % 2)).alias("weight"))
    return graph.sanity(vertices, edges.unionByName(edges.filter(F.col("src") % 5 == 0).withColumn("weight", F.lit(1.0))))


# Requests and a written index --------------------------------------------------------------------

_STOPPED = ", ".join(f"'{x}'" for x in text.STOP_TERMS)


@query(f"""with r as (select n_nationkey as query, 'n' || n_nationkey as n, n_nationkey as k from nation),
 c as (select query, unnest([struct_pack(c := 'type', b := 5e0, f := 'types', t := ['optional', 'widget' || k % 4, 'queue', 'item' || k % 5, 'base' || k % 3, 'answer' || n, 'string', 'thing']), struct_pack(c := 'signature', b := 3e0, f := 'card', t := ['answer' || n, 'findby' || n, 'kind' || n, 'base' || k % 3]),
  struct_pack(c := 'package', b := 2e0, f := 'card', t := ['pkg', 'c' || k]), struct_pack(c := 'invocation', b := 1e0, f := 'profile', t := ['q.owner', 'list', 'ab', 'r.other' || k % 2, 'q.owner'])]) as x from r),
 u as (select query, x.c as clause, x.b as boost, x.f as field, unnest(x.t) as term from c)
select query, clause, boost, field, term, count(*) as mult from u where length(term) >= 3 and term not in ({_STOPPED}) group by all""")
def request_terms(spark, sf):
    k, key = F.col("n_nationkey"), s("n_nationkey")
    made = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    rows = t(spark, sf, "nation").select(
        k.alias("query"), made("public static Answern", key, " findByn", key, "(int n, java.lang.String s, Queue<a.Thing> q)").alias("methodSignature"), made("org.pkg.c", key, ".Kindn", key).alias("classFqn"), F.array(made("a.b.Base", k % 3)).alias("supertypes"),
        F.array(F.lit("java.util.Optional"), made("w.Widget", k % 4)).alias("imports"), F.array(F.lit("java.util.Queue<a.Thing>"), made("x.Item", k % 5)).alias("classFields"), F.array(F.lit("q.Owner"), F.lit("List"), F.lit("Ab"), made("r.Other", k % 2), F.lit("q.Owner")).alias("siblingOwnerTypes"),
    )
    return retrieval.build_query_terms(rows)


@query(f"{_RETRIEVAL} select query, doc, source, round(score, 6) as score, cast(rank as int) as rank from top where rank <= 5")
def retrieval_from_index(spark, sf):
    """The ranked results of ``retrieval_topk`` from an index that was written before."""
    path = _place(spark, "index")
    sinks.write_index(_postings(spark, sf), path)
    posted, stats = readers.read_index(spark, path)
    scored = retrieval.fetched(retrieval.score(_terms(spark, sf), posted, stats).drop("clauses"))
    sourced = scored.join(t(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    return retrieval.top_k(sourced, F.col("source") == F.concat(F.lit("src"), s("query")), "source").select("query", "doc", "source", r6("score", "score"), "rank")


# Common sequences --------------------------------------------------------------------------------


@query("""with recursive p as (select c_custkey as key, lower(c_name || c_mktsegment) as x, lower(c_mktsegment || ' building customer') as y from customer), q as (select *, string_split(x, '') as a, string_split(y, '') as b from p),
 d(key, a, b, i, cells) as (select key, a, b, 0, list_transform(range(0, len(b) + 1), lambda j: 0) from q union all select key, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: list_max(list_prepend(0, list_transform(range(1, j + 1), lambda k: case when a[i + 1] = b[k] then cells[k] + 1 else cells[k + 1] end)))) from d where i < len(a)),
 l as (select key, cells[len(cells)] as lcs_length, greatest(len(a), len(b)) as longest from d where i = len(a)),
 r as (select key, x, y, unnest(range(1, length(y) + 1)) as i0 from p), m as (select key, max(list_max(list_transform(range(0, length(y) - i0 + 2), lambda n: case when contains(x, substr(y, i0, n)) then n else 0 end))) as run from r group by key)
select key as c_custkey, cast(lcs_length as int) as lcs_length, round(lcs_length / longest, 6) as lcs_ratio, cast(run as int) as run from l join m using (key)""")
def common_sequences(spark, sf):
    x, y = F.lower(F.concat("c_name", "c_mktsegment")), F.lower(F.concat("c_mktsegment", F.lit(" building customer")))
    letters = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    rows = t(spark, sf, "customer").select("c_custkey", letters(x).alias("x"), letters(y).alias("y"))
    made = rows.withColumns({"lcs_length": F.size(kernels.lcs_tokens_udf("x", "y")), "same": kernels.lcs_length_udf("x", "y"), "run": F.size(kernels.common_substring_udf("x", "y"))})
    return made.select("c_custkey", F.when(F.col("same") == F.col("lcs_length"), F.col("lcs_length")).alias("lcs_length"), r6(metrics.ratio_to_longest("lcs_length", "x", "y"), "lcs_ratio"), "run")


# Prompts without a budget ------------------------------------------------------------------------


@query("""with p as (select p_partkey as k, 'package p;' || chr(10) || 'import a.B;' || chr(10) || 'class C {' || chr(10) || '  private B b;' || chr(10) as head, '  void m' || p_partkey || '() {' as own, ' ' || p_name || '; ' as body, '}' || chr(10) || '  void n() { }' || chr(10) || '}' || chr(10) as tail,
  '/*' || chr(10) || ' * Method invocations used in this method:' || chr(10) || ' * 1. q.R::z' || p_size || '(int) [EXACT]' || chr(10) || ' * 2. a.B::n() [UNRESOLVED]' || chr(10) || ' */' as comment, '<|file_sep|>f' || p_size || chr(10) || p_brand as found from part),
 m as (select k, 'ordered_augmentation' as mode, head || comment || chr(10) || own as prefix, '' as context, comment as block, body, tail from p union all select k, 'no_augmentation', head || own, '', null, body, tail from p union all select k, 'rag_x', head || own, found || chr(10), found, body, tail from p)
select k as p_partkey, mode, md5(context || '<|fim_prefix|>' || prefix || '<|fim_suffix|>' || tail || '<|fim_middle|>') as prompt, md5(prefix) as prefix, md5(tail) as suffix, body as truth, md5(block) as block, cast(null as varchar) as error from m""")
def whole_prompts(spark, sf):
    key = s("p_partkey")
    head = F.concat(F.lit("package p;\nimport a.B;\nclass C {\n  private B b;\n  void m"), key, F.lit("() {"))
    body = F.concat(F.lit(" "), "p_name", F.lit("; "))
    call = lambda signature, mode, at: F.struct(signature.alias("signature"), F.lit(mode).alias("resolutionMode"), F.lit(at).alias("orderIndex"))
    calls = F.array(call(F.lit("a.B::n()"), "UNRESOLVED", 1), call(F.concat(F.lit("q.R::z"), s("p_size"), F.lit("(int)")), "EXACT", 0))
    rows = t(spark, sf, "part").select("p_partkey", F.concat(head, body, F.lit("}\n  void n() { }\n}\n")).alias("fileContent"), (F.length(head) - 1).alias("bodyStartOffset"), (F.length(head) + F.length(body)).alias("bodyEndOffset"), F.lit("p.C").alias("classFqn"), calls.alias("invocations"), F.array(F.lit("a.B")).alias("usedTypes"), F.concat(F.lit("<|file_sep|>f"), s("p_size"), F.lit("\n"), "p_brand").alias("found"))
    out = None
    for mode in ("ordered_augmentation", "no_augmentation", "rag_x"):
        made = prompt.prompts(rows, "p_partkey", mode, retrieved="found" if prompt.is_retrieval(mode) else None)
        part = made.select("p_partkey", F.lit(mode).alias("mode"), F.md5("full_prompt").alias("prompt"), F.md5("prefix").alias("prefix"), F.md5("suffix").alias("suffix"), F.col("ground_truth").alias("truth"), F.md5("augmentation_block").alias("block"), "error")
        out = part if out is None else out.unionByName(part)
    return out
