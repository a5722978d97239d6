"""Queries over code-like rows that are spelled from the synthetic tables: names, paths, signatures, requests, verdicts and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import metrics, text
from lodestone.operators import analysis, dataset, graph, requests, retrieval, scoring
from lodestone.plans.queries import _EDGES, _PAIRS, _pairs, _samples, query, r6, t
from lodestone.session import stored

s = lambda c: F.col(c).cast("string")
NONE = lambda: F.array().cast("array<string>")
NO_CALLS = "array<struct<signature:string,resolutionMode:string,orderIndex:int>>"


def calls(*signatures) -> F.Column:
    return F.array(*(F.struct(F.lit(x).alias("signature") if isinstance(x, str) else x.alias("signature"), F.lit("EXACT").alias("resolutionMode"), F.lit(i).alias("orderIndex")) for i, x in enumerate(signatures)))


# Names, paths and signatures ---------------------------------------------------------------------

_TEST = "case event_id % 5 when 0 then 'pkg.' || event_type || 'Tests.test' || user_id when 1 then event_type || 'Test' when 2 then 'a.b.' || event_type || 'IT.run[' || (event_id % 3) || '.x]' when 3 then 'p.Q$In.m(int)' else 'p.' || event_type || '.' end"


@query(rf"""with n as (select event_id, {_TEST} as name from events), c as (select event_id, case when contains(name, '.') then regexp_extract(name, '^(.*)\.[^.]*$', 1) else name end as test_class,
 case when contains(name, '.') then nullif(regexp_replace(regexp_replace(regexp_extract(name, '[^.]*$'), '\[.*$', ''), '\(.*$', ''), '') end as test_method from n),
 o as (select *, split_part(regexp_extract(test_class, '[^.]*$'), '$', 1) as simple from c)
select event_id, test_class, test_method, case when length(simple) > 5 and simple like '%Tests' then simple[:-6] when length(simple) > 4 and simple like '%Test' then simple[:-5] when length(simple) > 2 and simple like '%IT' then simple[:-3] else simple end as base from o""")
def failed_test_names(spark, sf):
    k = F.col("event_id") % 5
    name = F.when(k == 0, F.concat(F.lit("pkg."), "event_type", F.lit("Tests.test"), s("user_id"))).when(k == 1, F.concat("event_type", F.lit("Test"))).when(k == 2, F.concat(F.lit("a.b."), "event_type", F.lit("IT.run["), (F.col("event_id") % 3).cast("string"), F.lit(".x]"))).when(k == 3, "p.Q$In.m(int)").otherwise(F.concat(F.lit("p."), "event_type", F.lit(".")))
    return t(spark, sf, "events").select("event_id", text.failed_test(name).alias("f")).select("event_id", "f.test_class", "f.test_method", text.class_simple_name("f.test_class").alias("base"))


_CALL = "'org.x.Cls' || p_partkey % 9 || '<T>::m' || p_partkey % 4 || '(int,  java.util.List<a.B>)  ->   java.util.Map'"


@query(f"""select p_partkey, 'Cls' || p_partkey % 9 || '::m' || p_partkey % 4 as short, 'org.x.Cls' || p_partkey % 9 || '<T>' as owner, 'm' || p_partkey % 4 as method, 'm' || p_partkey % 4 as called,
 'org.x.Cls' || p_partkey % 9 || '<T>::m' || p_partkey % 4 || '(int,java.util.List<a.B>) -> java.util.Map' as canonical, 'static Type' || p_size || ' run(Arg x, Other<y.z> o)' as simplified, 'Cls' || p_partkey % 9 as simple, 'org.x.Cls' || p_partkey % 9 as bare, 'run' as named from part""")
def signature_texts(spark, sf):
    call = F.concat(F.lit("org.x.Cls"), (F.col("p_partkey") % 9).cast("string"), F.lit("<T>::m"), (F.col("p_partkey") % 4).cast("string"), F.lit("(int,  java.util.List<a.B>)  ->   java.util.Map"))
    signature = F.concat(F.lit("public static a.b.Type"), s("p_size"), F.lit(" run(q.Arg x, v.w.Other<y.z> o)"))
    p = t(spark, sf, "part").select("p_partkey", call.alias("call"), signature.alias("sig"))
    owner = text.invocation_owner("call")
    return p.select("p_partkey", text.short_invocation("call").alias("short"), owner.alias("owner"), text.invocation_method("call").alias("method"), text.call_simple_name("call").alias("called"), text.canonical_invocation("call").alias("canonical"), text.simplify_signature("sig").alias("simplified"), text.simple_name(owner).alias("simple"), text.strip_generics(owner).alias("bare"), text.method_of_signature("sig").alias("named"))


_PATH = r"case c_custkey % 5 when 0 then 'mod' || c_custkey % 3 || '/src/test/java/com/x/Foo' || c_custkey || 'Test.java' when 1 then 'src\test\kotlin\a\B' || c_custkey || '.kt' when 2 then 'src/main/java/q/R.java' when 3 then 'docs/readme' || c_custkey || '.md' else 'Top.java' end"
_OTHER = "case c_custkey % 3 when 0 then path when 1 then 'root/' || path else 'zz' || path end"


@query(rf"""with p as (select c_custkey, {_PATH} as path from customer), q as (select *, {_OTHER} as other from p), l as (select *, string_split(replace(path, '\', '/'), '/') as a, string_split(replace(other, '\', '/'), '/') as b from q)
select c_custkey, replace(nullif(regexp_extract(replace(path, '\', '/'), '(?:^|/)(?:src/test/java|src/test/kotlin|src/test/groovy|src/main/java)/(.+)\.(?:java|kt|groovy)$', 1), ''), '/', '.') as test_class,
 case when contains(path, '/') and split_part(path, '/', 1) <> 'src' then split_part(path, '/', 1) end as module, a[len(a) - least(len(a), len(b)) + 1:] = b[len(b) - least(len(a), len(b)) + 1:] as is_suffix,
 case when length(path) > 30 then path[:29] || '…' else path end as shown, 1 + len(list_filter(string_split(path[:c_custkey % 40], ''), lambda x: x = '/')) as at_slash from l""")
def path_texts(spark, sf):
    k = F.col("c_custkey") % 5
    path = F.when(k == 0, F.concat(F.lit("mod"), (F.col("c_custkey") % 3).cast("string"), F.lit("/src/test/java/com/x/Foo"), s("c_custkey"), F.lit("Test.java"))).when(k == 1, F.concat(F.lit("src\\test\\kotlin\\a\\B"), s("c_custkey"), F.lit(".kt"))).when(k == 2, "src/main/java/q/R.java").when(k == 3, F.concat(F.lit("docs/readme"), s("c_custkey"), F.lit(".md"))).otherwise("Top.java")
    other = F.when(F.col("c_custkey") % 3 == 0, F.col("path")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("root/"), "path")).otherwise(F.concat(F.lit("zz"), "path"))
    c = t(spark, sf, "customer").select("c_custkey", path.alias("path")).withColumn("other", other)
    lines = text.line_of_offset(F.translate("path", "/", "\n"), (F.col("c_custkey") % 40).cast("int"))
    return c.select("c_custkey", text.test_class_of_path("path").alias("test_class"), text.module_of_path("path").alias("module"), text.path_is_suffix("path", "other").alias("is_suffix"), text.short_id("path", 30).alias("shown"), lines.cast("long").alias("at_slash"))


_STOP = ", ".join(f"'{x}'" for x in text.STOP_TERMS)


@query(f"""select item_id, md5(array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3 and x not in ({_STOP})), ' ')) as terms,
 md5(array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(upper(regexp_replace(text, '[^ -~]', '?', 'g')), '[^a-zA-Z0-9]+'), lambda x: length(x) >= 3 and regexp_matches(x, '^[A-Z]')), lambda x: lower(x)))), ' ')) as types, regexp_replace(regexp_extract(text || '  <|fim_pad|> rest', '^(.*?)<\\|fim_pad\\|>', 1, 's'), '\\s+$', '') = regexp_replace(text, '\\s+$', '') as cut from benchmark""")
def term_texts(spark, sf):
    b = t(spark, sf, "benchmark")
    return b.select("item_id", F.md5(F.array_join(text.query_terms(F.array("text")), " ")).alias("terms"), F.md5(F.array_join(F.array_sort(text.type_tokens(F.upper(F.regexp_replace("text", "[^ -~]", "?")))), " ")).alias("types"), (text.cut_completion(F.concat("text", F.lit("  <|fim_pad|> rest"))) == F.regexp_replace("text", r"\s+$", "")).alias("cut"))


@query("""select s_suppkey, ['int', 'long[]', 'java.util.List', 'x.Y[][]', 'boolean'][s_suppkey % 5 + 1] || case when s_suppkey % 2 = 1 then ',double' else '' end as params, ['void', 'int', 'q.R'][s_suppkey % 3 + 1] as returns from supplier""")
def jvm_descriptors(spark, sf):
    pick = lambda values, n: F.get(F.array(*(F.lit(v) for v in values)), (F.col("s_suppkey") % n).cast("int"))
    d = F.concat(F.lit("("), pick(["I", "[J", "Ljava/util/List;", "[[Lx/Y;", "Z"], 5), pick(["", "D"], 2), F.lit(")"), pick(["V", "I", "Lq/R;"], 3))
    return t(spark, sf, "supplier").select("s_suppkey", text.jvm_types(d).alias("j")).select("s_suppkey", F.array_join("j.params", ",").alias("params"), "j.returns")


_DECL = "\\b(?:(?:final\\s+)?(?:var|int|long|float|double|boolean|byte|char|short|String|[A-Z]\\w*(?:<[^>]*>)?))\\s+(\\w+)\\s*[=;,)]"
_WORDS = ", ".join(f"'{k}'" for k in text.KEYWORDS)
_BARE = ", ".join(f"'{k}'" for k in text.KEYWORDS if k not in text.LITERALS)
_SOURCE = "'int n' || page_id % 3 || ' = ' || page_id || '; String url; Foo other = call(url, \"s\", null); return url + n' || page_id % 3 || ' + 0x1F;' || chr(10) || regexp_replace(html, '[^\\x00-\\x7F]', '?', 'g')"


@query(f"""with c as (select page_id, {_SOURCE} as code from pages), d as (select *, list_filter(regexp_extract_all(code, '{_DECL}', 1), lambda x: x not in ({_WORDS}) and not regexp_matches(x, '^[A-Z]')) as found from c),
n as (select *, list_filter(found, lambda x, i: list_position(found, x) = i) as names from d), l as (select *, regexp_replace(regexp_replace(regexp_replace(code, '"(?:[^"\\\\]|\\\\.)*"', '_', 'g'), '''(?:[^''\\\\]|\\\\.)*''', '_', 'g'), '\\b(?:0[xXbB])?[0-9][0-9a-fA-F_]*\\.?[0-9a-fA-F_]*[fFdDlL]?\\b', '_', 'g') as bare from n)
select page_id, md5(array_to_string(list_transform(regexp_extract_all(code, '\\w+|\\W+'), lambda x: case when list_contains(names, x) then 'var' || list_position(names, x) else x end), '')) as unified,
 md5(array_to_string(list_transform(regexp_extract_all(bare, '\\w+|\\W+'), lambda x: case when regexp_matches(x, '^[a-z_]\\w*$') and x not in ({_BARE}) then '_' else x end), '')) as stripped from l""")
def code_identifiers(spark, sf):
    n = (F.col("page_id") % 3).cast("string")
    code = F.concat(F.lit("int n"), n, F.lit(" = "), s("page_id"), F.lit('; String url; Foo other = call(url, "s", null); return url + n'), n, F.lit(" + 0x1F;\n"), F.regexp_replace("html", r"[^\x00-\x7F]", "?"))
    p = t(spark, sf, "pages").select("page_id", code.alias("code"))
    return p.select("page_id", F.md5(text.unify_identifiers("code", True)).alias("unified"), F.md5(text.strip_identifiers("code", True)).alias("stripped"))


# Methods, index and requests ---------------------------------------------------------------------


def _methods(spark, sf):
    """One method for each part."""
    k = F.col("p_partkey")
    sibling = F.struct(F.concat(F.lit("void s"), s("p_partkey"), F.lit("()")).alias("signature"), F.lit("s").alias("methodName"), NONE().alias("parameterTypes"), F.lit("void").alias("returnType"), calls("q.Owner::a()", F.concat(F.lit("r.S"), (k % 3).cast("string"), F.lit("::b()")), "plain text").alias("invocations"), F.array(F.lit("u.T"), F.lit("u.V"), F.lit("u.T")).alias("usedTypes"))
    body = F.concat(F.lit("{ "), F.col("p_name"), F.lit(" }"))
    head = F.concat(F.lit("class K { "), F.repeat(F.lit("x"), (k % 700).cast("int")), F.lit(" void m() "))
    return t(spark, sf, "part").select(
        "p_partkey", "p_size", (k % 7 == 0).alias("is_covered"), F.concat(F.lit("src/K"), s("p_size"), F.lit(".java")).alias("filePath"), F.concat(F.lit("pkg.c"), s("p_size"), F.lit(".K"), (k % 10).cast("string")).alias("classFqn"), F.concat(F.lit("m"), s("p_partkey")).alias("methodName"),
        F.concat(F.lit("public Answer m"), s("p_partkey"), F.lit("(int n, java.lang.String s)")).alias("methodSignature"), F.lit("void").alias("returnType"), F.array(F.lit("int"), F.lit("java.lang.String")).alias("parameterTypes"), NONE().alias("thrownExceptions"), F.array(F.lit("java.util.Optional"), F.lit("w.Widget")).alias("imports"),
        F.array(F.struct(F.lit("f").alias("name"), F.lit("java.util.Queue<a.Thing>").alias("typeFqn"))).alias("classFields"), calls("a.B::f() -> void", "a.B::f() -> void", "zz.Long::g(int) -> int").alias("invocations"), F.array(F.lit("a.Bean")).alias("usedTypes"), F.array(F.lit("x.Base")).alias("supertypes"),
        F.array(sibling).alias("siblingMethods"), F.concat(head, body, F.lit(" tail "), "p_name", F.lit(" }")).alias("fileContent"), F.length(head).alias("bodyStartOffset"), (F.length(head) + F.length(body) - 1).alias("bodyEndOffset"), body.alias("methodBody"),
    )


@query("""select p_partkey, md5('package: pkg.c' || p_size || chr(10) || 'class: K' || p_partkey % 10 || chr(10) || repeat('signature: public Answer m' || p_partkey || '(int n, java.lang.String s)' || chr(10), 2) || 'returns: void' || chr(10) || 'params: int java.lang.String' || chr(10)
 || 'imports: java.util.Optional w.Widget' || chr(10) || 'fields: java.util.Queue<a.Thing>' || chr(10) || 'calls: a.B::f() -> void a.B::f() -> void zz.Long::g(int) -> int' || chr(10) || 'types: a.Bean') as card,
 'a.B::f() -> void x2' || chr(10) || 'zz.Long::g(int) -> int' || chr(10) || 'bigram: B::f -> B::f' || chr(10) || 'bigram: B::f -> Long::g' || chr(10) || 'trigram: B::f -> B::f -> Long::g' || chr(10) as profile,
 'String Queue Thing Bean Base' as types, 'pkg.c' || p_size || '.K' || p_partkey % 10 || '#m' || p_partkey || '#' || (20 + p_partkey % 700) as doc_id, length(p_name) + 4 as n_body from part""")
def index_documents(spark, sf):
    indexed = retrieval.index_documents(_methods(spark, sf)).withColumn("p_partkey", F.substring_index(F.substring_index("doc_id", "#m", -1), "#", 1).cast(dict(t(spark, sf, "part").dtypes)["p_partkey"]))
    return indexed.select("p_partkey", F.md5(F.col("fields")["card"]).alias("card"), F.col("fields")["profile"].alias("profile"), F.col("fields")["types"].alias("types"), "doc_id", F.length(F.col("fields")["body"]).alias("n_body"))


@query("""with n as (select count(*) as all_, count(*) filter (where p_partkey >= 10) as long_, count(*) filter (where p_size >= 10) as wide from part)
select 'type' as clause, 5e0 as boost, 'types' as field, 4 * all_ as n, all_ as n_queries from n union all select 'signature', 3e0, 'card', 2 * all_ + long_, all_ from n union all select 'package', 2e0, 'card', all_ + wide, all_ from n union all select 'invocation', 1e0, 'profile', all_, all_ from n""")
def query_clauses(spark, sf):
    q = _methods(spark, sf).select(F.col("p_partkey").alias("query"), "methodSignature", "classFqn", "supertypes", "imports", F.transform("classFields", lambda f: f["typeFqn"]).alias("classFields"), F.array(F.lit("Owner"), F.lit("List"), F.lit("Ab")).alias("siblingOwnerTypes"))
    return retrieval.build_query_terms(q).groupBy("clause", "boost", "field").agg(F.count("*").alias("n"), F.count_distinct("query").alias("n_queries"))


@query("""with h as (select p_partkey, p_size, p_name, 'class K { ' || repeat('x', p_partkey % 700) || ' void m() ' as head, '{ ' || p_name || ' }' as body from part), f as (select *, head || body || ' tail ' || p_name || ' }' as content from h)
select p_partkey, md5(right(head || '{', 500)) as prefix, md5('}' || ' tail ' || p_name || ' }') as suffix, ['Owner', 'plain text'] as owners, ['u.T', 'u.V'] as used, 'void s' || p_partkey || '()' as siblings, length(head) as at, md5(body) as target from f""")
def search_requests(spark, sf):
    made = requests.search_request(_methods(spark, sf), "p_partkey")
    r = lambda c: F.col(f"request.{c}")
    return made.select("p_partkey", F.md5(r("fimPrefix")).alias("prefix"), F.md5(r("fimSuffix")).alias("suffix"), r("siblingOwnerTypes").alias("owners"), r("siblingUsedTypes").alias("used"), F.array_join(r("siblingSignatures"), ";").alias("siblings"), r("targetBodyStartOffset").cast("long").alias("at"), F.md5("targetMethodBody").alias("target"))


@query("""select p_partkey, right(left(p_name, p_partkey % 12), 500) as prefix, substr(p_name, p_partkey % 12 + p_size % 5 + 1, 500) as suffix, case when p_partkey % 12 + p_size % 5 <= length(p_name) then substr(p_name, p_partkey % 12 + 1, p_size % 5) else '' end as target, p_size % 5 = 0 as empty from part""")
def plain_requests(spark, sf):
    start = (F.col("p_partkey") % 12).cast("int")
    rows = t(spark, sf, "part").select("p_partkey", "p_name", start.alias("at"), F.lit("f").alias("path"), requests.masking(start, start + (F.col("p_size") % 5).cast("int")).alias("mask"))
    made = requests.plain_request(rows, "p_partkey", "p_name", "at", "path", "mask").join(rows.select("p_partkey", "mask.empty"), "p_partkey")
    return made.select("p_partkey", F.col("request.fimPrefix").alias("prefix"), F.col("request.fimSuffix").alias("suffix"), F.col("targetMethodBody").alias("target"), "empty")


@query("""with r as (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) as n from supplier)
select s_nationkey, n as rank, 'S' || s_suppkey as id, 'a=' || printf('%.4f', s_suppkey / 7e0) || ', b=0.5000' as explain, count(*) over (partition by s_nationkey) as total from r""")
def search_responses(spark, sf):
    rows = t(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.concat(F.lit("S"), s("s_suppkey")).alias("id"), F.lit(1.0).alias("score"), F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.col("s_suppkey") / F.lit(7.0)).alias("tags"))
    made = requests.response(rows, "s_nationkey", "s_suppkey")
    return made.select("s_nationkey", F.col("totalResults").cast("long").alias("total"), F.explode("results").alias("r")).select("s_nationkey", F.col("r.rank").cast("long").alias("rank"), "r.id", "r.explain", "total")


@query("""select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and not ((c_mktsegment = 'BUILDING' and c_custkey % 4 = s_suppkey % 4) or c_custkey % 50 = s_suppkey % 50)""")
def leak_filter(spark, sf):
    q = t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("q_class"), (F.col("c_custkey") % 4).alias("q_offset"), (F.col("c_custkey") % 50).alias("q_path"))
    d = t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), F.lit("BUILDING").alias("class_fqn"), (F.col("s_suppkey") % 4).alias("offset"), (F.col("s_suppkey") % 50).alias("path"))
    return q.join(d, "n").filter(~retrieval.index_leak("class_fqn", "offset", "path", "q_class", "q_offset", "q_path")).select("c_custkey", "s_suppkey")


@query("""select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and (c_custkey % 9 = s_suppkey % 9 or (c_custkey % 2 = 1 and c_custkey % 5 = s_suppkey % 5))""")
def external_leaks(spark, sf):
    q = t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.concat(F.lit("lib\\d"), (F.col("c_custkey") % 9).cast("string"), F.lit("\\A.java")).alias("q_path"), F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("C"), (F.col("c_custkey") % 5).cast("string"))).otherwise("").alias("q_class"))
    d = t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), F.concat(F.lit("root/lib/d"), (F.col("s_suppkey") % 9).cast("string"), F.lit("/A.java")).alias("path"), F.concat(F.lit("C"), (F.col("s_suppkey") % 5).cast("string")).alias("class_fqn"))
    leak = retrieval.external_leak("path", "q_path", "class_fqn", "q_class")
    return retrieval.paired_by_verdict(q, d, "n", ["q_path", "q_class"], ["path", "class_fqn"], leak).select("c_custkey", "s_suppkey")


_CASES = "case when p_size % 11 = 0 or p_brand like '%5' then 'TEST' when p_size % 13 = 0 then 'GENERATED' when p_size % 3 = 0 and p_partkey % 3 = 0 and (p_size % 2 = 0 or p_partkey % 2 = 0) then 'GETTER' when p_size % 2 = 1 and p_partkey % 3 = 1 and p_size % 3 = 1 and p_partkey % 2 = 1 and p_size % 5 < 2 then 'SETTER' when p_size % 2 = 1 and p_size % 5 >= 2 and p_partkey % 3 = p_size % 3 then 'DELEGATOR' else 'NORMAL' end"


@query(f"select {_CASES} as category, count(*) as n from part group by all")
def method_categories(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    rows = t(spark, sf, "part").select(
        (z % 11 == 0).alias("inTestSource"), F.filter(F.array(F.when(F.col("p_brand").endswith("5"), F.lit("org.junit.Test")), F.when(z % 13 == 0, F.lit("Generated")), F.lit("Override")), lambda x: x.isNotNull()).alias("annotations"),
        F.when(z % 3 == 0, "getIt").when(z % 3 == 1, "setIt").otherwise("run").alias("methodName"), (k % 3).alias("nParameters"), F.lit(True).alias("hasBody"), (z % 2).alias("nStatements"),
        F.when(k % 2 == 0, "return").otherwise("expression").alias("statementKind"), F.when(z % 5 < 2, "assignment").otherwise("call").alias("statementPart"), (z % 3).alias("nArguments"),
    )
    return rows.groupBy(dataset.category().alias("category")).agg(F.count("*").alias("n"))


@query("select a.s_suppkey, count(b.s_suppkey) as n, coalesce(string_agg(b.s_suppkey, ',' order by b.s_suppkey), '') as others from supplier a left join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey group by all")
def sibling_methods(spark, sf):
    rows = dataset.siblings(t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", s("s_suppkey").alias("name")), "s_nationkey", "s_suppkey", ["name"])
    return rows.select("s_suppkey", F.size("siblings").cast("long").alias("n"), F.array_join(F.transform("siblings", lambda x: x["name"]), ",").alias("others"))


@query("select p_partkey, left(p_name, p_partkey % 5) || '<new>' || substr(p_name, p_partkey % 5 + p_size % 4 + 1) as content from part")
def substituted_bodies(spark, sf):
    at = (F.col("p_partkey") % 5).cast("int")
    rows = t(spark, sf, "part").select("p_partkey", "p_name", at.alias("lo"), (at + (F.col("p_size") % 4).cast("int")).alias("hi"), F.lit("<new>").alias("g"))
    return rows.select("p_partkey", dataset.substituted("p_name", "lo", "hi", "g").alias("content"))


@query("select count(distinct p_size) as n_files, count(*) as n_methods, cast(0 as bigint) as n_unresolved, count(*) filter (where p_partkey % 7 = 0) as covered from part")
def extraction_totals(spark, sf):
    m = _methods(spark, sf)
    return analysis.extraction_totals(m).join(F.broadcast(analysis.coverage_totals(m).select("covered")))  # one row each


# Metrics and modes -------------------------------------------------------------------------------

_TOK = "[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+(?:\\.[0-9]+)?|[^\\s]"


@query(f"""with b as (select item_id, regexp_replace(text, '[^ -~]', '?', 'g') as x from benchmark), p as (select a.item_id, a.x, b.x as y from b a join b on b.item_id = a.item_id + 1), k as (select *, regexp_extract_all(x, '{_TOK}') as tx, regexp_extract_all(y, '{_TOK}') as ty from p)
select item_id, x = y as em, round(1e0 - levenshtein(x, y) / greatest(length(x), length(y)), 6) as es, cast(len(tx) as int) as gen_token_count, cast(len(ty) as int) as ref_token_count, true as bounds_hold, cast(null as double) as codebleu from k""")
def metric_bundle(spark, sf):
    b = t(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "?").alias("generated"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("generated").alias("ground_truth")), "item_id").select("item_id", "generated", "ground_truth", F.struct(F.lit(True).alias("compilable"), F.lit(-1.0).alias("es")).alias("metrics"))
    m = scoring.recompute(pairs, unify=False)
    x = lambda c: F.col(f"metrics.{c}")
    holds = x("compilable") & (x("lcs_length") <= F.least(x("gen_token_count"), x("ref_token_count"))) & (x("lcsubstring_no_ident_length") <= x("lcs_no_ident_length")) & (F.size(x("lcs_tokens")) == x("lcs_length")) & x("iou").between(0, 1)
    return m.select("item_id", x("em").alias("em"), r6(x("es"), "es"), x("gen_token_count").alias("gen_token_count"), x("ref_token_count").alias("ref_token_count"), holds.alias("bounds_hold"), x("codebleu").alias("codebleu"))


@query(f"""with {_PAIRS}, c as (select unnest(list_filter([case when other_recall = 0 then 'zero' end, case when other_recall > 0 then 'some' end, case when other_recall >= 0.5 then 'high' end], lambda x: x is not null)) as condition, delta_es from p)
select condition, count(*) as n, round(avg(delta_es), 6) as mean_delta from c group by all""")
def conditional_means(spark, sf):
    return analysis.conditional_means(_pairs(spark, sf), "other_recall", ["delta_es"]).select("condition", "n", r6("mean_delta_es", "mean_delta"))


@query(f"""with {_PAIRS}, m as (select distinct user_id, event_type as slice from events union all select distinct user_id, 'all' from events union all select -1, 'view')
select slice, count(*) as n, round(avg(delta_es), 6) as mean_delta, round(avg(other_recall), 6) as mean_recall, count(*) filter (where delta_es > 0.02e0) as helped, count(*) filter (where delta_es < -0.02e0) as hurt from m join p using (user_id) where slice <> 'all' group by all""")
def slice_deltas(spark, sf):
    """Means are taken by event_id: its SQL, run by one thread over a table in this order, adds so, and differences of 0.02 exactly hang on it."""
    e = t(spark, sf, "events")
    unknown = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit("view").alias("slice"))
    members = e.select("user_id", F.col("event_type").alias("slice")).distinct().unionByName(e.select("user_id", F.lit("all").alias("slice")).distinct()).unionByName(unknown)
    means = analysis.ordered_means(_samples(spark, sf), ["user_id", "event_type"], "event_id", ["value", "k"]).select("user_id", "event_type", (F.col("value") / 100).alias("es"), (F.col("k") / 100).alias("recall"))
    pairs = analysis.pair_modes(means, "event_type", ["user_id"], "view", "purchase", ["es", "recall"])
    return analysis.slice_deltas(pairs, members, "user_id", "delta_es", ["other_recall"]).select("slice", "n", r6("mean_delta_es", "mean_delta"), r6("mean_other_recall", "mean_recall"), "helped", "hurt")


@query("select user_id, string_agg(event_type || '=' || n, ';' order by event_type) as modes from (select user_id, event_type, count(*) as n from events group by all) group by all")
def modes_by_index(spark, sf):
    rows = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    shown = F.transform(F.array_sort(F.map_entries("modes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["n"].cast("string")))
    return analysis.by_mode(rows, "user_id", "event_type", ["n"]).select("user_id", F.array_join(shown, ";").alias("modes"))


@query("""select fact, round(max(v) filter (where event_type = 'click'), 6) as click, round(max(v) filter (where event_type = 'view'), 6) as "view" from (select event_type, 'value' as fact, avg(value) as v from events group by all union all select event_type, 'user_id', avg(user_id) from events group by all) group by all""")
def mode_table(spark, sf):
    return analysis.mode_table(t(spark, sf, "events"), "event_type", ["click", "view"], ["value", "user_id"]).select("fact", r6("click", "click"), r6("view", "view"))


@query("select event_id, case when event_type = 'view' then case when user_id % 3 = 0 then 0e0 else round(value, 6) end end as recall_at_k from events")
def zero_hit_metrics(spark, sf):
    rows = t(spark, sf, "events").withColumn("recall_at_k", F.col("value"))
    made = scoring.zero_hits(F.col("event_type") == "view", (F.col("user_id") % 3).cast("int"), ["recall_at_k"])
    return rows.select("event_id", r6(made["recall_at_k"], "recall_at_k"))


@query("select o_orderkey, case when o_orderstatus = 'O' then null when o_custkey % 7 = 0 or o_custkey % 3 = 0 then 'Skipped: non-public method' when o_custkey % 5 = 0 then 'Skipped: code does not compile' end as why from orders")
def untested_verdicts(spark, sf):
    kind = "struct<success:boolean>"
    rows = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", F.struct(F.lit(True).alias("success"))).otherwise(F.lit(None).cast(kind)).alias("test_eval"), F.when((F.col("o_custkey") % 7 == 0) | (F.col("o_custkey") % 3 == 0), "void m()").otherwise("public void m()").alias("method_signature"), (F.col("o_custkey") % 5 != 0).alias("compilable"))
    return rows.select("o_orderkey", F.get(scoring.untested()["error_messages"], 0).alias("why"))


# Relations of failures ---------------------------------------------------------------------------


@query("""with n as (select event_id, case event_id % 6 when 0 then 'com.x.FooTest.testBar[1]' when 1 then 'com.x.FooTest.other' when 2 then 'FooTest' when 3 then 'org.BarTest.baz' when 4 then 'org.Zed.quux' else 'com.x.BazIT.testBar' end as name, event_id % 4 as k from events)
select event_id, cast(case when name like 'com.x.FooTest.testBar%' and k < 2 then 4 else 0 end + case when (name like 'com.x.FooTest.%' or name = 'FooTest') and k < 3 then 2 else 0 end + case when name like '%FooTest%' and k <> 3 then 1 else 0 end + case when contains(lower(name), 'bar') then 1 else 0 end as int) as score from n""")
def relation_scores(spark, sf):
    from lodestone.operators.mining import related

    k = F.col("event_id") % 4
    names = F.array(*(F.lit(x) for x in ("com.x.FooTest.testBar[1]", "com.x.FooTest.other", "FooTest", "org.BarTest.baz", "org.Zed.quux", "com.x.BazIT.testBar")))
    one = F.struct(F.lit(None).cast("string").alias("test_file"), F.lit("FooTest").alias("test_class"), F.lit("testBar").alias("test_method"))
    two = F.struct(F.lit("m/src/test/java/com/x/FooTest.java").alias("test_file"), F.lit("").alias("test_class"), F.lit("testBar").alias("test_method"))
    nothing = F.array().cast("array<struct<test_file:string,test_class:string,test_method:string>>")
    rows = t(spark, sf, "events").select(
        "event_id", F.when(k == 3, "none").otherwise("com.x.Foo#bar").alias("method_id"), F.when(k == 3, "public void bar(int x)").alias("method_signature"), F.struct(F.array(F.get(names, (F.col("event_id") % 6).cast("int"))).alias("failed_test_names")).alias("test_eval"),
        F.when(k == 0, F.array(one)).when(k == 1, F.array(two)).otherwise(nothing).alias("direct_test_methods"), F.when(k < 3, F.array(F.lit("m/src/test/java/com/x/FooTest.java"))).alias("test_file_paths"),
    )
    return related(rows).select("event_id", F.col("relation_score").cast("int").alias("score"))


# Calls as graphs ---------------------------------------------------------------------------------


def _call_methods(spark, sf):
    """A method for each nation, whose calls are the rows of ``_call_rows``; every third has a sibling that calls itself."""
    k = F.col("n_nationkey")
    own = F.concat(F.lit("pkg.N"), k.cast("string"))
    sibling = F.struct(F.lit("void help(int a)").alias("signature"), F.lit("help").alias("methodName"), F.array(F.lit("int")).alias("parameterTypes"), F.lit("void").alias("returnType"), calls(F.concat(own, F.lit("::help(int) -> void"))).alias("invocations"))
    return t(spark, sf, "nation").select(k.alias("ord"), own.alias("classFqn"), F.lit("run").alias("methodName"), NONE().alias("parameterTypes"), F.lit(None).cast("string").alias("returnType"), F.array().cast(NO_CALLS).alias("invocations"), F.when(k % 3 == 0, F.array(sibling)).otherwise(F.slice(F.array(sibling), 1, 0)).alias("siblingMethods"), F.concat(F.lit("{ "), "n_name", F.lit(" }")).alias("methodBody"))


def _call_rows(spark, sf):
    """The calls of these methods: their customers' order lines, a row each."""
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = lines.join(t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    return ends.select(F.col("src").alias("method"), F.concat(F.lit("pkg.N"), F.col("dst").cast("string"), F.lit("::run() ->  void")).alias("signature"), F.lit("EXACT").alias("resolutionMode"))


def _call_graph(spark, sf):
    """(vertices, edges) of these methods; both are stored, since most queries read them more than once."""
    v = graph.flatten_vertices(_call_methods(spark, sf), "ord")
    return v, stored(graph.edges(v, _call_rows(spark, sf)))


_V = "v as (select 'pkg.N' || n_nationkey || '::run() -> void' as vertex_id, 'pkg.N' || n_nationkey as c, 'run' as m, '{ ' || n_name || ' }' as body from nation union all select 'pkg.N' || n_nationkey || '::help(int) -> void', 'pkg.N' || n_nationkey, 'help', 'void help(int a)' from nation where n_nationkey % 3 = 0), i as (select *, row_number() over (order by vertex_id) - 1 as idx from v)"
_CE = f"{_EDGES}, ce as (select 'pkg.N' || src || '::run() -> void' as src, 'pkg.N' || dst || '::run() -> void' as dst, weight from e union all select vertex_id, vertex_id, 1 from v where m = 'help')"


@query(f"with {_V}, {_CE} select * from ce")
def call_graph_edges(spark, sf):
    return _call_graph(spark, sf)[1]


@query(f"with {_V}, {_CE} select a.idx as src_idx, b.idx as dst_idx, weight from ce join i a on a.vertex_id = src join i b on b.vertex_id = dst")
def call_graph_adjacency(spark, sf):
    return graph.adjacency(*_call_graph(spark, sf))


_DEGREES = "d as (select i.*, coalesce((select sum(weight) from ce where src = vertex_id), 0) as o, coalesce((select sum(weight) from ce where dst = vertex_id), 0) as n from i)"


@query(f"with {_V}, {_CE}, {_DEGREES} select idx, vertex_id, 'pkg' as package, cast(o as bigint) as out_degree, cast(n as bigint) as in_degree, body, row_number() over (order by o desc, idx) - 1 as by_out, row_number() over (order by c, m, idx) - 1 as by_class from d")
def call_graph_payload(spark, sf):
    shown = graph.payload(*_call_graph(spark, sf), _call_methods(spark, sf), "ord")
    both = graph.ordered(shown, "out", "by_out").join(graph.ordered(shown, "class", "by_class").select("idx", "by_class"), "idx")
    return both.select("idx", "vertex_id", "package", "out_degree", "in_degree", "body", "by_out", "by_class")


@query(f"""with {_V}, {_CE} select 'ends_known' as check_name, (select count(*) from ce where src not in (select vertex_id from v) or dst not in (select vertex_id from v)) = 0 as ok union all select 'weights_positive', (select bool_and(weight > 0) from ce)
 union all select 'pairs_unique', (select count(*) = count(distinct (src, dst)) from ce) union all select 'ids_unique', (select count(*) = count(distinct vertex_id) from v) union all select 'weights_integer', (select bool_and(weight = floor(weight)) from ce) union all select 'numbers_dense', (select min(idx) = 0 and max(idx) = count(*) - 1 from i)""")
def call_graph_checks(spark, sf):
    return graph.sanity(*_call_graph(spark, sf))


@query(f"with {_V}, {_CE}, {_DEGREES} select idx as src_idx, cast(o as bigint) as total, (select count(*) from i) as n from d")
def call_graph_dense(spark, sf):
    return graph.dense(*_call_graph(spark, sf)).select("src_idx", F.aggregate("weights", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("weights").cast("long").alias("n"))


@query("""with e as (select user_id, list(event_type || '::x()' order by ts, event_id) as l from events group by all), f as (select *, list_filter(l, lambda x, i: list_position(l, x) = i) as firsts, list_transform(l, lambda x: split_part(x, '(', 1)) as sh from e)
select user_id, md5(array_to_string(list_concat(list_transform(firsts, lambda x: x || case when len(list_filter(l, lambda y: y = x)) > 1 then ' x' || len(list_filter(l, lambda y: y = x)) else '' end), list_transform(range(1, len(l)), lambda i: 'bigram: ' || sh[i] || ' -> ' || sh[i + 1]), list_transform(range(1, len(l) - 1), lambda i: 'trigram: ' || sh[i] || ' -> ' || sh[i + 1] || ' -> ' || sh[i + 2])), chr(10)) || chr(10)) as profile from f""")
def invocation_profiles(spark, sf):
    from pyspark.sql import Window

    numbered = t(spark, sf, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    made = numbered.groupBy("user_id").agg(F.collect_list(F.struct(F.concat("event_type", F.lit("::x()")).alias("signature"), F.lit("EXACT").alias("resolutionMode"), F.col("i").alias("orderIndex"))).alias("invocations"))
    return made.select("user_id", F.md5(retrieval.invocation_profile()).alias("profile"))


@query("""with o as (select c_custkey, list_transform(range(0, c_custkey % 4), lambda i: {'owner': ['Build', 'Auto', 'Zed'][i % 3 + 1], 'method': ['ing', 'mobile', 'q'][i % 3 + 1]}) as oracle, c_mktsegment as seg from customer)
select c_custkey, round(case when len(oracle) = 0 then 1e0 when seg = '' then 0e0 else len(list_filter(oracle, lambda x: contains(lower(seg), lower(x.owner)) and contains(lower(seg), lower(x.method)))) / len(oracle) end, 6) as recall from o""")
def invocation_recalls(spark, sf):
    pick = lambda values, i: F.get(F.array(*(F.lit(v) for v in values)), (i % 3).cast("int"))
    n = (F.col("c_custkey") % 4).cast("int")
    oracle = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < n), lambda i: F.struct(pick(["Build", "Auto", "Zed"], i).alias("owner"), pick(["ing", "mobile", "q"], i).alias("method")))
    return t(spark, sf, "customer").select("c_custkey", oracle.alias("oracle"), "c_mktsegment").select("c_custkey", r6(metrics.invocation_recall("oracle", "c_mktsegment"), "recall"))
