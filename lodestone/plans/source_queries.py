"""Queries over Java sources that are spelled from the synthetic tables, and over documents written from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators import graph, syntax
from lodestone.plans.queries import query, t
from lodestone.session import shared_folder, stored
from lodestone.sources.documents import read_elements, write_elements

# A source per customer; {k} is its key and {m} what is left of it by 5. SQL and Spark spell it from the same text.
_SOURCE = """package p.n{n};

import q.R{m};
import java.util.*;

/** { not code } */
public class C{k}<T extends Number> extends B<T> implements I{m}, java.io.Closeable {
  private final Map<String, List<T>> seen = new HashMap<>(), more;
  int[] sizes = {1, {k}};
  C{k}(R{m} given) { super(given); }
  @Deprecated(since = "{m}") public static long run(int a, final R{m} r, String... rest) throws Oops {
    if (a < {k} && a > {m}) { return add(a, r.size()); } else stop();
    String text = "x) } " + '"'; // { no
    for (Item i : items) { r.put(text, new Box<T>(i)).then().go(i); }
    return (long) a;
  }
  static long add(int x, int y) { return x + y; }
}
"""
_STRIPPED = """package p.n{n};

import q.R{m};
import java.util.*;

/** { not code } */
public class C{k}<T extends Number> extends B<T> implements I{m}, java.io.Closeable {
  private final Map<String, List<T>> _ = new HashMap<>(), _;
  int[] _ = {_, _};
  C{k}(R{m} _) { super(_); }
  @Deprecated(_ = _) public static long run(int _, final R{m} _, String... _) throws Oops {
    if (_ < _ && _ > _) { return add(_, r.size()); } else stop();
    String _ = _ + _; // { no
    for (Item _ : _) { r.put(_, new Box<T>(_)).then().go(_); }
    return (long) _;
  }
  static long add(int _, int _) { return _ + _; }
}
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _spelled(template: str) -> str:
    """The template with a row's numbers, in SQL that both engines know."""
    return f"replace(replace(replace({_quoted(template)}, '{{k}}', cast(c_custkey as varchar(20))), '{{m}}', cast(c_custkey % 5 as varchar(20))), '{{n}}', cast(c_nationkey as varchar(20)))"


def _sources(spark, sf):
    """Sources spelled from a small table; its rows are dealt first, else one task would spell and cut them all."""
    rows = t(spark, sf, "customer").select("c_custkey", "c_nationkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    text = F.lit(_SOURCE)
    for mark, value in (("{k}", F.col("c_custkey")), ("{m}", F.col("c_custkey") % 5), ("{n}", F.col("c_nationkey"))):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return rows.select(F.col("c_custkey").alias("path"), text.alias("text"))


_RUN = _SOURCE[_SOURCE.index("{\n    if") : _SOURCE.index("\n  static long add")]


@query(rf"""with c as (select c_custkey, {_spelled('p.n{n}.C{k}')} as fqn, {_spelled('R{m}')} as r, {_spelled('I{m}')} as i from customer),
 m as (select c_custkey as file, fqn, r, i, unnest([struct_pack(sig := 'C' || c_custkey || '(' || r || ' given)', returns := null, params := r, thrown := '', n := 1, calls := 'UNRESOLVED<super>', used := '', body := '{{ super(given); }}'),
  struct_pack(sig := 'public static long run(int a, ' || r || ' r, String... rest)', returns := 'long', params := 'int;' || r || ';String[]', thrown := 'Oops', n := 4,
   calls := fqn || '::add(int, int) -> long;UNRESOLVED<size>;UNRESOLVED<stop>;UNRESOLVED<go>;UNRESOLVED<then>;UNRESOLVED<put>;UNRESOLVED<<init>(Box<T>)>', used := 'String;Item;Box;T', body := {_spelled(_RUN)}),
  struct_pack(sig := 'static long add(int x, int y)', returns := 'long', params := 'int;int', thrown := '', n := 1, calls := '', used := '', body := '{{ return x + y; }}')]) as x from c join customer using (c_custkey))
select file, fqn, x.sig as signature, x.returns, x.params, x.thrown, x.n as statements, x.calls, x.used, md5(x.body) as body, 'q.' || r || ';java.util' as imports, 'seen Map<String,List<T>>;more Map<String,List<T>>;sizes int[]' as fields, 'B<T>;' || i || ';java.io.Closeable' as supers, 'NORMAL' as category, 2 as n_siblings from m""")
def extracted_methods(spark, sf):
    rows = syntax.with_siblings(syntax.extract(_sources(spark, sf)))
    joined = lambda c: F.array_join(c, ";")
    calls, fields = F.transform("invocations", lambda i: i["signature"]), F.transform("classFields", lambda f: F.concat_ws(" ", f["name"], f["typeFqn"]))
    return rows.select(
        F.col("filePath").alias("file"), F.col("classFqn").alias("fqn"), F.col("methodSignature").alias("signature"), F.col("returnType").alias("returns"), joined("parameterTypes").alias("params"), joined("thrownExceptions").alias("thrown"),
        F.col("statementCount").alias("statements"), joined(calls).alias("calls"), joined("usedTypes").alias("used"), F.md5("methodBody").alias("body"), joined("imports").alias("imports"), joined(fields).alias("fields"), joined("supertypes").alias("supers"), "category", F.size("siblingMethods").alias("n_siblings"),
    )


@query(f"select c_custkey as file, md5({_spelled(_STRIPPED)}) as stripped from customer")
def stripped_by_syntax(spark, sf):
    return syntax.strip_by_syntax(_sources(spark, sf)).select("file", F.md5("stripped").alias("stripped"))


@query("select p_partkey, p_name, p_size, '{\"[' || p_brand || '\\}' as odd, row_number() over (order by p_partkey) > 0 as placed from part")
def split_document(spark, sf):
    """One JSON document, written from a table and read by splits."""
    path = f"{shared_folder(spark)}/document-{uuid.uuid4().hex}"
    rows = t(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.concat(F.lit('{"['), "p_brand", F.lit("\\}")).alias("odd"))
    write_elements(rows, path, "methods", {"meta": {"methods": [{"p_partkey": -1}]}, "classpath": ["a]}"]})
    found = read_elements(spark, path, "methods", "p_partkey long, p_name string, p_size int, odd string")
    kind = dict(rows.dtypes)
    return found.select(F.col("element.p_partkey").cast(kind["p_partkey"]).alias("p_partkey"), "element.p_name", F.col("element.p_size").cast(kind["p_size"]).alias("p_size"), "element.odd", (F.col("ord") >= 0).alias("placed"))


@query(f"select {_spelled('p.n{n}.C{k}::run(int,R{m},String[]) -> long')} as src, {_spelled('p.n{n}.C{k}::add(int,int) -> long')} as dst, cast(1 as bigint) as weight from customer")
def source_call_graph(spark, sf):
    """From sources to the edges of their call graph: extraction, siblings, vertices, exact calls between them."""
    rows = stored(syntax.with_siblings(syntax.extract(_sources(spark, sf))).drop("fileContent"))
    return graph.edges(graph.flatten_vertices(rows.withColumn("ord", F.struct("filePath", "bodyStartOffset")), "ord"))


@query(f"""select c_custkey as index, {_spelled('p.n{n}.C{k}')} || '::add(int, int) -> long;UNRESOLVED<go>;UNRESOLVED<<init>(R' || c_custkey % 5 || ')>' as calls, cast(null as varchar) as error from customer where c_custkey % 7 > 0
 union all select c_custkey, '', 'no generated body' from customer where c_custkey % 7 = 0""")
def body_calls_in_place(spark, sf):
    """Calls of generated bodies in the files that they are put into."""
    k, rows = F.col("path"), _sources(spark, sf)
    at = F.instr("text", "throws Oops {") + F.lit(len("throws Oops {") - 2)
    end = F.instr("text", "  static long add") - F.lit(2)
    body = F.concat(F.lit(" return add(1, a) + go(\"}\", new R"), (k % 5).cast("string"), F.lit("()); "))
    bodies = rows.select(k.alias("index"), F.col("text").alias("fileContent"), at.cast("int").alias("bodyStartOffset"), end.cast("int").alias("bodyEndOffset"), F.when(k % 7 > 0, body).alias("generatedBody"))
    found = syntax.calls_in_place(bodies)
    return found.select("index", F.array_join(F.transform("invocations", lambda i: i["signature"]), ";").alias("calls"), "error")
