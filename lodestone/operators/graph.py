"""Weighted call graphs as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import canonical_invocation, package_of, vertex_id
from lodestone.operators.dataset import row_numbers, seeded_sample


def flatten_vertices(methods: DataFrame, order: str) -> DataFrame:
    """(idx, vertex_id, ...): methods and their siblings, one row per id, first in input order, numbered by id.

    A method comes before its siblings; ``order`` numbers the methods. ``ord`` says where a vertex comes from: its method's number
    and, of a sibling, its place (a method's own is -1)."""
    own = methods.select(F.struct(F.col(order).alias("m"), F.lit(-1).alias("p")).alias("ord"), vertex_id("classFqn", "methodName", "parameterTypes", "returnType").alias("vertex_id"), "classFqn", "methodName", "invocations")
    siblings = methods.select(F.col(order), "classFqn", F.posexplode("siblingMethods").alias("pos", "s"))
    siblings = siblings.select(F.struct(F.col(order).alias("m"), F.col("pos").alias("p")).alias("ord"), vertex_id("classFqn", "s.methodName", "s.parameterTypes", "s.returnType").alias("vertex_id"), "classFqn", F.col("s.methodName").alias("methodName"), F.col("s.invocations").alias("invocations"))
    both = own.unionByName(siblings)
    first = both.groupBy("vertex_id").agg(F.min_by(F.struct("classFqn", "methodName", "invocations", "ord"), "ord").alias("r")).select("vertex_id", "r.*")
    return row_numbers(first, ["vertex_id"], "idx")


def edges(vertices: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): exact calls between vertices, self-loops kept.

    ``calls`` (method, signature, resolutionMode; one row per call) are those of methods by their numbers, beside what the vertices
    hold in arrays: they are counted before they meet a vertex, so a method may have any number of them."""
    made = vertices.select(F.col("vertex_id").alias("src"), F.explode("invocations").alias("i")).filter("i.resolutionMode = 'EXACT'").select("src", canonical_invocation("i.signature").alias("dst"), F.lit(1).cast("long").alias("n"))
    if calls is not None:
        told = calls.filter("resolutionMode = 'EXACT'").groupBy("method", "signature").agg(F.count("*").alias("n"))
        own = vertices.filter("ord.p < 0").select(F.col("ord.m").alias("method"), F.col("vertex_id").alias("src"))
        made = made.unionByName(told.join(own, "method").select("src", canonical_invocation("signature").alias("dst"), "n"))
    counted = made.groupBy("src", "dst").agg(F.sum("n").alias("weight"))
    return counted.join(vertices.select(F.col("vertex_id").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")


def degrees(vertices: DataFrame, edge: DataFrame, vertex: str = "vertex_id") -> DataFrame:
    """Weighted out, in and total degree of every vertex. One grouping of both ends serves all three."""
    ends = edge.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("weight").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).cast("long").alias("o"), F.col("weight").alias("i")))).alias("e")).select("e.*")
    summed = ends.groupBy("v").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).withColumnRenamed("v", vertex)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = vertices.select(vertex).join(summed, vertex, "left")
    return joined.select(vertex, zero("out_degree").alias("out_degree"), zero("in_degree").alias("in_degree"), (zero("out_degree") + zero("in_degree")).alias("total_degree"))


def stats(degree: DataFrame, edge: DataFrame) -> DataFrame:
    """One row: vertices, edges, weight, density (0 without vertices), self-loops, isolated vertices."""
    v = degree.agg(F.count("*").alias("n_vertices"), F.count_if(F.col("total_degree") == 0).alias("n_isolated"))
    e = edge.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("total_weight"), F.count_if(F.col("src") == F.col("dst")).alias("n_self_loops"))
    n = F.col("n_vertices").cast("double")
    return v.join(F.broadcast(e)).withColumn("density", F.when(n > 0, F.col("n_edges") / (n * n)).otherwise(0.0))  # one row each


def top(degree: DataFrame, column: str, vertex: str = "vertex_id", n: int = 10) -> DataFrame:
    return degree.filter(F.col(column) > 0).orderBy(F.desc(column), vertex).limit(n)


def seeded_pick(degree: DataFrame, order: str, seed: int, n: int = 5) -> DataFrame:
    """n vertices that call others, picked as ``random.Random(seed).sample`` picks from them in order, with ``sample_pos``."""
    return seeded_sample(degree.filter("out_degree > 0"), [order], n, seed, shuffle_all=True)


def weight_counts(edge: DataFrame) -> DataFrame:
    return edge.groupBy("weight").agg(F.count("*").alias("n"))


def histogram(values: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """(bucket, low, high, n): equal widths, the upper end in the last; one bucket where all are equal."""
    ends = values.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))  # one row
    placed = values.select(F.col(column).cast("double").alias("v")).join(F.broadcast(ends))
    bucket = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))).cast("int")
    counted = placed.groupBy(bucket.alias("bucket"), "lo", "hi").agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / buckets
    return counted.select("bucket", (F.col("lo") + F.col("bucket") * width).alias("low"), (F.col("lo") + (F.col("bucket") + 1) * width).alias("high"), "n")


def sanity(vertices: DataFrame, edge: DataFrame, vertex: str = "vertex_id") -> DataFrame:
    """(check_name, ok) of the store: ends known, weights positive, pairs and ids unique, numbers dense."""
    ends = edge.select(F.explode(F.array("src", "dst")).alias(vertex))
    known = ends.join(vertices.select(vertex), vertex, "left_anti")
    one = lambda name, df, ok: df.agg(F.coalesce(ok, F.lit(True)).alias("ok")).select(F.lit(name).alias("check_name"), "ok")
    out = one("ends_known", known, F.count("*") == 0)
    out = out.unionByName(one("weights_positive", edge, F.bool_and(F.col("weight") > 0)))
    out = out.unionByName(one("pairs_unique", edge.groupBy("src", "dst").count(), F.bool_and(F.col("count") == 1)))
    out = out.unionByName(one("ids_unique", vertices.groupBy(vertex).count(), F.bool_and(F.col("count") == 1)))
    out = out.unionByName(one("weights_integer", edge, F.bool_and(F.col("weight") == F.floor("weight"))))
    if "idx" in vertices.columns:
        out = out.unionByName(one("numbers_dense", vertices, (F.count("*") == 0) | ((F.min("idx") == 0) & (F.max("idx") == F.count("*") - 1))))
    return out


def adjacency(vertices: DataFrame, edge: DataFrame) -> DataFrame:
    """(src_idx, dst_idx, weight): the sparse matrix."""
    i, j = vertices.select(F.col("vertex_id").alias("src"), F.col("idx").alias("src_idx")), vertices.select(F.col("vertex_id").alias("dst"), F.col("idx").alias("dst_idx"))
    return edge.join(i, "src").join(j, "dst").select("src_idx", "dst_idx", "weight")


def incident(edge: DataFrame, way: str = "out") -> DataFrame:
    """Edges of each vertex, the heaviest first."""
    a, b = ("src", "dst") if way == "out" else ("dst", "src")
    return edge.select(F.col(a).alias("vertex_id"), F.col(b).alias("other"), "weight", F.row_number().over(Window.partitionBy(a).orderBy(F.desc("weight"), b)).alias("nth"))


def payload(vertices: DataFrame, edge: DataFrame, methods: DataFrame, order: str) -> DataFrame:
    """Vertices as a viewer shows them: number, names, package, degrees and the first body by class and name ('' without one).

    A method's own body comes before the signatures of its siblings; ``order`` numbers the methods."""
    own = methods.select(F.struct(F.col(order).alias("m"), F.lit(-1).alias("p")).alias("ord"), "classFqn", "methodName", F.col("methodBody").alias("body"))
    siblings = methods.select(F.col(order), "classFqn", F.posexplode("siblingMethods").alias("p", "s")).select(F.struct(F.col(order).alias("m"), "p").alias("ord"), "classFqn", F.col("s.methodName").alias("methodName"), F.col("s.signature").alias("body"))
    bodies = own.unionByName(siblings).groupBy("classFqn", "methodName").agg(F.min_by(F.coalesce("body", F.lit("")), "ord").alias("body"))
    degree = degrees(vertices, edge).select("vertex_id", "out_degree", "in_degree")
    named = vertices.join(degree, "vertex_id").join(bodies, ["classFqn", "methodName"], "left")
    return named.select("idx", "vertex_id", "classFqn", "methodName", package_of("classFqn").alias("package"), "out_degree", "in_degree", F.coalesce("body", F.lit("")).alias("body"))


def ordered(shown: DataFrame, by: str = "index", column: str = "place") -> DataFrame:
    """A payload with its places in the order of a matrix: by ``index``, ``class``, ``out`` or ``in`` degree; ties by number."""
    keys = {"index": [], "class": [F.col("classFqn"), F.col("methodName")], "out": [-F.col("out_degree")], "in": [-F.col("in_degree")]}[by]
    named = {f"__{i}": k for i, k in enumerate(keys)}
    return row_numbers(shown.withColumns(named) if named else shown, [*named, "idx"], column).drop(*named)


def dense(vertices: DataFrame, edge: DataFrame, most: int = 4096) -> DataFrame:
    """(src_idx, weights): a row of the matrix for each vertex, with zeros; for graphs small enough to show.

    The matrix has the square of the vertices' number, so more than ``most`` are refused; ``adjacency`` has no such bound."""
    n = vertices.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} vertices; use adjacency")
    rows = adjacency(vertices, edge).groupBy("src_idx").agg(F.map_from_entries(F.collect_list(F.struct("dst_idx", "weight"))).alias("m"))
    filled = vertices.select(F.col("idx").alias("src_idx")).join(rows, "src_idx", "left")
    empty = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<bigint>"))
    return filled.select("src_idx", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(F.coalesce("m", empty), i), F.lit(0).cast("long"))).alias("weights"))
