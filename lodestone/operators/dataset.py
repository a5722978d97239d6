"""Filter cascades, seeded samples, slices and coverage lookups."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import api_class, complexity_class, count_tokens, line_of_offset, source_key, source_root, strip_generics
from lodestone.session import stored


def first_reason(reasons: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, else null. A null condition does not hold."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(reasons):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def cascade(df: DataFrame, reasons: Sequence[tuple[str, Column]], column: str = "reject_reason") -> DataFrame:
    """All rows with the first reason against them; survivors have none."""
    return df.withColumn(column, first_reason(reasons))


def reason_counts(df: DataFrame, column: str = "reject_reason") -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def method_reasons(excluded: Sequence[str] = ("GETTER", "SETTER", "DELEGATOR", "GENERATED", "TEST"), min_statements: int = 3, public_only: bool = False, max_file_tokens: int | None = None, no_void: bool = False, need_params: bool = False, covered: bool = False, min_coverage: float | None = None) -> list[tuple[str, Column]]:
    """The cascade over method rows, in order. ``is_covered`` and ``coverage_ratio`` come from ``join_coverage``."""
    c = F.col
    out = [
        ("category", c("category").isin(*excluded)),
        ("statements", c("statementCount") < min_statements),
        ("no_invocations", F.size(F.coalesce(c("invocations"), F.array())) == 0),
        ("not_exact", F.exists("invocations", lambda i: i["resolutionMode"] != "EXACT")),
    ]
    if public_only:
        out.append(("not_public", ~F.startswith(c("methodSignature"), F.lit("public "))))
    if max_file_tokens is not None:
        out.append(("file_tokens", count_tokens("fileContent") > max_file_tokens))
    if no_void:
        out.append(("void", c("returnType").isNull() | (c("returnType") == "void")))
    if need_params:
        out.append(("no_params", F.size(F.coalesce(c("parameterTypes"), F.array())) == 0))
    if covered:
        out.append(("not_covered", ~F.coalesce(c("is_covered"), F.lit(False))))
    if min_coverage is not None:
        out.append(("coverage_ratio", c("coverage_ratio").isNull() | (c("coverage_ratio") < min_coverage)))
    return out


def seeded_sample(df: DataFrame, order: Sequence[str], k: int, seed: int, shuffle_all: bool = False) -> DataFrame:
    """k rows without replacement, as ``random.Random(seed).sample`` picks them from the rows in order.

    Adds ``sample_pos``. With k rows or fewer all stay, in order
    unless ``shuffle_all``. Row numbers are counted
    by range partition, not in one task; k positions are broadcast."""
    n = df.count()
    positions = list(range(n)) if k >= n and not shuffle_all else random.Random(seed).sample(range(n), min(k, n))
    chosen = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(positions)], "row_index long, sample_pos int")
    return row_numbers(df, order).join(F.broadcast(chosen), "row_index").drop("row_index")


def row_numbers(df: DataFrame, order: Sequence[str], column: str = "row_index") -> DataFrame:
    """0-based numbers in the given order, which must be total, by range partitions and their running counts.

    The ranged rows are stored, so that counts and numbers see the same partitions, also after the loss of an
    executor: planned twice, the ranges would be sampled twice."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # a row per partition
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(before), "__part").withColumn(column, F.col("__before") + inside - 1).drop("__part", "__before")


def slices(df: DataFrame, exact: str, project: str, total: str) -> DataFrame:
    """Each row under its API class, its complexity class and ``all``."""
    named = df.withColumns({"api_type": api_class(F.col(exact), F.col(project)), "complexity": complexity_class(total)})
    return named.withColumn("slice", F.explode(F.array("api_type", "complexity", F.lit("all"))))


def slice_stats(sliced: DataFrame, total: str, statements: str) -> DataFrame:
    return sliced.groupBy("slice").agg(F.count("*").alias("n"), F.avg(total).alias("avg_invocations"), F.avg(statements).alias("avg_statements"))


def join_coverage(methods: DataFrame, coverage: DataFrame) -> DataFrame:
    """Methods with ``is_covered`` (any match covered) and ``coverage_ratio`` (of the first match in report order).

    A match has the same class and name and equal parameter types without generics.
    ``coverage``: class_name, method_name, params, covered_lines, total_lines, ord."""
    erased = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), strip_generics)
    ratio = F.try_divide(F.col("covered_lines").cast("double"), "total_lines")
    per = coverage.withColumn("__p", erased("params")).groupBy(F.col("class_name").alias("__c"), F.col("method_name").alias("__m"), "__p")
    per = per.agg(F.bool_or(F.col("covered_lines") > 0).alias("is_covered"), F.min_by(ratio, "ord").alias("coverage_ratio"))
    keyed = methods.withColumn("__q", erased("parameterTypes"))
    on = (keyed["classFqn"] == per["__c"]) & (keyed["methodName"] == per["__m"]) & (keyed["__q"] == per["__p"])
    return keyed.join(per, on, "left").withColumn("is_covered", F.coalesce("is_covered", F.lit(False))).drop("__c", "__m", "__p", "__q")


def range_join(spans: DataFrame, points: DataFrame, key: str, low: str, high: str, at: str, width: int) -> DataFrame:
    """Points within spans of the same key, both ends included.

    Spans are cut into cells of ``width``, so that the join is an equality on (key, cell)
    with a check of the ends, and not a product of all spans and points of a key."""
    cells = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    placed = points.withColumn("__cell", F.floor(F.col(at) / width))
    return cells.join(placed, [key, "__cell"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("__cell")


def line_coverage(methods: DataFrame, lines: DataFrame, width: int = 256) -> DataFrame:
    """(method_id, lines): covered and missed instructions by line, in line order. ``methods``: method_id, source_key, first_line, last_line."""
    hit = range_join(methods, lines, "source_key", "first_line", "last_line", "line", width)
    return hit.groupBy("method_id").agg(F.array_sort(F.collect_list(F.struct("line", "covered", "missed"))).alias("lines"))


def source_roots(files: DataFrame, path: str, project: str) -> DataFrame:
    """(root): the source folders of a project's files, in order; the project itself if there is none."""
    found = files.select(source_root(path).alias("root")).filter("root is not null").distinct()
    return files.sparkSession.createDataFrame([(project,)], "root string") if found.isEmpty() else found.orderBy("root")


def with_source_keys(methods: DataFrame, lines: DataFrame, path: str = "filePath", fqn: str = "classFqn") -> DataFrame:
    """Methods with ``source_key``, the file of a coverage report that they stand in.

    It is the longest of the report's keys that is a tail of the method's path, folder by folder; where there is none, or no path, the one
    that the class name spells. Each path is posted under all its tails, and these meet the report's keys by equality, so no path is
    compared with all keys."""
    paths = methods.select(F.col(path).alias("__path")).filter("__path is not null").distinct()
    folders = F.filter(F.split(F.translate("__path", "\\", "/"), "/"), lambda x: x != "")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(folders), F.lit(1))), lambda n: F.struct(F.array_join(F.slice(folders, F.greatest(F.size(folders) - n + 1, F.lit(1)), n), "/").alias("source_key"), n.alias("n")))
    met = paths.select("__path", F.explode(tails).alias("t")).select("__path", "t.*").join(lines.select("source_key").distinct(), "source_key")
    longest = met.groupBy("__path").agg(F.max_by("source_key", "n").alias("__key"))
    joined = methods.drop("source_key").join(longest, F.col(path) == F.col("__path"), "left")
    return joined.withColumn("source_key", F.coalesce("__key", source_key(fqn))).drop("__path", "__key")


def method_line_coverage(methods: DataFrame, lines: DataFrame, key: str, width: int = 256) -> DataFrame:
    """(method_id, lines) of method rows: the file from path or class, first and last line from the body's offsets in the file's text."""
    at = lambda c: line_of_offset("fileContent", F.col(c))
    spans = with_source_keys(methods, lines).select(F.col(key).alias("method_id"), "source_key", at("bodyStartOffset").alias("first_line"), at("bodyEndOffset").alias("last_line"))
    return line_coverage(spans.filter("first_line is not null and last_line is not null"), lines, width)


def contains_join(texts: DataFrame, names: DataFrame, text: str, name: str, few: int = 1 << 17, most: int = 1 << 16) -> DataFrame:
    """Pairs of a text and a name that stands in it as a substring, for names of word characters (Unicode's) and ``$``.

    A name of such characters inside a text lies inside one run of them, so the product is
    taken between distinct names and runs: names are posted under their first
    three characters, shorter ones under all they have, and runs under their 1-, 2- and
    3-grams, of those lengths that names begin with.

    Names are broadcast where counted to be ``few`` or fewer. Then the names of the most frequent runs (``most`` at most, those of equal
    powers of two together) are found once and broadcast, those of other runs are found where they stand, and nothing but the
    texts and the counts of runs is shuffled. With more names, runs meet names by shuffles."""
    q = 3
    cut = lambda rows: rows.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?U)[\w$]+"), F.lit(0)))).alias("run"))
    grams = lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    wanted = names.filter(F.length(name) > 0).select(F.col(name).alias("name")).distinct().withColumn("gram", F.substring("name", 1, q))
    begun = wanted.agg(F.collect_set(F.length("gram")).alias("n"), F.count("*").alias("names")).first()  # three lengths at most
    if not begun["names"]:
        return texts.select("text_id", F.lit("").alias("name")).limit(0)
    told = F.concat(*(grams(n) for n in sorted(begun["n"])))
    shared = begun["names"] <= few
    met = lambda found: found.select("run", F.explode(F.array_distinct(told)).alias("gram")).join(F.broadcast(wanted) if shared else wanted, "gram").filter(F.contains("run", "name")).select("run", "name").distinct()
    if not shared:
        runs = cut(texts)
        return runs.join(met(runs.select("run").distinct()), "run").select("text_id", "name").distinct()
    counted = stored(cut(texts).groupBy("run").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.length("run") <= 64)))
    least, left = 1 << 62, most
    for r in counted.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("runs")).orderBy(F.desc("power")).collect():  # 63 rows at most
        if (left := left - r["runs"]) < 0:
            break
        least = 1 << r["power"]
    often = counted.filter(F.col("n") >= least).select("run")
    # Of a frequent run what it holds, of another what to look under.
    either = lambda gram, found: F.struct(gram.cast("string").alias("gram"), found.cast("string").alias("found"))
    held = F.collect_list(F.when(F.col("name").isNotNull(), either(F.lit(None), F.col("name"))))
    known = often.join(met(often), "run", "left").groupBy("run").agg(held.alias("held"))
    asked = F.coalesce("held", F.transform(told, lambda g: either(g, F.lit(None))))
    tried = cut(texts.repartition("text_id")).join(F.broadcast(known), "run", "left").select("text_id", "run", F.explode(asked).alias("a")).select("text_id", "run", "a.*")
    hit = tried.join(F.broadcast(wanted), "gram", "left").filter(F.col("found").isNotNull() | F.contains("run", "name"))
    return hit.select("text_id", F.coalesce("found", "name").alias("name")).distinct()


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in order."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first in order."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))


#: Categories of methods, the first that fits.
CATEGORIES = ("TEST", "GENERATED", "GETTER", "SETTER", "DELEGATOR", "NORMAL")


def category() -> Column:
    """Category of a method from what the extraction knows of it.

    Columns: inTestSource, annotations (names), methodName, nParameters, hasBody, nStatements, and of a single
    statement its kind (``return`` or ``expression``), what it consists of (``call``, ``assignment`` or other) and the
    number of the call's arguments."""
    c = F.col
    annotated = lambda x: F.exists("annotations", lambda a: (a == x) | F.endswith(a, F.lit(f".{x}")))
    short = c("hasBody") & (c("nStatements") <= 1)
    single = c("nStatements") == 1
    reasons = [
        ("TEST", c("inTestSource") | annotated("Test")),
        ("GENERATED", annotated("Generated")),
        ("GETTER", short & (c("nParameters") == 0) & c("methodName").rlike("^(get|is)") & (~single | (c("statementKind") == "return"))),
        ("SETTER", short & single & (c("nParameters") == 1) & c("methodName").startswith("set") & (c("statementKind") == "expression") & (c("statementPart") == "assignment")),
        ("DELEGATOR", short & single & c("statementKind").isin("return", "expression") & (c("statementPart") == "call") & (c("nArguments") == c("nParameters"))),
    ]
    return F.coalesce(first_reason(reasons), F.lit("NORMAL"))


def kept_methods(methods: DataFrame, least: int, all_categories: bool = False) -> DataFrame:
    """Methods of ``least`` statements or more; those of a category other than NORMAL only on demand, and by the same bound."""
    return methods.filter((F.col("statementCount") >= least) & (F.lit(all_categories) | (F.col("category") == "NORMAL")))


def siblings(methods: DataFrame, type_: str, order: str, fields: Sequence[str], most: int = 4096) -> DataFrame:
    """Methods with ``siblings``: all other methods of their type in declaration order, filtered ones included.

    A type's methods are gathered as an array over one window, so what makes them is computed once (bounded by what a source file declares;
    types beyond ``most`` raise an error), and each method leaves out itself."""
    whole = Window.partitionBy(type_).orderBy(order, *fields).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gathered = methods.filter(F.col(type_).isNotNull()).withColumn("__all", F.collect_list(F.struct(F.col(order).alias("ord"), *fields)).over(whole))
    gathered = gathered.withColumn("__all", F.when(F.size("__all") <= most, F.col("__all")).otherwise(F.raise_error(F.concat(F.lit("too many methods in "), F.col(type_).cast("string")))))
    return gathered.withColumn("siblings", F.filter("__all", lambda s: s["ord"] != F.col(order))).drop("__all")


def substituted(content: str, start: str, end: str, generated: str) -> Column:
    """A file's content with the text between two offsets replaced; null offsets leave it as it is."""
    c, g = F.col(content), F.coalesce(F.col(generated), F.lit(""))
    made = F.concat(F.substring(c, F.lit(1), F.col(start)), g, F.substring(c, F.col(end) + 1, F.length(c)))
    return F.when(F.col(start).isNull() | F.col(end).isNull(), c).otherwise(made)


def index_of(sampled: DataFrame, seed: int, min_coverage: float | None = None, coverage: bool = False) -> DataFrame:
    """One row: the index of a sample as a nested record (counts, seed, and the methods in sample order)."""
    method = [F.col("filePath").alias("file_path"), F.col("classFqn").alias("class_fqn"), F.col("methodName").alias("method_name"), F.col("statementCount").alias("statement_count"), F.size("invocations").alias("invocation_count"), *([F.col("coverage_ratio")] if coverage else [])]
    rows = sampled.select(F.col("sample_pos"), F.struct(*method).alias("m"))
    return rows.agg(F.count("*").alias("sample_count"), F.lit(seed).alias("seed"), F.lit(min_coverage).cast("double").alias("min_coverage_ratio"), F.transform(F.array_sort(F.collect_list(F.struct("sample_pos", "m"))), lambda x: x["m"]).alias("methods"))
