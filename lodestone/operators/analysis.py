"""Statistics by mode, comparisons of modes, paired analysis and consistency checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.metrics import mean_median_std, pearson


def metric_stats(samples: DataFrame, mode: str, metrics: Sequence[str]) -> DataFrame:
    """Mean, median and deviation of each metric by mode, over non-null values; booleans count as 0 and 1."""
    kinds = dict(samples.dtypes)
    value = lambda m: F.col(m).cast("int") if kinds[m] == "boolean" else F.col(m)
    return samples.groupBy(mode).agg(F.count("*").alias("n"), *(x for m in metrics for x in mean_median_std(value(m), m)))


def long_stats(samples: DataFrame, mode: str, metrics: Sequence[str]) -> DataFrame:
    """(mode, metric, n, mean, median, std), one row each."""
    long = samples.select(mode, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select(mode, "x.*")
    return long.groupBy(mode, "metric").agg(F.count("value").alias("n"), *mean_median_std("value", "v"))


def comparison(stats: DataFrame, mode: str, modes: Sequence[str]) -> DataFrame:
    """Metric by mode, cells ``mean (std=...)`` or ``N/A``."""
    cell = F.when(F.col("v_mean").isNull(), "N/A").otherwise(F.format_string("%.4f (std=%.4f)", "v_mean", "v_std"))
    return stats.withColumn("cell", cell).groupBy("metric").pivot(mode, list(modes)).agg(F.coalesce(F.first("cell"), F.lit("N/A")))


def best_mode(stats: DataFrame, mode: str, order: Column) -> DataFrame:
    """The mode of the highest mean by metric; the first in order wins ties."""
    w = Window.partitionBy("metric").orderBy(F.col("v_mean").desc_nulls_last(), order)
    return stats.withColumn("__n", F.row_number().over(w)).filter("__n = 1 and v_mean is not null").drop("__n")


def pair_modes(samples: DataFrame, mode: str, key: Sequence[str], base: str, other: str, values: Sequence[str]) -> DataFrame:
    """Rows of two modes side by side by key, with the differences other minus base."""
    one = samples.filter(F.col(mode) == base).select(*key, *(F.col(v).alias(f"base_{v}") for v in values))
    two = samples.filter(F.col(mode) == other).select(*key, *(F.col(v).alias(f"other_{v}") for v in values))
    return one.join(two, list(key)).withColumns({f"delta_{v}": F.col(f"other_{v}") - F.col(f"base_{v}") for v in values})


def steady_mean(value: Column) -> Column:
    """The mean of doubles whose sum hangs on no order: tenth decimals and above are added exactly, what is left (or too large, or no number) as doubles."""
    exact = F.coalesce(value.try_cast("decimal(28,10)"), F.lit(0).cast("decimal(28,10)"))
    whole = F.sum(F.when(value.isNotNull(), exact)).cast("double") + F.sum(value - exact.cast("double"))
    return F.when(F.count(value) > 0, whole / F.count(value))


def ordered_means(rows: DataFrame, by: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """(by, the mean of each value): doubles are added one after the other by ``order`` (equal ones by value), so a mean hangs on no split of the rows
    and is that of whoever reads them in this order. Null values are left out."""
    w = Window.partitionBy(*by).orderBy(order, *values)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumns({f"__sum_{v}": F.sum(v).over(upto) for v in values} | {f"__n_{v}": F.count(v).over(upto) for v in values} | {"__more": F.lead(F.lit(True)).over(w)})
    return run.filter("__more is null").select(*by, *(F.when(F.col(f"__n_{v}") > 0, F.col(f"__sum_{v}") / F.col(f"__n_{v}")).alias(v) for v in values))


def helped(delta: Column, threshold: float = 0.02) -> Column:
    """``helped``, ``hurt``, ``neutral`` by strict thresholds; ``unknown`` for null."""
    return F.when(delta.isNull(), "unknown").when(delta > threshold, "helped").when(delta < -threshold, "hurt").otherwise("neutral")


def recall_bucket(value: Column) -> Column:
    return F.when(value == 0, "zero").when(value < 0.3, "low").when(value < 0.6, "mid").otherwise("high")


def helped_counts(pairs: DataFrame, deltas: Sequence[str], threshold: float = 0.02) -> DataFrame:
    long = pairs.select(F.explode(F.array(*(F.struct(F.lit(d).alias("metric"), F.col(d).alias("delta")) for d in deltas))).alias("x")).select("x.*")
    return long.groupBy("metric", helped(F.col("delta"), threshold).alias("category")).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"))


def correlations(pairs: DataFrame, metrics: Sequence[str], delta: str) -> DataFrame:
    long = pairs.select(F.col(delta).alias("d"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("x")) for m in metrics))).alias("v")).select("d", "v.*")
    return long.groupBy("metric").agg(F.count("*").alias("n"), pearson("x", "d").alias("r"))


def extremes(pairs: DataFrame, delta: str, key: str, n: int = 5) -> DataFrame:
    """The n largest and the n smallest differences."""
    top = pairs.orderBy(F.desc(delta), key).limit(n).withColumn("side", F.lit("helped"))
    return top.unionByName(pairs.orderBy(delta, F.desc(key)).limit(n).withColumn("side", F.lit("hurt")))


def cross_mode_issues(samples: DataFrame, index: str, mode: str, fields: Sequence[str]) -> DataFrame:
    """(index, mode, field) wherever a mode differs from the first mode of its index; indices of one mode are skipped."""
    w = Window.partitionBy(index)
    first = w.orderBy(mode)
    seen = samples.withColumns({f"__{f}": F.first(F.struct(F.col(f).alias("x"))).over(first) for f in fields} | {"__modes": F.size(F.collect_set(mode).over(w))})
    wrong = [F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")["x"]), F.lit(f)) for f in fields]
    return seen.filter("__modes > 1").select(index, mode, F.explode(F.filter(F.array(*wrong), lambda x: x.isNotNull())).alias("field"))


def ordered_issues(samples: DataFrame, index: str, mode: str, block: str, ordered: str, used: str) -> DataFrame:
    """(index, mode, field) of samples in a mode with ordered calls whose calls as used are not the ordered ones.

    Looked at are modes named ``*ordered*`` with a text in ``block`` and at least one call in ``ordered`` (structs with signature
    and order_index), of indices that more than one mode has. Signatures are compared one by one, in the order of
    order_index (of equal ones as they stand); a null list is empty."""
    none = F.array().cast(samples.schema[ordered].dataType)
    listed = F.coalesce(F.col(ordered), none)
    by_place = F.transform(F.array_sort(F.transform(listed, lambda c, i: F.struct(c["order_index"].alias("o"), i.alias("i"), c["signature"].alias("s")))), lambda c: c["s"])
    as_used = F.coalesce(F.transform(used, lambda c: c["signature"]), F.array().cast("array<string>"))
    many = samples.withColumn("__modes", F.size(F.collect_set(mode).over(Window.partitionBy(index))))
    wrong = many.filter((F.col("__modes") > 1) & F.contains(mode, F.lit("ordered")) & (F.coalesce(block, F.lit("")) != "") & (F.size(listed) > 0) & (by_place != as_used))
    return wrong.select(index, mode, F.lit(used).alias("field"))


def consistency_issues(samples: DataFrame, index: str, mode: str, fields: Sequence[str], block: str, ordered: str, used: str) -> DataFrame:
    """(index, mode, field): what differs from the first mode, and ordered calls that were used in another order."""
    return cross_mode_issues(samples, index, mode, fields).unionByName(ordered_issues(samples, index, mode, block, ordered, used))


def issue_counts(issues: DataFrame, index: str, mode: str) -> DataFrame:
    return issues.groupBy(mode).agg(F.count("*").alias("n"), F.count_distinct(index).alias("n_indices"))


def any_every(samples: DataFrame, index: str, any_of: Sequence[str], every_of: Sequence[str]) -> DataFrame:
    """Per index: whether any mode has, and whether every mode has, the given flags."""
    return samples.groupBy(index).agg(*(F.bool_or(c).alias(f"any_{c}") for c in any_of), *(F.bool_and(F.coalesce(F.col(c), F.lit(True))).alias(f"every_{c}") for c in every_of))


def chosen_indices(samples: DataFrame, index: str, mode: str, name: str, text: str | None = None, matched: bool = False, compilable: bool = False, failing: bool = False, tested: bool = False, public: bool = False) -> DataFrame:
    """(index): those that meet all the conditions asked for.

    ``text``: stands in ``name``, whatever the case, in any mode. ``matched``: an exact match in any mode (``em``). ``compilable``: no mode is known not
    to compile. ``failing``: any mode has errors (``compile_errors``). ``tested``: any mode has direct tests (``direct_test_methods``). ``public``: the
    signature of the first mode begins with ``public``. Nulls are unknown: no match, no error, no test."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    asked = {
        "text": (text, lambda: F.bool_or(F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit((text or "").lower())))), "em": (matched, lambda: F.bool_or(F.coalesce("em", F.lit(False)))),
        "compilable": (compilable, lambda: F.bool_and(F.coalesce("compilable", F.lit(True)))), "failing": (failing, lambda: F.bool_or(some("compile_errors"))),
        "tested": (tested, lambda: F.bool_or(some("direct_test_methods"))), "public": (public, lambda: F.coalesce(F.min_by("method_signature", mode).startswith("public"), F.lit(False))),
    }
    wanted = {n: condition() for n, (on, condition) in asked.items() if on}
    if not wanted:
        return samples.select(index).distinct()
    met = samples.groupBy(index).agg(*(c.alias(f"__{n}") for n, c in wanted.items()))
    return met.filter(" and ".join(f"__{n}" for n in wanted)).select(index)


def mode_diffs(samples: DataFrame, index: str, mode: str, text: str) -> DataFrame:
    """All pairs of modes of an index whose texts differ."""
    one, two = samples.select(index, F.col(mode).alias("m1"), F.col(text).alias("t1")), samples.select(index, F.col(mode).alias("m2"), F.col(text).alias("t2"))
    return one.join(two, index).filter((F.col("m1") < F.col("m2")) & ~F.col("t1").eqNullSafe(F.col("t2")))


def parse_table(lines: DataFrame) -> DataFrame:
    """(metric, position, mean, std) of the grid lines ``| metric | mean (std=...) | N/A |``."""
    cells = F.filter(F.transform(F.split("value", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.filter(F.startswith("value", F.lit("|"))).select(cells.alias("c"))
    split = rows.select(F.get("c", F.lit(0)).alias("metric"), F.posexplode(F.slice("c", 2, 1000)).alias("position", "cell"))
    number = lambda g: F.expr(f"try_cast(nullif(regexp_extract(cell, '([\\\\d.]+)\\\\s*\\\\(std=([\\\\d.]+)\\\\)', {g}), '') as double)")
    return split.select("metric", "position", number(1).alias("mean"), number(2).alias("std")).filter("metric <> ''")


def conditional_means(pairs: DataFrame, recall: str, deltas: Sequence[str]) -> DataFrame:
    """(condition, n, mean of each delta) where recall is 0, above 0, and 0.5 or more; a row may meet two conditions."""
    met = F.array(F.when(F.col(recall) == 0, F.lit("zero")), F.when(F.col(recall) > 0, F.lit("some")), F.when(F.col(recall) >= 0.5, F.lit("high")))
    long = pairs.withColumn("condition", F.explode(F.filter(met, lambda x: x.isNotNull())))
    return long.groupBy("condition").agg(F.count("*").alias("n"), *(F.avg(d).alias(f"mean_{d}") for d in deltas))


def slice_deltas(pairs: DataFrame, members: DataFrame, index: str, delta: str, means: Sequence[str] = (), threshold: float = 0.02) -> DataFrame:
    """(slice, n, mean of ``delta`` and ``means``, helped, hurt) over slices (slice, index); unknown indices are dropped, and so is the slice ``all``."""
    joined = members.filter("slice <> 'all'").join(pairs, index)
    side = helped(F.col(delta), threshold)
    return joined.groupBy("slice").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in (delta, *means)), F.count_if(side == "helped").alias("helped"), F.count_if(side == "hurt").alias("hurt"))


def coverage_totals(methods: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(covered, total): methods with a covered line, and all."""
    return methods.groupBy(*by).agg(F.count_if(F.coalesce("is_covered", F.lit(False))).alias("covered"), F.count("*").alias("total"))


def line_totals(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(covered, executable): lines with a covered instruction, and lines with any instruction."""
    return lines.groupBy(*by).agg(F.count_if(F.col("covered") > 0).alias("covered"), F.count_if(F.col("covered") + F.col("missed") > 0).alias("executable"))


def extraction_totals(methods: DataFrame) -> DataFrame:
    """One row: files, methods and calls that were not resolved."""
    unresolved = F.size(F.filter(F.coalesce("invocations", F.array()), lambda i: i["resolutionMode"] != "EXACT"))
    return methods.agg(F.count_distinct("filePath").alias("n_files"), F.count("*").alias("n_methods"), F.coalesce(F.sum(unresolved), F.lit(0)).alias("n_unresolved"))


def by_mode(samples: DataFrame, index: str, mode: str, fields: Sequence[str]) -> DataFrame:
    """(index, modes): a map from mode to the row's fields, one row for each index."""
    return samples.groupBy(index).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(mode), F.struct(*fields))))).alias("modes"))


def mode_table(samples: DataFrame, mode: str, modes: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """(fact, a column for each mode): means of numeric facts side by side, for inspection."""
    long = samples.select(mode, F.explode(F.array(*(F.struct(F.lit(f).alias("fact"), F.col(f).cast("double").alias("v")) for f in facts))).alias("x")).select(mode, "x.*")
    return long.groupBy("fact").pivot(mode, list(modes)).agg(F.avg("v"))
