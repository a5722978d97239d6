"""Similarity and retrieval metrics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import col, let


def exact_match(a, b) -> Column:
    return col(a) == col(b)


def edit_similarity(a, b) -> Column:
    """1 - edit distance / longer length, in characters; two empty texts are alike."""
    longest = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longest == 0, 1.0).otherwise(F.lit(1.0) - F.levenshtein(col(a), col(b)) / longest)


def bag(tokens) -> Column:
    """Distinct tokens with their counts, by runs of the sorted array: array of (t, n)."""
    s = F.sort_array(col(tokens))
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda k: (k <= F.size(s)) & ((k == F.size(s)) | (F.get(s, k) != F.get(s, k - 1))))
    return F.transform(ends, lambda e, j: F.struct(F.get(s, e - 1).alias("t"), (e - F.coalesce(F.get(ends, j - 1), F.lit(0))).alias("n")))


def common_sorted(a, b) -> Column:
    """Size of the multiset intersection of two sorted arrays, by one merge."""
    def merge(v: Column) -> Column:
        x, y = v["x"], v["y"]
        return F.aggregate(
            F.sequence(F.lit(1), F.size(x) + F.size(y) + 1),
            F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n")),
            lambda s, _: F.when((s["i"] >= F.size(x)) | (s["j"] >= F.size(y)), s)
            .when(F.get(x, s["i"]) == F.get(y, s["j"]), F.struct((s["i"] + 1).alias("i"), (s["j"] + 1).alias("j"), (s["n"] + 1).alias("n")))
            .when(F.get(x, s["i"]) < F.get(y, s["j"]), F.struct((s["i"] + 1).alias("i"), s["j"].alias("j"), s["n"].alias("n")))
            .otherwise(F.struct(s["i"].alias("i"), (s["j"] + 1).alias("j"), s["n"].alias("n"))),
            lambda s: s["n"],
        )

    return let(F.struct(col(a).alias("x"), col(b).alias("y")), merge)


def token_iou_sorted(a, b) -> Column:
    """Multiset intersection over union of two sorted token arrays; both empty 1, one empty 0.

    |A ∪ B| as multisets is |A| + |B| - |A ∩ B|."""
    x, y = col(a), col(b)
    merged = common_sorted(x, y)
    both = F.size(x) + F.size(y)
    return F.when(both == 0, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(merged / (both - merged))


def ratio_to_longest(length, a, b) -> Column:
    """A common length over the longer token count; two empty sides are alike."""
    longest = F.greatest(F.size(col(a)), F.size(col(b)))
    return F.when(longest == 0, 1.0).otherwise(col(length) / longest)


def set_iou(a, b, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(col(a), col(b))) / union)


def invocation_recall(oracle, text) -> Column:
    """Share of exact oracle calls (owner, method structs, repeats count) whose lower-cased owner and method both stand in the text.

    No exact call: 1. Empty text: 0."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    found = F.size(F.filter(col(oracle), lambda x: F.contains(t, F.lower(x["owner"])) & F.contains(t, F.lower(x["method"]))))
    return F.when(F.size(col(oracle)) == 0, 1.0).when(t == "", 0.0).otherwise(found / F.size(col(oracle)))


def mean_reciprocal_rank(results, least: float = 0.3) -> Column:
    """1 / rank of the first (rank, similarity) struct that is similar enough; 0 if none is."""
    hit = F.filter(col(results), lambda r: r["similarity"] >= least)
    return F.when(F.size(hit) > 0, F.lit(1.0) / F.get(hit, F.lit(0))["rank"]).otherwise(0.0)


def retrieval_precision(results, oracle) -> Column:
    """Share of results (arrays) that meet the oracle set; no result 0, no oracle 1."""
    hits = F.size(F.filter(col(results), lambda r: F.arrays_overlap(r, col(oracle))))
    return F.when(F.size(col(oracle)) == 0, 1.0).when(F.size(col(results)) == 0, 0.0).otherwise(hits / F.size(col(results)))


def ndcg(gains) -> Column:
    """Discounted gain over that of the same gains in descending order; 0 if that is 0."""

    def dcg(g: Column) -> Column:
        return F.aggregate(F.transform(g, lambda x, i: x / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)

    ideal = dcg(F.reverse(F.sort_array(col(gains))))
    return F.when(F.coalesce(ideal, F.lit(0.0)) == 0, 0.0).otherwise(dcg(col(gains)) / ideal)


def mean_iou(query, results) -> Column:
    """Mean set IoU of the query's types with each result's; empty query or no result 0."""
    each = F.transform(col(results), lambda r: set_iou(col(query), r))
    return F.when((F.size(col(query)) == 0) | (F.size(col(results)) == 0), 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(each))


def recall_of(found, oracle) -> Column:
    """Share of the oracle set that was found; an empty oracle is all found."""
    return F.when(F.size(col(oracle)) == 0, 1.0).otherwise(F.size(F.array_intersect(col(found), col(oracle))) / F.size(col(oracle)))


def api_coverage(texts, oracle) -> Column:
    """Share of the distinct exact calls (owner, method structs, owners in full) that stand in one of the results' texts.

    A call stands in a text that holds the owner's simple name and the method, lower-cased, as substrings. ``texts``: a result's
    card and profile, one each. No call: all found; no result: none."""
    wanted = F.array_distinct(col(oracle))
    lower = F.transform(col(texts), lambda t: F.lower(F.coalesce(t, F.lit(""))))
    simple = lambda x: F.lower(F.substring_index(x["owner"], ".", -1))
    found = F.filter(wanted, lambda x: F.exists(lower, lambda t: F.contains(t, simple(x)) & F.contains(t, F.lower(x["method"]))))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(found) / F.size(wanted))


def profile_apis(profile) -> Column:
    """Distinct (owner, method) structs, lower-cased, of an invocation profile's lines of calls; generics of owners stay."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(profile), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("::")) & ~x.rlike("^(?:bigram|trigram):"))
    rest = lambda x: F.substring(x, F.instr(x, F.lit("::")) + 2, F.length(x))
    method = lambda x: F.when(F.instr(rest(x), F.lit("(")) > 1, F.substring_index(rest(x), "(", 1)).otherwise(F.regexp_extract(rest(x), r"(\S*)", 1))
    return F.array_distinct(F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, "::", 1)).alias("owner"), F.lower(method(x)).alias("method"))))


def owner_type_recall(profiles, oracle) -> Column:
    """Share of the distinct owners (in full, lower-cased) of the exact calls that own a call of a result's profile; without one 1."""
    wanted = F.array_distinct(F.transform(col(oracle), lambda x: F.lower(x["owner"])))
    owners = F.transform(F.flatten(F.transform(col(profiles), profile_apis)), lambda x: x["owner"])
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, owners)) / F.size(wanted))


def pearson(x, y) -> Column:
    """Aggregate: Pearson correlation; 0 with fewer than three rows or a constant side."""
    spread = F.stddev_pop(col(x)) * F.stddev_pop(col(y))
    return F.when((F.count(col(x)) < 3) | (spread == 0), 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop(col(x), col(y)), spread), F.lit(0.0)))


def mean_median_std(value, name: str) -> list[Column]:
    """Aggregates: mean, exact median and sample deviation (0 for one value)."""
    v = col(value)
    return [F.avg(v).alias(f"{name}_mean"), F.median(v).alias(f"{name}_median"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias(f"{name}_std")]
