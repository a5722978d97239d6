"""Mining of failures: candidates, related failures, removal of repeats, records and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import class_simple_name, failed_test, method_of_signature, outer_class, record_hash, test_class_of_path
from lodestone.operators.dataset import first_reason, row_numbers
from lodestone.session import stored

#: Reasons for a relation, with their weights, in order.
RELATIONS = (("direct_test_method", 4), ("referenced_test_file", 2), ("target_class_test_class_match", 1), ("method_name_overlap", 1))


def rejection():
    """First reason against a sample as a failure; a missing build verdict is no failed build."""
    is_true = lambda c: F.col(c).eqNullSafe(F.lit(True))
    is_false = lambda c: F.col(c).eqNullSafe(F.lit(False))
    none_failed = F.size(F.coalesce("test_eval.failed_test_names", F.array().cast("array<string>"))) == 0
    return first_reason(
        [
            ("not_compilable_or_unchecked", ~is_true("metrics.compilable")),
            ("exact_match_or_unchecked", ~is_false("metrics.em")),
            ("missing_test_eval", F.col("test_eval").isNull()),
            ("tests_passed", ~is_false("test_eval.success")),
            ("test_build_failed", is_false("test_eval.build_success")),
            ("test_command_failed_without_failed_tests", none_failed),
        ]
    )


def related(samples: DataFrame) -> DataFrame:
    """Samples with ``related`` (name, reasons and score of each related failed test) and ``relation_score`` (the best).

    A test's score is the sum of its reasons' weights. A direct test may be named by its file, by its simple or full
    class; a referenced file by its full or simple class. The method's name comes from ``method_id`` or else from
    ``method_signature``, and may stand anywhere in the failed test's name."""
    none, has = F.array().cast("array<string>"), set(samples.columns)
    direct = F.coalesce("direct_test_methods", F.array()) if "direct_test_methods" in has else F.array()
    files = F.filter(F.transform(F.coalesce("test_file_paths", none), test_class_of_path), lambda x: x.isNotNull()) if "test_file_paths" in has else none
    own, named = F.coalesce("method_id", F.lit("")), F.contains(F.coalesce("method_id", F.lit("")), F.lit("#"))
    signature = method_of_signature("method_signature") if "method_signature" in has else F.lit("")
    keyed = samples.withColumns(
        {
            "__direct": direct, "__files": F.concat(files, F.transform(files, outer_class)),
            "__class": F.when(named, class_simple_name(F.substring_index(own, "#", 1))).otherwise(F.lit("")),
            "__method": F.lower(F.when(named, F.substring_index(own, "#", -1)).otherwise(signature)),
        }
    )

    def judged(name):
        test, sure = failed_test(name), lambda c: F.coalesce(c, F.lit(False))
        simple = outer_class(test["test_class"])
        names = lambda d: sure(test_class_of_path(d["test_file"]) == test["test_class"]) | sure((d["test_class"] != "") & ((simple == d["test_class"]) | F.endswith(test["test_class"], F.concat(F.lit("."), d["test_class"]))))
        flags = {
            "direct_test_method": F.exists("__direct", lambda d: names(d) & sure(test["test_method"] == d["test_method"])) if "direct_test_methods" in has else F.lit(False),
            "referenced_test_file": F.array_contains("__files", test["test_class"]) | F.array_contains("__files", simple),
            "target_class_test_class_match": (F.col("__class") != "") & (class_simple_name(test["test_class"]) == F.col("__class")),
            "method_name_overlap": (F.col("__method") != "") & F.contains(F.lower(name), F.col("__method")),
        }
        reasons = F.filter(F.array(*(F.when(flags[k], F.lit(k)) for k, _ in RELATIONS)), lambda x: x.isNotNull())
        return F.struct(name.alias("name"), reasons.alias("reasons"), sum((F.when(flags[k], w).otherwise(0) for k, w in RELATIONS), F.lit(0)).alias("score"))

    found = F.filter(F.transform(F.coalesce("test_eval.failed_test_names", none), judged), lambda r: r["score"] > 0)
    out = keyed.withColumn("related", found).drop("__direct", "__files", "__class", "__method")
    return out.withColumn("relation_score", F.coalesce(F.array_max(F.transform("related", lambda r: r["score"])), F.lit(0)))


def mine_failures(samples: DataFrame, order: str, require_related: bool = False, dedupe: str = "method_generated") -> tuple[DataFrame, DataFrame]:
    """(records, counts by reason). Repeats by method and text (or by text, or not at all) keep the first in order.

    Rejected samples are only counted: relations are sought, and repeats met, among the others alone. Those are stored once, as
    records and counts both read them."""
    judged = samples.withColumn("reason", rejection())
    rejected, kept = judged.filter("reason is not null").select("reason"), stored(related(judged.filter("reason is null")))
    if require_related:
        kept = kept.withColumn("reason", F.when(F.col("relation_score") == 0, "unrelated_test_failure"))
        rejected, kept = rejected.unionByName(kept.filter("reason is not null").select("reason")), kept.filter("reason is null")
    if dedupe != "none":
        key = record_hash(F.coalesce("generated", F.lit("")), F.coalesce("method_id", F.lit(""))) if dedupe == "method_generated" else F.sha2(F.coalesce("generated", F.lit("")), 256)
        keyed = kept.withColumn("__key", key)
        first = keyed.groupBy("__key").agg(F.min(order).alias("__first"))
        marked = keyed.join(first, "__key").withColumn("reason", F.when(F.col(order) != F.col("__first"), "duplicate")).drop("__key", "__first")
        rejected, kept = rejected.unionByName(marked.filter("reason is not null").select("reason")), marked.filter("reason is null")
    return kept.drop("reason"), rejected.groupBy("reason").agg(F.count("*").alias("n"))


#: The metrics of a record, and those of its retrieval.
RECORD_METRICS = ("em", "es", "iou", "lcs_ratio", "lcs_no_ident_ratio", "lcsubstring_no_ident_ratio", "codebleu", "compilable", "compile_exit_code")
RETRIEVAL_METRICS = ("recall_at_k", "api_coverage_at_k", "mrr", "retrieval_precision_at_k", "retrieval_ndcg_at_k", "retrieval_type_iou", "owner_type_recall")


def record(df: DataFrame, with_prompt: bool = False) -> DataFrame:
    """Nested records of mined failures: identity, source, method, verdict, metrics, code, context, retrieval and prompt.

    What the samples have no column or field for is null. ``retrieval`` is null as a whole unless
    a query or results are there."""
    fields = {f.name: {x.name for x in f.dataType.fields} if f.dataType.typeName() == "struct" else set() for f in df.schema.fields}

    def at(name: str, inside: str = "", default: str | None = None, kind: str | None = None):
        there = inside in fields and name in fields[inside] if inside else name in fields
        c = F.col(f"{inside}.{name}" if inside else name) if there else F.lit(None).cast(kind or "string")
        return (c if default is None else F.coalesce(c, F.expr(default))).alias(name)

    digest = record_hash(F.coalesce(at("generated"), F.lit("")), F.coalesce(at("method_id"), F.lit("")))
    mode = F.coalesce(F.nullif(at("mode"), F.lit("")), at("mode_dir"))
    number = at("sample_index", kind="int")
    stem = F.when(number.isNull(), "sample_").otherwise(F.format_string("sample_%03d", number))
    named = F.contains(F.coalesce(at("method_id"), F.lit("")), F.lit("#"))
    method = F.struct(at("method_id"), at("file_path"), at("method_signature").alias("signature"), F.when(named, F.substring_index(at("method_id"), "#", -1)).otherwise(method_of_signature(at("method_signature"))).alias("method_name"), F.when(named, F.substring_index(at("method_id"), "#", 1)).alias("class_fqn"))
    tests = [at("build_success", "test_eval", "true", "boolean"), *(at(x, "test_eval", "0", "int") for x in ("tests_run", "tests_passed", "tests_failed")), at("failed_test_names", "test_eval", "cast(array() AS array<string>)", "array<string>")]
    verdict = F.struct(F.lit(True).alias("compiles"), F.lit(False).alias("exact_match"), F.lit(False).alias("tests_pass"), *tests, F.col("related").alias("related_failed_tests"), "relation_score")
    code = F.struct(*(at(x) for x in ("ground_truth", "generated", "normalized_ground_truth", "normalized_generated")))
    context = F.struct(*(at(x) for x in ("invocations_ordered", "invocations_as_used", "generated_invocations", "coverage_ratio", "line_coverage", "test_file_paths", "direct_test_methods")))
    found = F.struct(at("retrieval_query").alias("query"), at("retrieval_results").alias("results"), at("augmentation_block"), *(at(x, "metrics", kind="double") for x in RETRIEVAL_METRICS))
    retrieval = F.when(at("retrieval_query").isNotNull() | at("retrieval_results").isNotNull(), found)
    return df.select(
        F.concat(mode, F.lit(":"), stem, F.lit(":"), F.left(digest, F.lit(12))).alias("candidate_id"), digest.alias("candidate_hash"),
        F.struct(mode.alias("mode"), number.alias("sample_index")).alias("source"), method.alias("method"), verdict.alias("verdict"),
        F.struct(*(at(x, "metrics", kind="double") for x in RECORD_METRICS)).alias("metrics"), code.alias("code"), context.alias("context"), retrieval.alias("retrieval"),
        *([at("prompt")] if with_prompt and "prompt" in fields else []),
    )


def summary(kept: DataFrame, counts: DataFrame) -> DataFrame:
    """One row on a mining: samples seen, candidates, related candidates, candidates by mode and rejections by reason.

    Candidates are counted by mode first, so only modes and reasons are gathered."""
    modes = kept.groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.col("relation_score") > 0).alias("r"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    pairs = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n"))))
    one = modes.agg(zero("n").alias("candidate_count"), zero("r").alias("related_candidate_count"), pairs("mode").alias("by_mode"))
    two = counts.agg(zero("n").alias("__out"), pairs("reason").alias("rejected"))
    joined = one.join(F.broadcast(two))  # one row each
    return joined.select((F.col("candidate_count") + F.col("__out")).alias("total_samples_seen"), "candidate_count", "related_candidate_count", "by_mode", "rejected")


def failure_order(order: str):
    """Descending importance; equal rows keep their order."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).desc()
    return [zero("relation_score"), F.size("related").desc(), zero("test_eval.tests_failed"), zero("coverage_ratio"), zero("metrics.es"), F.col(order)]


def tests_index(tests: DataFrame, names: DataFrame) -> DataFrame:
    """Method name to the tests that call it."""
    return names.join(tests.select(F.explode(F.array_distinct("called")).alias("name"), "test_file", "test_class", "test_method"), "name").groupBy("name").agg(F.array_sort(F.collect_set(F.struct("test_file", "test_class", "test_method"))).alias("tests"))


def fill_missing(samples: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null columns filled by key, with ``changed``: whether any was."""
    renamed = found.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = samples.join(renamed, key, "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(c).isNull() & F.col(f"__{c}").isNotNull())
    return joined.withColumn("changed", changed).withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def ranked(df: DataFrame, order: str) -> DataFrame:
    """Failures with their 1-based ``place`` in ``failure_order``, numbered by range partitions and not in one task."""
    zero = lambda c: -F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    keys = {"__a": zero("relation_score"), "__b": -F.size("related"), "__c": zero("test_eval.tests_failed"), "__d": zero("coverage_ratio"), "__e": zero("metrics.es")}
    return row_numbers(df.withColumns(keys), [*keys, order], "place").withColumn("place", F.col("place") + 1).drop(*keys)
