"""The metric bundle of generated texts, its recomputation in place, and verdicts that need no run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import kernels, metrics, text
from lodestone.session import stored

#: What a retrieval mode is measured by.
RETRIEVAL = ("recall_at_k", "api_coverage_at_k", "mrr", "retrieval_precision_at_k", "retrieval_ndcg_at_k", "retrieval_type_iou", "owner_type_recall")


def usable(generated: str = "generated", truth: str = "ground_truth") -> Column:
    """Whether a sample can be measured: neither text is missing or empty."""
    return (F.coalesce(F.col(generated), F.lit("")) != "") & (F.coalesce(F.col(truth), F.lit("")) != "")


def tidied(code: str, unify: bool = True, ascii_only: bool = False) -> Column:
    """A text as it is compared: without comments and idle white space and, with ``unify``, with local names unified."""
    return text.unify_identifiers(text.normalize_code(code), ascii_only) if unify else text.normalize_code(code)


def bundle(df: DataFrame, generated: str = "generated", truth: str = "ground_truth", column: str = "metrics", unify: bool = True, ascii_only: bool = False) -> DataFrame:
    """Rows with a struct of all text metrics.

    Texts are compared without comments and idle white space and, with ``unify``, with local names unified; the
    ``no_ident`` ones without names and literals. ``codebleu`` is a plug-in's and null here. Null texts give null metrics."""
    first = df.withColumns({"__g": tidied(generated, unify, ascii_only), "__r": tidied(truth, unify, ascii_only)})
    second = first.withColumns({"__gt": text.tokens("__g", ascii_only), "__rt": text.tokens("__r", ascii_only), "__gs": text.tokens(text.strip_identifiers(generated, ascii_only), ascii_only), "__rs": text.tokens(text.strip_identifiers(truth, ascii_only), ascii_only)})
    third = second.withColumns({"__lcs": kernels.lcs_tokens_udf("__gt", "__rt"), "__bare": kernels.lcs_length_udf("__gs", "__rs"), "__run": kernels.common_substring_udf("__gs", "__rs")})
    made = F.struct(
        metrics.exact_match("__g", "__r").alias("em"), metrics.edit_similarity("__g", "__r").alias("es"), metrics.token_iou_sorted(F.sort_array("__gt"), F.sort_array("__rt")).alias("iou"),
        F.size("__lcs").alias("lcs_length"), metrics.ratio_to_longest(F.size("__lcs"), "__gt", "__rt").alias("lcs_ratio"), F.size("__gt").alias("gen_token_count"), F.size("__rt").alias("ref_token_count"), F.col("__lcs").alias("lcs_tokens"),
        F.col("__bare").alias("lcs_no_ident_length"), metrics.ratio_to_longest("__bare", "__gs", "__rs").alias("lcs_no_ident_ratio"),
        F.size("__run").alias("lcsubstring_no_ident_length"), metrics.ratio_to_longest(F.size("__run"), "__gs", "__rs").alias("lcsubstring_no_ident_ratio"), F.col("__run").alias("lcsubstring_no_ident_tokens"),
        F.lit(None).cast("double").alias("codebleu"),
    )
    known = F.col(generated).isNotNull() & F.col(truth).isNotNull()
    return third.withColumn(column, F.when(known, made)).drop("__g", "__r", "__gt", "__rt", "__gs", "__rs", "__lcs", "__bare", "__run")


def recompute(samples: DataFrame, keep: Sequence[str] = ("compilable", *RETRIEVAL), generated: str = "generated", truth: str = "ground_truth", column: str = "metrics", unify: bool = True) -> DataFrame:
    """Samples with their metrics and ``normalized_`` texts made anew; fields in ``keep`` stay as they were, and so do samples that are not ``usable``."""
    made = bundle(samples, generated, truth, "__new", unify)
    old = [f.name for f in samples.schema[column].dataType.fields]
    new = [f.name for f in made.schema["__new"].dataType.fields]
    field = lambda f: F.when(usable(generated, truth), F.col(f"__new.{f}")).otherwise(F.col(f"{column}.{f}") if f in old else F.lit(None)) if f in new and f not in keep else F.col(f"{column}.{f}")
    fresh = made.withColumn(column, F.struct(*(field(f).alias(f) for f in [*old, *(f for f in new if f not in old)]))).drop("__new")
    was = lambda c: F.col(c) if c in samples.columns else F.lit(None).cast("string")
    texts = {f"normalized_{c}": F.when(usable(generated, truth), tidied(c, unify)).otherwise(was(f"normalized_{c}")) for c in (generated, truth)}
    return fresh.withColumns(texts)


def recompute_retrieval(samples: DataFrame, results: str = "retrieval_results", invocations: str = "invocations_ordered", block: str = "augmentation_block", truth: str = "ground_truth", column: str = "metrics") -> DataFrame:
    """Samples with the retrieval metrics made anew from what they hold: results, oracle calls, the block that was shown, the true text.

    Fields of ``column``: recall_at_k, api_coverage_at_k, mrr, retrieval_precision_at_k, retrieval_ndcg_at_k and owner_type_recall; others (the type
    IoU needs the method itself) stay, and so do all of a sample without results (null) or without calls. An empty list of results scores 0 except where no call is exact."""
    exact = F.filter(invocations, lambda i: i["resolution_mode"] == "EXACT")
    oracle = F.transform(exact, lambda i: F.struct(text.invocation_owner(i["signature"]).alias("owner"), text.invocation_method(i["signature"]).alias("method")))
    short = F.transform(oracle, lambda x: F.struct(text.simple_name(x["owner"]).alias("owner"), x["method"].alias("method")))
    needed = F.array_distinct(F.transform(oracle, lambda x: F.struct(F.lower(x["owner"]).alias("owner"), F.lower(x["method"]).alias("method"))))
    given = samples.withColumns({"__oracle": oracle, "__short": short, "__needed": needed, "__apis": F.transform(results, lambda r: metrics.profile_apis(r["invocationProfile"])), "__truth": F.array_distinct(text.tokens(F.coalesce(truth, F.lit(""))))})
    texts = F.transform(results, lambda r: F.concat_ws(" ", F.coalesce(r["methodCard"], F.lit("")), F.coalesce(r["invocationProfile"], F.lit(""))))
    alike = F.transform(results, lambda r: F.struct(r["rank"].alias("rank"), metrics.set_iou("__truth", F.array_distinct(text.tokens(F.coalesce(r["methodBody"], F.lit(""))))).alias("similarity")))
    none = F.size(results) == 0
    gains = F.transform("__apis", lambda a: F.size(F.array_intersect("__needed", a)).cast("double"))
    made = {
        "recall_at_k": F.when(F.coalesce(block, F.lit("")) == "", 0.0).otherwise(metrics.invocation_recall("__short", block)), "api_coverage_at_k": metrics.api_coverage(texts, "__oracle"),
        "mrr": F.when(F.size("__truth") == 0, 0.0).otherwise(metrics.mean_reciprocal_rank(alike)), "retrieval_precision_at_k": F.when(none, 0.0).otherwise(metrics.retrieval_precision("__apis", "__needed")),
        "retrieval_ndcg_at_k": F.when(none, 0.0).when(F.size("__needed") == 0, 1.0).otherwise(metrics.ndcg(gains)), "owner_type_recall": metrics.owner_type_recall(F.transform(results, lambda r: r["invocationProfile"]), "__oracle"),
    }
    able = F.col(results).isNotNull() & (F.size(F.coalesce(invocations, F.array())) > 0)
    old = [f.name for f in samples.schema[column].dataType.fields]
    was = lambda f: F.col(f"{column}.{f}") if f in old else F.lit(None).cast("double")
    fields = [(F.when(able, made[f]).otherwise(was(f)) if f in made else was(f)).alias(f) for f in [*old, *(f for f in made if f not in old)]]
    return given.withColumn(column, F.struct(*fields)).select(*samples.columns)


def recompute_results(samples: DataFrame, root: str, modes: Sequence[str], metrics_: Sequence[str], mode: str = "mode", write: bool = True, **how) -> DataFrame:
    """``recompute`` of a whole result tree: the samples that can be measured, made anew, and their aggregates.

    Retrieval metrics are those the samples have; give samples of ``recompute_retrieval`` to have them anew too.
    With ``write``, samples go to ``<root>/samples`` by mode and the aggregates (``sinks.write_report``) beside them; without, nothing is
    written (a dry run). Samples that are not ``usable`` are kept as they were and are in no aggregate."""
    from lodestone.sources import sinks

    made = stored(recompute(samples, **how))
    if write:
        sinks.write_samples(made, f"{root}/samples", drop=())
        flat = made.filter(usable(how.get("generated", "generated"), how.get("truth", "ground_truth"))).select(mode, f"{how.get('column', 'metrics')}.*")
        sinks.write_report(flat, mode, modes, [m for m in metrics_ if m in flat.columns], root)
    return made


def zero_hits(is_retrieval: Column, n_results: Column, values: Sequence[str] = RETRIEVAL) -> dict[str, Column]:
    """The retrieval metrics as columns: 0 where a retrieval mode found nothing, null in other modes, else as they are."""
    return {v: F.when(~is_retrieval, F.lit(None).cast("double")).when(F.coalesce(n_results, F.lit(0)) == 0, 0.0).otherwise(F.col(v)) for v in values}


def untested() -> Column:
    """The verdict on a sample that is not run: not public, or not compilable. Null where it is to be run or has a verdict.

    Columns: test_eval, method_signature, compilable (null: unchecked)."""
    failed = lambda why: F.struct(F.lit(False).alias("success"), *(F.lit(0).alias(f"tests_{x}") for x in ("run", "passed", "failed")), F.array().cast("array<string>").alias("failed_test_names"), F.lit(False).alias("build_success"), F.array(F.lit(why)).alias("error_messages"), F.lit(0.0).alias("duration_ms"))
    return F.when(F.col("test_eval").isNull(), F.when(~F.startswith("method_signature", F.lit("public ")), failed("Skipped: non-public method")).when(~F.coalesce("compilable", F.lit(True)), failed("Skipped: code does not compile")))
