"""Enrichment of samples and results: calls found in text, tests and what they call, matching of external results, overlap of results with a query."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.metrics import set_iou
from lodestone.functions.text import KEYWORDS, STOP_TYPES, body_block, generic_types, invocation_owner, parameter_types, path_is_suffix, simple_name, simplify_signature, type_tokens
from lodestone.operators.prompt import FILE, blanked

_CALL = re.compile(r"(?:\bnew\s+([A-Z]\w*)(?:<[^<>()]*>)?|((?:\w+\s*\.\s*)*)\b([a-z_]\w*))\s*\(")
_TEST = re.compile(r"@(?:Test|ParameterizedTest|RepeatedTest)\b")
_HEAD = re.compile(r"\b(\w+)\s*\([^(){}]*\)\s*(?:throws\s+[\w.,\s]+)?\{")


def calls_in(code: str) -> list[dict]:
    """Calls of a piece of code in order: ``obj.name``, ``name`` and ``<init>(Type)``; comments and literals hold none."""
    out = []
    for m in _CALL.finditer(blanked(code or "")):
        if m[1]:
            name = f"<init>({m[1]})"
        elif m[3] in KEYWORDS:
            continue
        else:
            name = re.sub(r"\s+", "", m[2]) + m[3]
        out.append({"signature": name, "orderIndex": len(out)})
    return out


def tests_in(path: str, code: str) -> list[dict]:
    """Test methods of a source text, with the names that each calls."""
    plain, out = blanked(code or ""), []
    package = re.search(r"\bpackage\s+([\w.]+)\s*;", plain)
    owner = re.search(r"\b(?:class|record)\s+(\w+)", plain)
    for m in _TEST.finditer(plain):
        head = _HEAD.search(plain, m.end())
        if not head:
            continue
        depth, end = 1, head.end()
        while end < len(plain) and depth:
            depth += {"{": 1, "}": -1}.get(plain[end], 0)
            end += 1
        called = [c["signature"].rsplit(".", 1)[-1] for c in calls_in(plain[head.end() : end])]
        out.append({"test_file": path, "test_class": ".".join(filter(None, (package and package[1], owner and owner[1]))), "test_method": head[1], "called": list(dict.fromkeys(called))})
    return out


def with_calls(df: DataFrame, code: str, out: str = "generated_invocations") -> DataFrame:
    """``df`` with the calls found in a column of code; null code has none."""

    @F.pandas_udf("array<struct<signature: string, orderIndex: int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(calls_in)

    return df.withColumn(out, run(code))


def calls_of_bodies(bodies: DataFrame) -> DataFrame:
    """(index, invocations, error) of a batch of generated bodies; an entry that cannot be read has no calls and says why."""
    start, end, size = F.col("bodyStartOffset"), F.col("bodyEndOffset"), F.length("fileContent")
    error = F.when(F.col("fileContent").isNull(), "no file content").when(F.col("generatedBody").isNull(), "no generated body").when(start.isNull() | end.isNull() | (start < 0) | (end < start) | (end > size), "offsets outside the file")
    called = with_calls(bodies.withColumn("error", error).withColumn("__code", F.when(error.isNull(), F.col("generatedBody"))), "__code", "invocations")
    return called.select("index", "invocations", "error")


def tests_table(sources: DataFrame) -> DataFrame:
    """(test_file, test_class, test_method, called) of source texts (path, text)."""

    def run(batches):
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["text"], strict=True) for r in tests_in(p, t)]
            yield pd.DataFrame(rows, columns=["test_file", "test_class", "test_method", "called"])

    return sources.select("path", "text").mapInPandas(run, "test_file string, test_class string, test_method string, called array<string>")


def match_methods(results: DataFrame, methods: DataFrame) -> DataFrame:
    """External results (result, path, id) matched to methods (ord, path, class_fqn, name, signature, params), at most one each.

    First the file: equal paths, else one the tail of the other (the first file in order).
    Then within it: the only method; id ``class#name`` or the signature; the name; equal
    parameter types; the name inside the id; most parameters. Ties go by order. ``error``
    says why a result has no match."""
    base = lambda c: F.substring_index(F.translate(F.col(c), "\\", "/"), "/", -1)
    named = results.withColumns({"__file": base("path"), "error": F.when(F.coalesce("path", F.lit("")) == "", "no path").when(F.coalesce("id", F.lit("")) == "", "no id")})
    files = methods.groupBy(F.col("path").alias("m_path")).agg(F.min("ord").alias("first")).withColumn("__file", base("m_path"))
    near = named.filter("error is null").join(files, "__file").withColumn("far", F.when(F.col("path") == F.col("m_path"), 0).when(path_is_suffix("path", "m_path"), 1)).filter("far is not null")
    chosen = near.groupBy("result").agg(F.min_by("m_path", F.struct("far", "first")).alias("m_path"))
    pool = chosen.join(methods.withColumnRenamed("path", "m_path"), "m_path").join(results.select("result", "id"), "result")
    alone = F.count("*").over(Window.partitionBy("result")) == 1
    id_name = F.regexp_extract(F.substring_index(F.substring_index("id", "#", -1), "::", -1), r"^([^(]*)", 1)
    id_params = F.transform(parameter_types(F.regexp_extract("id", r"\(([^)]*)\)", 1)), simple_name)
    tier = (
        F.when(alone, 0)
        .when((F.col("id") == F.concat_ws("#", "class_fqn", "name")) | (F.col("id") == F.col("signature")), 1)
        .when((id_name == F.col("name")) & F.contains("id", F.lit("(")) & (id_params == F.transform("params", simple_name)), 2)
        .when(id_name == F.col("name"), 3)
        .when(F.contains("id", F.col("name")), 4)
        .otherwise(5)
    )
    best = pool.withColumn("tier", tier).withColumn("nth", F.row_number().over(Window.partitionBy("result").orderBy("tier", F.size("params").desc(), "ord"))).filter("nth = 1")
    found = best.select("result", F.col("ord").alias("method_ord"), "tier")
    return named.drop("__file").join(found, "result", "left").withColumn("error", F.coalesce("error", F.when(F.col("method_ord").isNull(), "no such file")))


def _owners(profile: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(profile, F.lit("")), "\n"), lambda x: (x != "") & ~x.rlike("^(?:bigram|trigram): "))
    return F.array_distinct(F.filter(F.transform(lines, lambda x: F.lower(simple_name(invocation_owner(x)))), lambda x: F.length(x) >= 3))


def overlap(pairs: DataFrame) -> DataFrame:
    """Overlap of each result with its query: types, owners and signature terms, and which oracle calls it shows.

    ``pairs``: query_types, query_owners, query_signature, oracle (owner, method structs),
    type_profile, invocation_profile, signature, card."""
    types = F.array_distinct(F.transform(generic_types(F.coalesce("type_profile", F.lit(""))), F.lower))
    wanted = F.array_except(F.array_distinct(F.transform("query_types", F.lower)), F.array(*map(F.lit, STOP_TYPES)))
    shown = F.lower(F.concat_ws("\n", "card", "invocation_profile"))
    hit = F.filter("oracle", lambda o: F.contains(shown, F.lower(o["owner"])) & F.contains(shown, F.lower(o["method"])))
    missed = F.array_except(F.col("oracle"), hit)
    return pairs.withColumns(
        {
            "type_iou": F.round(set_iou(wanted, types), 3),
            "owner_iou": set_iou(F.col("query_owners"), _owners(F.col("invocation_profile"))),
            "shared_types": F.array_sort(F.array_intersect(wanted, types)),
            "shared_owners": F.array_sort(F.array_intersect(F.col("query_owners"), _owners(F.col("invocation_profile")))),
            "shared_terms": F.size(F.array_intersect(type_tokens("query_signature"), type_tokens("signature"))),
            "oracle_found": F.slice(hit, 1, 10),
            "oracle_missed": F.slice(missed, 1, 10),
            "oracle_recall": F.size(hit) / F.greatest(F.size("oracle"), F.lit(1)),
        }
    )


def compare_calls(samples: DataFrame, oracle: str, generated: str) -> DataFrame:
    """IoU and recall of generated against oracle calls, by exact signature and by simple name.

    Two empty sides: IoU 1; an empty oracle: recall 1. ``primary`` is the signature pair
    where any generated call is exact."""
    exact = lambda c: F.array_distinct(F.transform(F.filter(c, lambda i: i["resolutionMode"] == "EXACT"), lambda i: i["signature"]))
    name = lambda i: F.substring_index(F.substring_index(F.substring_index(i["signature"], "(", 1), "::", -1), ".", -1)
    plain = lambda c: F.array_distinct(F.transform(c, name))
    recall = lambda a, b: F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    return samples.withColumns(
        {
            "signature_iou": set_iou(exact(oracle), exact(generated), 1.0),
            "signature_recall": recall(exact(oracle), exact(generated)),
            "name_iou": set_iou(plain(oracle), plain(generated), 1.0),
            "name_recall": recall(plain(oracle), plain(generated)),
            "primary": F.when(F.exists(generated, lambda i: i["resolutionMode"] == "EXACT"), "signature").otherwise("name"),
        }
    )


def result_block(results: DataFrame, max_lines: int = 50, max_tokens: int = 4096) -> DataFrame:
    """(query, block): the results of a query as text in rank order, within ``4 * max_tokens`` characters.

    A longer block ends where the last result begins whose mark lies within them; a first result that is longer alone is cut. A result with content shows it under its path; one without shows package, class,
    signature and body."""

    package = F.regexp_extract("class_fqn", r"^(.*)\.[^.]*$", 1)
    structured = F.concat_ws("\n", F.when(package != "", F.concat(F.lit("package "), package, F.lit(";"))), F.concat(F.lit("// class "), simple_name("class_fqn")), simplify_signature("signature"), F.col("__body"))
    text = F.concat(F.lit(FILE), F.col("path"), F.lit("\n"), F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(structured))
    sized = results.withColumn("__body", body_block("method_body", max_lines)).withColumn("text", text)
    room, mark = 4 * max_tokens, f"\n{FILE}"
    # What begins beyond the room is never shown, so a query with many results gathers no more than the room and one result.
    begins = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = sized.withColumn("__n", begins).filter(F.col("__n") <= room)
    whole = near.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("block"))
    shown = F.left("block", F.lit(room))
    tail = F.length(F.substring_index(shown, mark, -1)) + len(mark)
    cut = F.when(F.contains(shown, F.lit(mark)), F.substring(shown, F.lit(1), F.length(shown) - tail)).otherwise(shown)
    return whole.select("query", F.when(F.length("block") > room, cut).otherwise(F.col("block")).alias("block"))
