"""Search requests from method rows, and results as search responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of code sent before and after the hole, default results, share at which a result is a near copy.
REACH, TOP_K, NEAR = 500, 5, 0.8


def search_request(methods: DataFrame, key: str, top_k: int = TOP_K, near: float = NEAR) -> DataFrame:
    """(key, request, targetMethodBody) of method rows.

    Owners are the sorted simple class names, of three letters or more, of the siblings' exact calls; a call without
    ``::`` counts as owner as a whole. Used types keep their first occurrence."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none)
    sibling = F.coalesce("siblingMethods", F.array())
    calls = F.flatten(F.transform(sibling, lambda s: F.coalesce(s["invocations"], F.array())))
    owner = lambda i: F.substring_index(F.substring_index(i["signature"], "::", 1), ".", -1)
    owners = F.filter(F.transform(F.filter(calls, lambda i: i["resolutionMode"] == "EXACT"), owner), lambda x: F.length(x) >= 3)
    before, after = F.substring("fileContent", F.lit(1), F.col("bodyStartOffset") + 1), F.substring("fileContent", F.col("bodyEndOffset") + 1, F.length("fileContent"))
    request = F.struct(
        "methodSignature", "classFqn", listed("supertypes").alias("supertypes"), listed("imports").alias("imports"),
        F.transform(F.coalesce("classFields", F.array()), lambda f: f["typeFqn"]).alias("classFields"),
        F.transform(sibling, lambda s: s["signature"]).alias("siblingSignatures"), F.array_sort(F.array_distinct(owners)).alias("siblingOwnerTypes"),
        F.array_distinct(F.flatten(F.transform(sibling, lambda s: F.coalesce(s["usedTypes"], none)))).alias("siblingUsedTypes"),
        F.right(before, F.lit(REACH)).alias("fimPrefix"), F.left(after, F.lit(REACH)).alias("fimSuffix"),
        F.col("filePath").alias("targetFilePath"), F.col("bodyStartOffset").alias("targetBodyStartOffset"), F.lit(top_k).alias("topK"), F.lit(near).alias("nearDuplicateThreshold"),
    )
    return methods.select(key, request.alias("request"), F.col("methodBody").alias("targetMethodBody"))


def external_request(methods: DataFrame, key: str) -> DataFrame:
    """(key and the columns of a request to a retriever outside)."""
    return methods.select(key, F.col("fileContent").alias("sourceCode"), "bodyStartOffset", "bodyEndOffset", "filePath", F.lit("").alias("userPrompt"), F.col("methodBody").alias("targetMethodBody"))


def masking(start: Column, end: Column, extra: Column | None = None) -> Column:
    """A masking variant: offset of the hole, its range, further ranges, and whether the range is empty."""
    more = extra if extra is not None else F.array().cast("array<struct<start:int,end:int>>")
    return F.struct(start.alias("offset"), F.struct(start.alias("start"), end.alias("end")).alias("range"), more.alias("more"), (start == end).alias("empty"))


def plain_request(rows: DataFrame, key: str, source: str, offset: str, path: str, mask: str | None = None, top_k: int = TOP_K) -> DataFrame:
    """Requests that know no more than a source and an offset: (key, request, targetMethodBody) with empty metadata.

    With a masking variant the suffix begins after the masked range, whose text is the target's body."""
    s, at, n = F.col(source), F.col(offset), F.length(source)
    end = F.col(f"{mask}.range.end") if mask else at
    prefix = F.when(s.isNull() | (at <= 0), "").otherwise(F.right(F.substring(s, F.lit(1), at), F.least(F.lit(REACH), at)))
    suffix = F.when(s.isNull() | (at < 0), "").otherwise(F.substring(s, end + 1, F.lit(REACH)))
    body = F.when(s.isNotNull() & (end <= n), F.substring(s, F.col(f"{mask}.range.start") + 1, end - F.col(f"{mask}.range.start"))).otherwise("") if mask else F.lit("")
    none = F.array().cast("array<string>")
    lists = (none.alias(c) for c in ("supertypes", "imports", "classFields", "siblingSignatures", "siblingOwnerTypes", "siblingUsedTypes"))
    request = F.struct(F.lit("").alias("methodSignature"), F.lit("").alias("classFqn"), *lists, prefix.alias("fimPrefix"), suffix.alias("fimSuffix"), F.coalesce(F.col(path), F.lit("")).alias("targetFilePath"), at.alias("targetBodyStartOffset"), F.lit(top_k).alias("topK"), F.lit(NEAR).alias("nearDuplicateThreshold"))
    return rows.select(key, request.alias("request"), F.coalesce(body, F.lit("")).alias("targetMethodBody"))


def tag_text(scores: str) -> Column:
    """A map from tag to score as ``name=0.1234, ...``, tags in order of their identity (their name)."""
    entries = F.array_sort(F.map_entries(scores))
    return F.array_join(F.transform(F.coalesce(entries, F.array()), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"].cast("double")))), ", ")


def response(results: DataFrame, query: str, order: str, elapsed: str | None = None) -> DataFrame:
    """(query, results, totalResults, searchTimeMs, error): a response for each query, ranks by ``order`` from 1.

    ``results``: id, path, content, score, and ``tags`` (a map) or ``explain``; what a retriever does not know is ''."""
    has = set(results.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("")
    explain = tag_text("tags") if "tags" in has else text("explain")
    row = F.struct(F.col(order).alias("__o"), text("id").alias("id"), text("path").alias("filePath"), text("class_fqn").alias("classFqn"), text("signature").alias("signature"), text("method_body").alias("methodBody"), F.col("score"), explain.alias("explain"), text("content").alias("content"))
    gathered = results.groupBy(query).agg(F.array_sort(F.collect_list(row)).alias("rs"), (F.max(elapsed) if elapsed else F.lit(0)).cast("long").alias("searchTimeMs"))
    fields = ("id", "filePath", "classFqn", "signature", "methodBody", "score", "explain", "content")
    ranked = F.transform("rs", lambda r, i: F.struct(*(r[f].alias(f) for f in fields), (i + 1).alias("rank")))
    return gathered.select(query, ranked.alias("results"), F.size("rs").alias("totalResults"), "searchTimeMs", F.lit("").alias("error"))
