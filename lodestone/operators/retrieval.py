"""An inverted index as tables, and ranked retrieval as one join for all queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import LONGEST_WORD, STOP_TERMS, WORDS, generic_types, path_is_suffix, query_terms, short_invocation, simple_name
from lodestone.session import stored

#: Clause boosts, share of the other clauses, results per class, default results.
BOOSTS, TIE, PER_CLASS, DEFAULT_K = {"type": 5.0, "signature": 3.0, "package": 2.0, "invocation": 1.0}, 0.1, 2, 5
ANALYZER = WORDS


def over_fetch(k: int) -> int:
    """How many results are looked at before leakage and class limits: 3 k + 10."""
    return 3 * (k if k > 0 else DEFAULT_K) + 10


def analyze(text: Column | str, pattern: str = ANALYZER) -> Column:
    """Lower-cased words: by default as Unicode parts text, so a sign like ``.`` or ``:`` between two letters does not part them, two signs do."""
    words = F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(pattern), F.lit(0))
    if pattern != ANALYZER:
        return words
    pieces = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / LONGEST_WORD).cast("int")), lambda i: F.substring(w, i * LONGEST_WORD + 1, F.lit(LONGEST_WORD)))
    long = F.exists(words, lambda w: F.length(w) > LONGEST_WORD)
    return F.when(long, F.flatten(F.transform(words, pieces))).otherwise(words)


def method_card() -> Column:
    """Labelled text of a method; the signature counts twice."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    exact = F.transform(F.filter("invocations", lambda i: i["resolutionMode"] == "EXACT"), lambda i: i["signature"])
    package = F.regexp_extract("classFqn", r"^(.*)\.[^.]*$", 1)
    parts = [("package", package), ("class", simple_name("classFqn")), ("signature", F.col("methodSignature")), ("signature", F.col("methodSignature")), ("returns", F.col("returnType")), ("params", listed("parameterTypes")), ("throws", listed("thrownExceptions")), ("imports", listed("imports")), ("fields", F.array_join(F.transform(F.coalesce("classFields", F.array()), lambda f: f["typeFqn"]), " ")), ("calls", F.array_join(exact, " ")), ("types", listed("usedTypes"))]
    return F.concat_ws("\n", *(line(k, v) for k, v in parts))


def invocation_profile(invocations: str = "invocations") -> Column:
    """Exact calls in order: ``sig[ xN]`` by first use, then ``bigram:`` and ``trigram:`` lines; empty without a call."""
    ordered = F.transform(F.array_sort(F.transform(F.filter(invocations, lambda i: i["resolutionMode"] == "EXACT"), lambda i: F.struct(i["orderIndex"].alias("o"), i["signature"].alias("s")))), lambda i: i["s"])
    n = F.size(ordered)
    counted = F.transform(F.array_distinct(ordered), lambda s: F.concat(s, F.when(F.size(F.filter(ordered, lambda x: x == s)) > 1, F.concat(F.lit(" x"), F.size(F.filter(ordered, lambda x: x == s)).cast("string"))).otherwise(F.lit(""))))
    short = F.transform(ordered, short_invocation)

    def grams(k: int, label: str) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.concat(F.lit(f"{label}: "), F.array_join(F.slice(short, i, F.lit(k)), " -> ")))
        return F.when(n >= k, made).otherwise(F.array().cast("array<string>"))

    return F.when(n > 0, F.concat(F.array_join(F.concat(counted, grams(2, "bigram"), grams(3, "trigram")), "\n"), F.lit("\n"))).otherwise(F.lit(""))


def type_profile() -> Column:
    """Simple type names of return, parameters, fields, used types, class and supertypes, with repeats."""
    none = F.array().cast("array<string>")
    sources = F.concat(F.array(F.coalesce("returnType", F.lit(""))), F.coalesce("parameterTypes", none), F.transform(F.coalesce("classFields", F.array()), lambda f: f["typeFqn"]), F.coalesce("usedTypes", none), F.array("classFqn"), F.coalesce("supertypes", none))
    return F.array_join(F.flatten(F.transform(sources, generic_types)), " ")


def index_documents(methods: DataFrame, body_limit: int = 5000) -> DataFrame:
    """(doc_id, path, class_fqn, body_offset, signature, field texts) of method rows; longer bodies are not indexed."""
    body = F.when(F.length("methodBody") <= body_limit, F.col("methodBody")).otherwise(F.lit(""))
    return methods.select(
        F.concat_ws("#", "classFqn", "methodName", "bodyStartOffset").alias("doc_id"), F.col("filePath").alias("path"), F.col("classFqn").alias("class_fqn"), F.col("bodyStartOffset").alias("body_offset"), F.col("methodSignature").alias("signature"), F.col("methodBody").alias("content"),
        F.create_map(F.lit("card"), method_card(), F.lit("body"), body, F.lit("profile"), invocation_profile(), F.lit("types"), type_profile()).alias("fields"),
    )


def postings(docs: DataFrame, doc: str, field_texts: Column, pattern: str = ANALYZER) -> DataFrame:
    """(field, term, doc, tf) of a map of field texts.

    Texts are dealt by document before they are taken apart, so the words themselves are never
    shuffled, and all that is grouped by document later stays where it is."""
    dealt = docs.select(F.col(doc).alias("doc"), field_texts.alias("texts")).repartition("doc")
    words = dealt.select("doc", F.explode("texts").alias("field", "text")).select("doc", "field", F.explode(analyze("text", pattern)).alias("term"))
    return words.groupBy("field", "term", "doc").agg(F.count("*").alias("tf"))


def index_stats(posted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, terms, fields): lengths by (field, doc), df and ctf by (field, term), totals by field."""
    lengths = posted.groupBy("field", "doc").agg(F.sum("tf").alias("dl"))
    terms = posted.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
    fields = lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total")).withColumn("avgdl", F.col("total") / F.col("n_docs"))
    return lengths, terms, fields


#: At most so many (query, clause, term) rows are broadcast, about 20 MB.
BROADCAST_TERMS = 200_000


def score_parts() -> dict[str, Column]:
    """BM25 (1.2, 0.75), Jelinek-Mercer (0.7) and Dirichlet (2000), of tf, dl, avgdl, df, ctf, n_docs and total."""
    c = lambda x: F.col(x).cast("double")
    one = F.lit(1.0)
    bm25 = F.log(one + (c("n_docs") - c("df") + 0.5) / (c("df") + 0.5)) * c("tf") / (c("tf") + F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * c("dl") / c("avgdl")))
    p = (c("ctf") + one) / (c("total") + one)
    jm = F.log(one + (F.lit(0.3) * c("tf") / c("dl")) / (F.lit(0.7) * p))
    dirichlet = F.greatest(F.lit(0.0), F.log(one + c("tf") / (F.lit(2000.0) * p)) + F.log(F.lit(2000.0) / (c("dl") + F.lit(2000.0))))
    return {"bm25": bm25, "jelinek_mercer": jm, "dirichlet": dirichlet}


def term_score() -> Column:
    """The sum of ``score_parts``."""
    parts = score_parts()
    return parts["bm25"] + parts["jelinek_mercer"] + parts["dirichlet"]


def score(query_terms_: DataFrame, posted: DataFrame, stats: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query, doc, score, clauses): best clause plus a tenth of the others, for all queries in one join.

    ``query_terms_``: query, clause, boost, field, term, mult. Terms of the queries reach
    the postings before statistics are joined, so only the lists in use are scored. ``stats``: those of
    a written index, which then are not counted again; without them the postings, which statistics and
    lists both read, are stored once.

    With ``BROADCAST_TERMS`` query terms or fewer (counted), terms and their statistics go to the
    postings: these stay dealt by document, and a common term's list meets its queries in all
    tasks and not in one. More terms are joined by shuffles."""
    near = F.broadcast if query_terms_.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else lambda df: df
    if stats is None:
        posted = stored(posted)
    lengths, terms, fields = stats or index_stats(posted)
    wanted = query_terms_.select("field", "term").distinct()
    known = terms.join(near(wanted), ["field", "term"], "left_semi").join(near(fields), "field")
    lists = posted.join(near(known), ["field", "term"]).join(lengths, ["field", "doc"])
    scored = lists.select("field", "term", "doc", term_score().alias("s"))
    per = scored.join(near(query_terms_), ["field", "term"]).groupBy("query", "doc", "clause").agg(F.sum(F.col("boost") * F.col("mult") * F.col("s")).alias("c"))
    best = per.groupBy("query", "doc").agg(F.max("c").alias("top"), F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("clause", "c"))).alias("clauses"))
    return best.select("query", "doc", (F.col("top") + F.lit(TIE) * (F.col("all") - F.col("top"))).alias("score"), "clauses")


def explain(winners: DataFrame, query_terms_: DataFrame, posted: DataFrame, stats: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query, doc, score, clauses): how the score of each winner (query, doc) comes about, as a tree of two levels below the score.

    A clause has its ``value``, its ``share`` of the score (all of the best clause, a tenth of the others; shares add up to the score) and its
    terms; a term has its field, weight (boost times repeats), the three parts of its score and its ``value``, weight times their sum.
    Postings are read a second time, for the winners only: after ranking, a few documents for each query. Terms that a
    document lacks have no entry; a winner without any is left out. Clauses and terms are ordered by value, the largest first."""
    lengths, terms, fields = stats or index_stats(posted)
    few = winners.select("query", "doc").distinct()
    mine = posted.join(F.broadcast(few.select("doc").distinct()) if few.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else few.select("doc").distinct(), "doc", "left_semi")
    asked = few.join(query_terms_, "query")
    known = terms.join(query_terms_.select("field", "term").distinct(), ["field", "term"], "left_semi").join(F.broadcast(fields), "field")  # a row for each field
    sized = mine.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc", "field"))) if stats is None else mine.join(lengths, ["field", "doc"])
    met = asked.join(sized, ["field", "term", "doc"]).join(known, ["field", "term"])
    parts = score_parts()
    weight = F.col("boost") * F.col("mult")
    valued = met.select("query", "doc", "clause", "field", "term", weight.alias("weight"), *(p.alias(n) for n, p in parts.items())).withColumn("value", F.col("weight") * (F.col("bm25") + F.col("jelinek_mercer") + F.col("dirichlet")))
    term = F.struct((-F.col("value")).alias("o"), F.struct("term", "field", "weight", *parts, "value").alias("x"))
    clauses = valued.groupBy("query", "doc", "clause").agg(F.sum("value").alias("value"), F.transform(F.array_sort(F.collect_list(term)), lambda t: t["x"]).alias("terms"))
    tree = clauses.groupBy("query", "doc").agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("o"), "clause", "value", "terms"))).alias("cs"))
    shared = F.transform("cs", lambda c, i: F.struct(c["clause"].alias("clause"), c["value"].alias("value"), (c["value"] * F.when(i == 0, 1.0).otherwise(TIE)).alias("share"), c["terms"].alias("terms")))
    return tree.select("query", "doc", shared.alias("clauses")).select("query", "doc", F.aggregate("clauses", F.lit(0.0), lambda a, c: a + c["share"]).alias("score"), "clauses")


def external_results(results: DataFrame, leaks: Column, k: int, query: str = "query", rank: str = "rank") -> DataFrame:
    """An outside retriever's results (it is asked for ``k + 3``): of the first so many, those without leaks, ranked anew, ``k`` at most."""
    w = Window.partitionBy(query).orderBy(rank)
    asked = results.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k + 3).drop("__n")
    clean = asked.filter(~F.coalesce(leaks, F.lit(False)))
    return clean.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def build_query_terms(requests: DataFrame) -> DataFrame:
    """Terms of the four clauses of search requests, or the class name alone where all are empty.

    ``requests``: query, methodSignature, classFqn, supertypes, imports, classFields, siblingOwnerTypes."""
    none, text = F.array().cast("array<string>"), lambda c: F.coalesce(c, F.lit(""))
    whole = lambda terms: F.filter(F.transform(terms, F.lower), lambda x: (F.length(x) >= 3) & ~x.isin(*STOP_TERMS))
    names = lambda c: F.transform(F.coalesce(F.col(c), none), simple_name)
    signature_types = F.filter(F.split(text("methodSignature"), "[^a-zA-Z0-9]+"), lambda x: x.rlike("^[A-Z]"))
    types = F.slice(F.array_distinct(whole(F.concat(names("imports"), names("classFields"), names("supertypes"), signature_types))), 1, 80)
    head = F.substring_index(text("methodSignature"), "(", 1)
    # The limit of ten terms is that of the name; class and supertypes come on top.
    signature = F.concat(F.slice(query_terms(F.array(head)), 1, 10), whole(F.concat(F.array(simple_name(text("classFqn"))), names("supertypes"))))
    segments = F.split(F.regexp_extract(text("classFqn"), r"^(.*)\.[^.]*$", 1), r"\.")
    tail = F.slice(segments, F.greatest(F.size(segments) - 1, F.lit(1)), F.lit(2))
    package = F.filter(whole(tail), lambda x: ~x.isin("com", "org", "lib", "core", "main", "src"))
    owners = whole(F.slice(F.coalesce("siblingOwnerTypes", none), 1, 20))
    fields = {"type": "types", "signature": "card", "package": "card", "invocation": "profile"}
    clause = lambda k, terms: F.transform(terms, lambda t: F.struct(F.lit(k).alias("clause"), F.lit(BOOSTS[k]).alias("boost"), F.lit(fields[k]).alias("field"), t.alias("term")))
    listed = F.concat(clause("type", types), clause("signature", signature), clause("package", package), clause("invocation", owners))
    fallback = F.array(F.struct(F.lit("fallback").alias("clause"), F.lit(1.0).alias("boost"), F.lit("card").alias("field"), F.lower(simple_name(F.coalesce("classFqn", F.lit("")))).alias("term")))
    exploded = requests.select("query", F.explode(F.when(F.size(listed) > 0, listed).otherwise(fallback)).alias("q")).select("query", "q.*")
    return exploded.groupBy("query", "clause", "boost", "field", "term").agg(F.count("*").alias("mult"))


def fetched(scored: DataFrame, k: int = DEFAULT_K, doc: str = "doc", digits: int = 6) -> DataFrame:
    """The rows that ``top_k`` looks at, the first ``over_fetch(k)`` of each query: cut to them before columns are joined to the results."""
    order = [F.round("score", digits).desc(), F.col(doc)]
    return scored.withColumn("__f", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("__f") <= over_fetch(k)).drop("__f")


def top_k(scored: DataFrame, leaks: Column, group: str, k: int = DEFAULT_K, doc: str = "doc", digits: int = 6) -> DataFrame:
    """Ranked results: over-fetch by score, drop leaks, at most two per group, then k. Ties go by document.

    ``leaks`` is a condition on the row. The bound of the over-fetch is part of the result:
    what lies beyond it is never considered."""
    k = k if k > 0 else DEFAULT_K
    order = [F.round("score", digits).desc(), F.col(doc)]
    clean = fetched(scored, k, doc, digits).filter(~F.coalesce(leaks, F.lit(False)))
    capped = clean.withColumn("__c", F.row_number().over(Window.partitionBy("query", group).orderBy(*order))).filter(F.col("__c") <= PER_CLASS).drop("__c")
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)


def index_leak(class_fqn: str, offset: str, path: str, q_class: str, q_offset: str, q_path: str) -> Column:
    """Same class and offset, or same path."""
    c = F.col
    return ((c(class_fqn) == c(q_class)) & (c(offset) == c(q_offset))) | (c(path) == c(q_path))


def external_leak(path: str, q_path: str, class_fqn: str, q_class: str) -> Column:
    """Paths equal or one the tail of the other, or the same class where both are named."""
    same = (F.col(class_fqn) != "") & (F.col(q_class) != "") & (F.col(class_fqn) == F.col(q_class))
    return path_is_suffix(path, q_path) | F.coalesce(same, F.lit(False))


def paired_by_verdict(queries: DataFrame, documents: DataFrame, on: str, told: Sequence[str], seen: Sequence[str], verdict: Column) -> DataFrame:
    """Pairs of rows with the same ``on`` for which ``verdict`` holds, a condition on ``told`` of a query and ``seen`` of a document.

    It is judged once for all rows that agree in these columns, and what holds is spread over their rows by equal keys. Null is a value
    like others here; columns of both sides have different names."""
    held = queries.select(on, *told).distinct().join(documents.select(on, *seen).distinct(), on).filter(verdict)
    c = lambda side, name: F.col(f"{side}.{name}")
    equal = lambda a, b, columns: reduce(lambda x, y: x & y, (c(a, n).eqNullSafe(c(b, n)) for n in columns), c(a, on) == c(b, on))
    rest = [n for n in documents.columns if n != on]
    spread = held.alias("h").join(documents.alias("d"), equal("h", "d", seen)).select(*(c("h", n) for n in (on, *told)), *(c("d", n) for n in rest))
    return queries.alias("q").join(spread.alias("s"), equal("q", "s", told)).select(*(c("q", n) for n in queries.columns), *(c("s", n) for n in rest))


def score_threshold(results: DataFrame, ratio: float = 0.3, most: int | None = None) -> DataFrame:
    """Results of at least ``ratio`` of their query's best score, ``most`` at most."""
    w = Window.partitionBy("query")
    kept = results.withColumn("__top", F.max("score").over(w)).filter(F.col("score") >= F.col("__top") * ratio).drop("__top")
    return kept if most is None else kept.withColumn("__n", F.row_number().over(w.orderBy("rank"))).filter(F.col("__n") <= most).drop("__n")


class Retrievers:
    """Retrievers by name: a table of requests in, a table of results out."""

    def __init__(self):
        self._by_name: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, search: Callable[[DataFrame], DataFrame]) -> None:
        self._by_name[name] = search

    def mode(self, mode: str) -> Callable[[DataFrame], DataFrame]:
        """The retriever of a mode ``rag_<name>``; ``retrieval_augmentation`` is the default one."""
        return self._by_name["default" if mode == "retrieval_augmentation" else mode.removeprefix("rag_")]

    def register_rows(self, name: str, schema: str, search: Callable[[dict], Iterable[dict]]) -> None:
        """A retriever that answers one request with many results, run in Arrow batches."""

        def run(batches):
            for requests in batches:
                rows = [r for q in requests.to_dict("records") for r in search(q)]
                yield pd.DataFrame(rows, columns=[x.strip().split(" ")[0] for x in schema.split(",")])

        self.register(name, lambda requests: requests.mapInPandas(run, schema))
