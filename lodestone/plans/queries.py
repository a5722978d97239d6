"""The engine's operators as queries over the synthetic tables, each with DuckDB SQL where SQL can say it.

The tables stand in for the operators' own data: documents for methods and indexed files,
benchmark for search requests, events and conversations for samples by mode, orders and
lineitem for test verdicts, and the supply relation between nations for calls.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import kernels, metrics, text
from lodestone.operators import analysis, dataset, graph, mining, prompt, retrieval
from lodestone.session import shared_folder
from lodestone.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WORD = r"[a-z0-9_]+(?:\.[a-z0-9_]+)*"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# Retrieval ---------------------------------------------------------------------------------------

_POST = f"post as (select doc_id as doc, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) as term from documents) group by all)"
_STATS = "dl as (select doc, sum(tf) as dl from post group by all), ts as (select term, count(*) as df, sum(tf) as ctf from post group by all), fs as (select count(*) as n_docs, sum(dl) as total, sum(dl) / count(*) as avgdl from dl)"
_TERM = """ln(1e0 + (n_docs - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))
 + ln(1e0 + (0.3e0 * tf / dl) / (0.7e0 * ((ctf + 1e0) / (total + 1e0))))
 + greatest(0e0, ln(1e0 + tf / (2000e0 * ((ctf + 1e0) / (total + 1e0)))) + ln(2000e0 / (dl + 2000e0)))"""
_Q = f"q as (select item_id as query, term, count(*) as mult from (select item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) as term from benchmark) group by all)"
_SCORED = f"scored as (select query, doc, sum(mult * ({_TERM})) as score from q join post using (term) join ts using (term) join dl using (doc), fs group by all)"
_TOP = """ranked as (select query, doc, score, source, row_number() over (partition by query order by round(score, 6) desc, doc) as f from scored join documents on doc = doc_id),
clean as (select * from ranked where f <= 25 and source <> 'src' || query),
capped as (select *, row_number() over (partition by query, source order by round(score, 6) desc, doc) as c from clean),
top as (select query, doc, source, score, row_number() over (partition by query order by round(score, 6) desc, doc) as rank from capped where c <= 2)"""
_RETRIEVAL = f"with {_POST}, {_STATS}, {_Q}, {_SCORED}, {_TOP}"


def _postings(spark, sf):
    return retrieval.postings(t(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.create_map(F.lit("body"), F.col("text")), WORD)


def _terms(spark, sf):
    words = t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(retrieval.analyze("text", WORD)).alias("term"))
    return words.groupBy("query", "term").agg(F.count("*").alias("mult")).select("query", F.lit("body").alias("clause"), F.lit(1.0).alias("boost"), F.lit("body").alias("field"), "term", "mult")


def _results(spark, sf, posted=None, stats=None):
    scored = retrieval.fetched(retrieval.score(_terms(spark, sf), _postings(spark, sf) if posted is None else posted, stats).drop("clauses"))
    sourced = scored.join(t(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    return retrieval.top_k(sourced, F.col("source") == F.concat(F.lit("src"), F.col("query").cast("string")), "source")


@query(f"{_RETRIEVAL} select query, doc, source, round(score, 6) as score, cast(rank as int) as rank from top where rank <= 5")
def retrieval_topk(spark, sf):
    return _results(spark, sf).select("query", "doc", "source", r6("score", "score"), "rank")


@query(f"{_RETRIEVAL}, best as (select *, max(score) over (partition by query) as b from top where rank <= 5) select query, doc, cast(rank as int) as rank from best where score >= 0.9e0 * b and rank <= 3")
def retrieval_threshold(spark, sf):
    return retrieval.score_threshold(_results(spark, sf), 0.9, 3).select("query", "doc", "rank")


@query(f"""with post as (select 'body' as field, doc_id as doc, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) as term from documents) group by all
 union all select 'meta', doc_id, term, count(*) from (select doc_id, unnest(regexp_extract_all(lower(source || ' ' || lang), '{WORD}')) as term from documents) group by all),
dl as (select field, doc, sum(tf) as dl from post group by all), ts as (select field, term, count(*) as df, sum(tf) as ctf from post group by all), fs as (select field, count(*) as n_docs, sum(dl) as total, sum(dl) / count(*) as avgdl from dl group by all),
q as (select item_id as query, 'body' as field, 1e0 as boost, term, count(*) as mult from (select item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) as term from benchmark) group by all
 union all select item_id, 'meta', 5e0, 'src' || (item_id % 20), 1 from benchmark),
clause as (select query, doc, field, sum(boost * mult * ({_TERM})) as c from q join post using (field, term) join ts using (field, term) join dl using (field, doc) join fs using (field) group by all),
scored as (select query, doc, max(c) + 0.1e0 * (sum(c) - max(c)) as score from clause group by all),
{_TOP} select query, doc, source, round(score, 6) as score, cast(rank as int) as rank from top where rank <= 5""")
def retrieval_dismax(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", F.create_map(F.lit("body"), F.col("text"), F.lit("meta"), F.concat_ws(" ", "source", "lang")).alias("fields"))
    meta = t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.lit("meta").alias("clause"), F.lit(retrieval.BOOSTS["type"]).alias("boost"), F.lit("meta").alias("field"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("term"), F.lit(1).cast("long").alias("mult"))
    scored = retrieval.fetched(retrieval.score(_terms(spark, sf).unionByName(meta), retrieval.postings(docs, "doc_id", F.col("fields"), WORD)).drop("clauses"))
    sourced = scored.join(t(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    return retrieval.top_k(sourced, F.col("source") == F.concat(F.lit("src"), F.col("query").cast("string")), "source").select("query", "doc", "source", r6("score", "score"), "rank")


@query(f"with {_POST} select term, count(*) as df, cast(sum(tf) as bigint) as ctf from post group by all")
def token_stats(spark, sf):
    return retrieval.index_stats(_postings(spark, sf))[1].select("term", "df", "ctf")


_SETS = "qs as (select item_id as query, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as qt from benchmark), ds as (select doc_id as doc, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as dt from documents), m as (select query, rank, len(list_intersect(qt, dt)) as hit, len(list_distinct(list_concat(qt, dt))) as uni, qt, dt from top join qs using (query) join ds using (doc) where rank <= 5)"


def _judged(spark, sf):
    words = lambda name: F.array_distinct(retrieval.analyze(name, "[a-z0-9_]+"))
    qs = t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), words("text").alias("qt"))
    ds = t(spark, sf, "documents").select(F.col("doc_id").alias("doc"), words("text").alias("dt"))
    both = _results(spark, sf).select("query", "doc", "rank").join(ds, "doc").join(qs, "query")
    row = F.struct("rank", F.size(F.array_intersect("qt", "dt")).cast("double").alias("gain"), metrics.set_iou("qt", "dt").alias("similarity"), F.col("dt"))
    return both.groupBy("query").agg(F.array_sort(F.collect_list(row)).alias("rs"), F.first("qt").alias("qt"))


@query(f"""{_RETRIEVAL}, {_SETS},
g as (select query, sum(hit / log2(rank + 1)) as dcg from m group by all),
i as (select query, sum(hit / log2(n + 1)) as idcg from (select query, hit, row_number() over (partition by query order by hit desc) as n from m) group by all),
f as (select query, min(rank) filter (where hit / uni >= 0.3) as first_rank, avg(case when hit > 0 then 1e0 else 0e0 end) as p, avg(hit / uni) as iou from m group by all)
select query, round(p, 6) as precision_at_k, round(case when idcg = 0 then 0e0 else dcg / idcg end, 6) as ndcg, round(coalesce(1e0 / first_rank, 0e0), 6) as mrr, round(iou, 6) as mean_iou from f join g using (query) join i using (query)""")
def retrieval_quality(spark, sf):
    j = _judged(spark, sf)
    arrays = F.transform("rs", lambda r: r["dt"])
    return j.select("query", r6(metrics.retrieval_precision(arrays, "qt"), "precision_at_k"), r6(metrics.ndcg(F.transform("rs", lambda r: r["gain"])), "ndcg"), r6(metrics.mean_reciprocal_rank("rs"), "mrr"), r6(metrics.mean_iou("qt", arrays), "mean_iou"))


@query(f"{_RETRIEVAL}, {_SETS}, a as (select query, any_value(qt) as qt, list_distinct(flatten(list(dt))) as found from m group by all) select query, round(len(list_intersect(qt, found)) / len(qt), 6) as coverage from a")
def api_coverage(spark, sf):
    j = _judged(spark, sf).withColumn("found", F.array_distinct(F.flatten(F.transform("rs", lambda r: r["dt"]))))
    return j.select("query", r6(metrics.recall_of("found", "qt"), "coverage"))


# Text and similarity -----------------------------------------------------------------------------


def _turns(spark, sf):
    c = t(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.select("conv_id", "turn", F.col("text").alias("a")).join(nxt, ["conv_id", "turn"])


_TOKEN_SQL = "[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+(?:\\.[0-9]+)?|[^\\s]"


@query(f"""with p as (select x.conv_id, x.turn, x.text as a, y.text as b from conversations x join conversations y on x.conv_id = y.conv_id and y.turn = x.turn + 1),
ta as (select conv_id, turn, tok, count(*) as n from (select conv_id, turn, unnest(regexp_extract_all(a, '{_TOKEN_SQL}')) as tok from p) group by all),
tb as (select conv_id, turn, tok, count(*) as n from (select conv_id, turn, unnest(regexp_extract_all(b, '{_TOKEN_SQL}')) as tok from p) group by all),
s as (select conv_id, turn, sum(least(coalesce(ta.n, 0), coalesce(tb.n, 0))) as i, sum(greatest(coalesce(ta.n, 0), coalesce(tb.n, 0))) as u from ta full join tb using (conv_id, turn, tok) group by all)
select conv_id, turn, round(coalesce(i / u, 1e0), 6) as iou from p left join s using (conv_id, turn)""")
def token_iou_pairs(spark, sf):
    p = _turns(spark, sf).select("conv_id", "turn", F.sort_array(text.tokens("a", True)).alias("ta"), F.sort_array(text.tokens("b", True)).alias("tb"))
    return p.select("conv_id", "turn", r6(metrics.token_iou_sorted("ta", "tb"), "iou"))


_ASCII = lambda c: f"regexp_replace({c}, '[^ -~]', '?', 'g')"


@query(f"""with b as (select item_id, {_ASCII("text")} as x from benchmark) select a.item_id, round(1e0 - levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x)), 6) as similarity, a.x = b.x as same from b a join b on b.item_id = a.item_id + 1""")
def edit_similarity_pairs(spark, sf):
    b = t(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "?").alias("x"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    return b.join(nxt, "item_id").select("item_id", r6(metrics.edit_similarity("x", "y"), "similarity"), metrics.exact_match("x", "y").alias("same"))


@query("select min(doc_id) as first_doc, count(*) as n from documents group by md5(text) having count(*) > 1")
def exact_match_dupes(spark, sf):
    return t(spark, sf, "documents").groupBy(F.md5("text")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1").select("first_doc", "n")


@query()
def lcs_pairs(spark, sf):
    p = _turns(spark, sf).select("conv_id", "turn", text.tokens("a").alias("ta"), text.tokens("b").alias("tb")).withColumn("lcs_length", kernels.lcs_length_udf("ta", "tb"))
    return p.select("conv_id", "turn", "lcs_length", r6(metrics.ratio_to_longest("lcs_length", "ta", "tb"), "lcs_ratio"), F.array_join(kernels.lcs_tokens_udf("ta", "tb"), " ").alias("lcs"))


@query()
def lcsubstring_pairs(spark, sf):
    p = _turns(spark, sf).select("conv_id", "turn", text.tokens(text.strip_identifiers("a")).alias("ta"), text.tokens(text.strip_identifiers("b")).alias("tb"))
    return p.select("conv_id", "turn", F.array_join(kernels.common_substring_udf("ta", "tb"), " ").alias("common"))


@query(r"""with a as (select page_id, regexp_replace(regexp_replace(html, '//[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g') as c from pages)
select page_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(c, '\r\n|[\n\x0B\f\r\x{0085}\x{2028}\x{2029}]'), lambda l: regexp_replace(regexp_replace(l, '\s+', ' ', 'g'), '^ | $', '', 'g')), lambda l: l <> ''), chr(10))) as normalized from a""")
def normalize_code(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.md5(text.normalize_code("html")).alias("normalized"))


@query(r"""select doc_id, cast(greatest(1, floor(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\s0-9A-Za-z_]|\s+')) * 0.85e0 + 0.5e0)) as int) as n_tokens from documents""")
def estimated_tokens(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.count_tokens("text", True).alias("n_tokens"))


@query("""select conv_id, turn, sha256('{"generated": ' || to_json(text) || ', "method_id": ' || to_json(role) || '}') as key from conversations""")
def record_keys(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", text.record_hash("text", "role").alias("key"))


@query()
def unified_identifiers(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.md5(text.unify_identifiers("html")).alias("unified"), F.md5(text.strip_identifiers("html")).alias("stripped"))


@query(r"""with w as (select distinct w as name from (select unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as w from benchmark))
select doc_id as text_id, name from documents join w on contains(text, name)""")
def theta_contains_join(spark, sf):
    names = t(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))).alias("name")).distinct()
    return dataset.contains_join(t(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text"), names, "text", "name")


# Filters, slices, lookups ------------------------------------------------------------------------

_CASCADE = "case when lang in ('fr', 'de') then 'category' when n_chars < 1000 then 'statements' when quality is null then 'no_label' when quality <> 1 then 'low_quality' when coalesce(toxic, 0) = 1 then 'toxic' end"


def _cascade(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(t(spark, sf, "labels"), "doc_id", "left")
    c = F.col
    return dataset.cascade(rows, [("category", c("lang").isin("fr", "de")), ("statements", c("n_chars") < 1000), ("no_label", c("quality").isNull()), ("low_quality", c("quality") != 1), ("toxic", c("toxic") == 1)])


@query(f"select doc_id, lang, n_chars from documents left join labels using (doc_id) where {_CASCADE} is null")
def filter_cascade_survivors(spark, sf):
    return _cascade(spark, sf).filter("reject_reason is null").select("doc_id", "lang", "n_chars")


@query(f"select {_CASCADE} as reject_reason, count(*) as n from documents left join labels using (doc_id) where {_CASCADE} is not null group by all")
def filter_cascade_reasons(spark, sf):
    return dataset.reason_counts(_cascade(spark, sf))


@query("""with c as (select source, lang, bool_or(quality > 0) as cov, arg_min(quality / 2e0, doc_id) as ratio from labels join documents using (doc_id) group by all)
select doc_id, coalesce(cov, false) as is_covered, round(ratio, 6) as coverage_ratio from documents left join c using (source, lang)""")
def coverage_lookup(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", F.col("source").alias("classFqn"), F.col("lang").alias("methodName"), F.array(F.concat("lang", F.lit("<T>"))).alias("parameterTypes"))
    rows = t(spark, sf, "labels").join(docs, "doc_id").select(F.col("classFqn").alias("class_name"), F.col("methodName").alias("method_name"), F.array(F.concat("methodName", F.lit("<E>"))).alias("params"), F.col("quality").alias("covered_lines"), F.lit(2).alias("total_lines"), F.col("doc_id").alias("ord"))
    return dataset.join_coverage(docs, rows).select("doc_id", "is_covered", r6("coverage_ratio", "coverage_ratio"))


@query("select s_suppkey, count(*) as n, min(c_custkey) as first_line, max(c_custkey) as last_line from supplier join customer on c_nationkey = s_nationkey and c_custkey between s_suppkey * 5 and s_suppkey * 5 + 400 group by all")
def line_range_join(spark, sf):
    spans = t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_suppkey") * 5).alias("lo"), (F.col("s_suppkey") * 5 + 400).alias("hi"))
    points = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("at"))
    return dataset.range_join(spans, points, "k", "lo", "hi", "at", 256).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("at").alias("first_line"), F.max("at").alias("last_line"))


_SLICES = "select case when e = 0 then 'no_invocations' when p / e > 0.7 then 'project' when p / e < 0.3 then 'standard' else 'mixed' end as api_type, case when e <= 3 then 'simple' when e <= 10 then 'moderate' else 'complex' end as complexity, e, n_chars from (select n_chars, cast(floor(n_chars / 300) as int) as e, cast(floor(n_chars / 900) + floor((n_chars % 700) / 300) as int) as p from documents)"


@query(f"with s as ({_SLICES}), u as (select api_type as slice, e, n_chars from s union all select complexity, e, n_chars from s union all select 'all', e, n_chars from s) select slice, count(*) as n, round(avg(e), 6) as avg_invocations, round(avg(n_chars), 6) as avg_statements from u group by all")
def slice_stats(spark, sf):
    docs = t(spark, sf, "documents").select("n_chars", F.floor(F.col("n_chars") / 300).cast("int").alias("e"), (F.floor(F.col("n_chars") / 900) + F.floor((F.col("n_chars") % 700) / 300)).cast("int").alias("p"))
    return dataset.slice_stats(dataset.slices(docs, "e", "p", "e"), "e", "n_chars").select("slice", "n", r6("avg_invocations", "avg_invocations"), r6("avg_statements", "avg_statements"))


@query()
def seeded_sample(spark, sf):
    return dataset.seeded_sample(t(spark, sf, "documents").select("doc_id", "lang", "source"), ["doc_id"], 100, 42)


@query("select user_id, arg_max(event_type, event_id) as last_type, arg_min(event_type, event_id) as first_type from events group by all")
def first_and_last_lookup(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", "event_type")
    last, first = dataset.last_by(e, "user_id", "event_id"), dataset.first_by(e, "user_id", "event_id")
    return last.select("user_id", F.col("event_type").alias("last_type")).join(first.select("user_id", F.col("event_type").alias("first_type")), "user_id")


# Statistics by mode ------------------------------------------------------------------------------

_LONG = "l as (select event_type, 'value' as metric, value as v from events union all select event_type, 'k', cast(json_extract_string(props, '$.k') as double) from events), st as (select event_type, metric, count(v) as n, avg(v) as m, median(v) as md, coalesce(stddev_samp(v), 0) as s from l group by all)"


def _samples(spark, sf):
    return t(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query(f"with {_LONG} select event_type, metric, n, round(m, 6) as mean, round(md, 6) as median, round(s, 6) as std from st")
def aggregate_by_mode(spark, sf):
    return analysis.long_stats(_samples(spark, sf), "event_type", ["value", "k"]).select("event_type", "metric", "n", r6("v_mean", "mean"), r6("v_median", "median"), r6("v_std", "std"))


_MODES = ("click", "error", "purchase", "signup", "view")


@query(f"with {_LONG} select metric, " + ", ".join(f"max(case when event_type = '{m}' then printf('%.4f (std=%.4f)', m, s) end) as {m}" for m in _MODES) + " from st group by all")
def comparison_pivot(spark, sf):
    stats = analysis.long_stats(_samples(spark, sf), "event_type", ["value", "k"])
    return analysis.comparison(stats, "event_type", _MODES)


@query(f"with {_LONG} select metric, event_type, round(m, 6) as mean from (select *, row_number() over (partition by metric order by m desc, event_type) as place from st) where place = 1")
def best_mode(spark, sf):
    stats = analysis.long_stats(_samples(spark, sf), "event_type", ["value", "k"])
    return analysis.best_mode(stats, "event_type", F.col("event_type")).select("metric", "event_type", r6("v_mean", "mean"))


_PAIRS = "s as (select user_id, event_type, avg(value) / 100e0 as es, avg(cast(json_extract_string(props, '$.k') as double)) / 100e0 as recall from events group by all), p as (select user_id, a.es as base_es, b.es as other_es, b.es - a.es as delta_es, b.recall - a.recall as delta_recall, b.recall as other_recall from s a join s b using (user_id) where a.event_type = 'view' and b.event_type = 'purchase')"


def _pairs(spark, sf):
    s = _samples(spark, sf).groupBy("user_id", "event_type").agg((analysis.steady_mean(F.col("value")) / 100).alias("es"), (F.avg("k") / 100).alias("recall"))
    return analysis.pair_modes(s, "event_type", ["user_id"], "view", "purchase", ["es", "recall"])


@query(f"with {_PAIRS} select user_id, round(base_es, 6) as base_es, round(other_es, 6) as other_es, round(delta_es, 6) as delta_es from p")
def paired_deltas(spark, sf):
    return _pairs(spark, sf).select("user_id", r6("base_es", "base_es"), r6("other_es", "other_es"), r6("delta_es", "delta_es"))


@query(f"with {_PAIRS}, l as (select 'delta_es' as metric, delta_es as d from p union all select 'delta_recall', delta_recall from p) select metric, case when d is null then 'unknown' when d > 0.02e0 then 'helped' when d < -0.02e0 then 'hurt' else 'neutral' end as category, count(*) as n, round(avg(d), 6) as mean_delta from l group by all")
def helped_hurt(spark, sf):
    return analysis.helped_counts(_pairs(spark, sf), ["delta_es", "delta_recall"]).select("metric", "category", "n", r6("mean_delta", "mean_delta"))


@query(f"with {_PAIRS} select 'other_recall' as metric, count(*) as n, round(coalesce(corr(other_recall, delta_es), 0), 6) as r from p")
def pearson(spark, sf):
    return analysis.correlations(_pairs(spark, sf), ["other_recall"], "delta_es").select("metric", "n", r6("r", "r"))


@query(f"with {_PAIRS} select case when other_recall = 0 then 'zero' when other_recall < 0.3e0 then 'low' when other_recall < 0.6e0 then 'mid' else 'high' end as bucket, count(*) as n, round(avg(delta_es), 6) as mean_delta from p group by all")
def delta_buckets(spark, sf):
    return _pairs(spark, sf).groupBy(analysis.recall_bucket(F.col("other_recall")).alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("delta_es"), "mean_delta"))


@query(f"with {_PAIRS} select user_id, side from (select user_id, 'helped' as side, row_number() over (order by delta_es desc, user_id) as n from p union all select user_id, 'hurt', row_number() over (order by delta_es, user_id desc) from p) where n <= 5")
def extreme_deltas(spark, sf):
    return analysis.extremes(_pairs(spark, sf), "delta_es", "user_id").select("user_id", "side")


@query("""with s as (select user_id, event_type, count(*) as n, max(value) > 90 as hot from events group by all), f as (select *, first_value(n) over (partition by user_id order by event_type) as n0, first_value(hot) over (partition by user_id order by event_type) as h0, count(*) over (partition by user_id) as modes from s)
select user_id, event_type, 'n' as field from f where modes > 1 and n <> n0 union all select user_id, event_type, 'hot' from f where modes > 1 and hot <> h0""")
def cross_mode_validate(spark, sf):
    s = _samples(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), (F.max("value") > 90).alias("hot"))
    return analysis.cross_mode_issues(s, "user_id", "event_type", ["n", "hot"])


@query("select user_id, bool_or(value > 90) as any_hot, bool_and(value > 1) as every_some from events group by all")
def any_and_every(spark, sf):
    return analysis.any_every(t(spark, sf, "events").select("user_id", (F.col("value") > 90).alias("hot"), (F.col("value") > 1).alias("some")), "user_id", ["hot"], ["some"])


@query("select a.conv_id, a.turn as m1, b.turn as m2 from conversations a join conversations b on a.conv_id = b.conv_id and a.turn < b.turn and a.text is distinct from b.text")
def mode_diffs(spark, sf):
    return analysis.mode_diffs(t(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "m1", "m2")


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from events group by all")
def stream_stats(spark, sf):
    schema = t(spark, sf, "events").schema
    rows = progress.stream_table(spark, sf, schema, "events.parquet")
    target = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    progress.write_stats(progress.running_stats(rows, "event_type", "value"), f"{target}/table", f"{target}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{target}/table").select("event_type", "n", r6("mean", "mean"), r6("std", "std"))


# N-grams -----------------------------------------------------------------------------------------


@query("""with s as (select user_id, event_type as a, lead(event_type, 1) over w as b, lead(event_type, 2) over w as c from events window w as (partition by user_id order by ts, event_id))
select 'bigram' as kind, a || ' -> ' || b as gram, count(*) as n from s where b is not null group by all union all select 'trigram', a || ' -> ' || b || ' -> ' || c, count(*) from s where c is not null group by all""")
def bigrams_trigrams(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = t(spark, sf, "events").select(F.col("event_type").alias("a"), F.lead("event_type", 1).over(w).alias("b"), F.lead("event_type", 2).over(w).alias("c"))
    grams = F.array(F.when(F.col("b").isNotNull(), F.struct(F.lit("bigram").alias("kind"), F.concat_ws(" -> ", "a", "b").alias("gram"))), F.when(F.col("c").isNotNull(), F.struct(F.lit("trigram").alias("kind"), F.concat_ws(" -> ", "a", "b", "c").alias("gram"))))
    return s.select(F.explode(grams).alias("g")).filter("g is not null").groupBy("g.kind", "g.gram").agg(F.count("*").alias("n"))


# Failures ----------------------------------------------------------------------------------------

_FAILED = "f as (select l_orderkey, count(*) as lines, list('pkg.Order' || l_suppkey || 'Test.test' || l_partkey order by l_linenumber, l_partkey, l_suppkey) filter (where l_returnflag = 'R') as failed from lineitem group by all)"
_REASON = """case when compilable is distinct from true then 'not_compilable_or_unchecked' when em is distinct from false then 'exact_match_or_unchecked' when lines is null then 'missing_test_eval'
 when len(coalesce(failed, [])) = 0 then 'tests_passed' when o_totalprice <= 2000 then 'test_build_failed' when dup > 1 then 'duplicate' end"""
_MINE = f"{_FAILED}, s as (select o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_orderstatus <> 'P' as compilable, o_orderpriority = '1-URGENT' as em, lines, failed from orders left join f on o_orderkey = l_orderkey), r as (select *, case when compilable and not em and lines is not null and len(coalesce(failed, [])) > 0 and o_totalprice > 2000 then row_number() over (partition by o_custkey, o_orderpriority, (compilable and not em and lines is not null and len(coalesce(failed, [])) > 0 and o_totalprice > 2000) order by o_orderkey) end as dup from s)"


def _verdicts(spark, sf):
    name = F.concat(F.lit("pkg.Order"), F.col("l_suppkey").cast("string"), F.lit("Test.test"), F.col("l_partkey").cast("string"))
    failed = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("int").alias("lines"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct("l_linenumber", "l_partkey", "l_suppkey", name.alias("name"))))).alias("fs"))
    rows = t(spark, sf, "orders").join(failed, "o_orderkey", "left")
    names = F.transform("fs", lambda x: x["name"])
    verdict = F.when(F.col("lines").isNotNull(), F.struct((F.size("fs") == 0).alias("success"), F.col("lines").alias("tests_run"), F.size("fs").alias("tests_failed"), names.alias("failed_test_names"), (F.col("o_totalprice") > 2000).alias("build_success")))
    return rows.select(
        "o_orderkey", F.concat(F.lit("pkg.Order"), (F.col("o_custkey") % 100).cast("string"), F.lit("#test1")).alias("method_id"), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("generated"), F.lit("m").alias("mode"),
        F.struct((F.col("o_orderstatus") != "P").alias("compilable"), (F.col("o_orderpriority") == "1-URGENT").alias("em"), (F.col("o_totalprice") / 1e6).alias("es")).alias("metrics"), verdict.alias("test_eval"), F.lit(None).cast("double").alias("coverage_ratio"),
    )


@query(f"""with {_MINE} select o_orderkey, cast(len(list_filter(failed, lambda x: split_part(x, '.', 2) = 'Order' || (o_custkey % 100) || 'Test' or contains(lower(x), 'test1'))) as int) as n_related,
 cast(coalesce(list_max(list_transform(failed, lambda x: case when split_part(x, '.', 2) = 'Order' || (o_custkey % 100) || 'Test' then 1 else 0 end + case when contains(lower(x), 'test1') then 1 else 0 end)), 0) as int) as relation_score, cast(len(failed) as int) as tests_failed from r where {_REASON} is null""")
def mine_failures(spark, sf):
    kept, _ = mining.mine_failures(_verdicts(spark, sf), "o_orderkey", dedupe="generated")
    return kept.select("o_orderkey", F.size("related").alias("n_related"), "relation_score", F.col("test_eval.tests_failed").alias("tests_failed"))


@query(f"with {_MINE} select {_REASON} as reason, count(*) as n from r where {_REASON} is not null group by all")
def mine_rejections(spark, sf):
    return mining.mine_failures(_verdicts(spark, sf), "o_orderkey", dedupe="generated")[1]


_RELATED = """cast(len(list_filter(failed, lambda x: split_part(x, '.', 2) = 'Order' || (o_custkey % 100) || 'Test' or contains(lower(x), 'test1'))) as int) as n_related,
 coalesce(list_max(list_transform(failed, lambda x: case when split_part(x, '.', 2) = 'Order' || (o_custkey % 100) || 'Test' then 1 else 0 end + case when contains(lower(x), 'test1') then 1 else 0 end)), 0) as relation_score, len(failed) as tests_failed"""


@query(f"with {_MINE}, k as (select *, {_RELATED} from r where {_REASON} is null) select o_orderkey, row_number() over (order by relation_score desc, n_related desc, tests_failed desc, o_totalprice desc, o_orderkey) as place from k")
def failure_ranking(spark, sf):
    kept, _ = mining.mine_failures(_verdicts(spark, sf), "o_orderkey", dedupe="generated")
    return mining.ranked(kept, "o_orderkey").select("o_orderkey", "place")


@query(f"""with {_MINE}, k as (select *, {_RELATED}, 'pkg.Order' || o_custkey % 100 as class_fqn, sha256('{{"generated": "' || o_custkey || '|' || o_orderpriority || '", "method_id": "pkg.Order' || o_custkey % 100 || '#test1"}}') as candidate_hash from r where {_REASON} is null)
select 'm:sample_' || lpad(cast(o_orderkey % 5000 as varchar), cast(greatest(3, length(cast(o_orderkey % 5000 as varchar))) as int), '0') || ':' || candidate_hash[:12] as candidate_id, candidate_hash, class_fqn, 'test1' as method_name, cast(relation_score as int) as relation_score, cast(tests_failed as int) as tests_failed, cast(lines as int) as tests_run, o_orderkey % 3 = 0 as has_retrieval from k""")
def failure_records(spark, sf):
    rows = _verdicts(spark, sf).withColumns({"sample_index": (F.col("o_orderkey") % 5000).cast("int"), "retrieval_query": F.when(F.col("o_orderkey") % 3 == 0, "q")})
    made = mining.record(mining.mine_failures(rows, "o_orderkey", dedupe="generated")[0])
    return made.select("candidate_id", "candidate_hash", "method.class_fqn", "method.method_name", "verdict.relation_score", "verdict.tests_failed", "verdict.tests_run", F.col("retrieval").isNotNull().alias("has_retrieval"))


@query(f"""with {_MINE}, k as (select {_REASON} as reason, {_RELATED} from r), c as (select reason, count(*) as n from k where reason is not null group by all)
select count(*) as total_samples_seen, count(*) filter (where reason is null) as candidate_count, count(*) filter (where reason is null and relation_score > 0) as related_candidate_count, (select string_agg(reason || '=' || n, ';' order by reason) from c) as rejected from k""")
def failure_summary(spark, sf):
    made = mining.summary(*mining.mine_failures(_verdicts(spark, sf), "o_orderkey", dedupe="generated"))
    shown = F.transform(F.array_sort(F.map_entries("rejected")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return made.select("total_samples_seen", "candidate_count", "related_candidate_count", F.array_join(shown, ";").alias("rejected"))


# Graphs ------------------------------------------------------------------------------------------

_EDGES = "e as (select c_nationkey as src, s_nationkey as dst, count(*) as weight from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all)"
_DEG = f"{_EDGES}, d as (select n_nationkey as vertex_id, coalesce((select sum(weight) from e where src = n_nationkey), 0) as o, coalesce((select sum(weight) from e where dst = n_nationkey), 0) as i from nation)"


def _graph(spark, sf):
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = lines.join(t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("vertex_id")), ends.groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query(f"with {_EDGES} select * from e")
def graph_edges(spark, sf):
    return _graph(spark, sf)[1]


@query(f"with {_DEG} select vertex_id, cast(o as bigint) as out_degree, cast(i as bigint) as in_degree, cast(o + i as bigint) as total_degree from d")
def graph_degrees(spark, sf):
    return graph.degrees(*_graph(spark, sf))


@query(f"with {_DEG} select (select count(*) from nation) as n_vertices, (select count(*) from d where o + i = 0) as n_isolated, count(*) as n_edges, cast(sum(weight) as bigint) as total_weight, count(*) filter (where src = dst) as n_self_loops, round(count(*) / ((select count(*) from nation) ** 2), 6) as density from e")
def graph_stats(spark, sf):
    v, e = _graph(spark, sf)
    return graph.stats(graph.degrees(v, e), e).withColumn("density", F.round("density", 6))


@query(f"with {_DEG} select vertex_id, cast(o as bigint) as out_degree from d where o > 0 order by o desc, vertex_id limit 10")
def graph_top(spark, sf):
    return graph.top(graph.degrees(*_graph(spark, sf)), "out_degree").select("vertex_id", "out_degree")


@query(f"with {_EDGES} select weight, count(*) as n from e group by all")
def graph_weight_counts(spark, sf):
    return graph.weight_counts(_graph(spark, sf)[1])


@query(f"with {_EDGES}, b as (select min(weight) as lo, max(weight) as hi from e) select cast(case when hi = lo then 0 else least(floor((weight - lo) / (hi - lo) * 10), 9) end as int) as bucket, count(*) as n from e, b group by all")
def graph_histogram(spark, sf):
    return graph.histogram(_graph(spark, sf)[1], "weight").select("bucket", "n")


@query("select unnest(['ends_known', 'weights_positive', 'pairs_unique', 'ids_unique', 'weights_integer']) as check_name, true as ok")
def graph_checks(spark, sf):
    return graph.sanity(*_graph(spark, sf))


@query(f"with {_EDGES} select src as vertex_id, dst as other, weight, cast(row_number() over (partition by src order by weight desc, dst) as int) as nth from e")
def graph_incident(spark, sf):
    return graph.incident(_graph(spark, sf)[1])


@query(f"with {_EDGES} select src, dst, round(ln(1e0 + weight) / ln(1e0 + max(weight) over ()), 6) as scaled from e")
def graph_scaled_weights(spark, sf):
    e = _graph(spark, sf)[1]
    return e.join(F.broadcast(e.agg(F.max("weight").alias("top")))).select("src", "dst", r6(text.scaled_weight("weight", "top"), "scaled"))  # top is one row


@query("""with u as (select 0 as o, c_custkey as k, 'n' || c_nationkey as class, c_mktsegment as name from customer union all select 1, s_suppkey, 'n' || s_nationkey, 'BUILDING' from supplier),
f as (select class || '::' || name || '() -> void' as vertex_id, arg_min(k, (o, k)) as first_key from u group by all) select vertex_id, first_key, row_number() over (order by vertex_id) - 1 as idx from f""")
def vertex_flatten(spark, sf):
    c = t(spark, sf, "customer").select(F.lit(0).alias("o"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("name"))
    s = t(spark, sf, "supplier").select(F.lit(1).alias("o"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.lit("BUILDING").alias("name"))
    vid = text.vertex_id(F.concat(F.lit("n"), F.col("n").cast("string")), "name", F.array().cast("array<string>"), F.lit(None).cast("string"))
    first = c.unionByName(s).groupBy(vid.alias("vertex_id")).agg(F.min_by("k", F.struct("o", "k")).alias("first_key"))
    return dataset.row_numbers(first, ["vertex_id"], "idx")


# Prompts -----------------------------------------------------------------------------------------


@query()
def prompt_assembly(spark, sf):
    head = F.concat(F.lit("package p;\nimport a.B;\nimport a.*;\nclass C {\n  private B b;\n  C() { }\n  void m() {"))
    body = F.regexp_replace("text", "[{}]", "")
    content = F.concat(head, body, F.lit("}\n  void n() { }\n}\n"))
    call = F.array(F.struct(F.lit("a.B::n()").alias("signature"), F.lit("EXACT").alias("resolutionMode"), F.lit(0).alias("orderIndex")))
    rows = t(spark, sf, "documents").select("doc_id", content.alias("fileContent"), (F.length(head) - 1).alias("bodyStartOffset"), (F.length(head) + F.length(body) + 1).alias("bodyEndOffset"), F.lit("p.C").alias("classFqn"), call.alias("invocations"), F.array(F.lit("a.B")).alias("usedTypes"))
    made = prompt.prompts(rows, "doc_id", "ordered_augmentation", budget=512)
    return made.select("doc_id", F.length("prefix").alias("n_prefix"), F.length("suffix").alias("n_suffix"), F.length("ground_truth").alias("n_truth"), text.count_tokens("full_prompt").alias("n_tokens"), "error")
