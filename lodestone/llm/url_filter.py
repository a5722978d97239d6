"""URL filtering by rules and by a tree of path templates per host, in native expressions only.

Rules decide first: a rule fits its host and all subdomains where the path starts with the
rule's, and the longest rule wins. Their verdicts (or given labels) also teach the method.
All urls are first counted by host and path with digits as ``#``, in the mappers, so a host
with a third of all rows is a few counts. The tree is then grown from the root, level by
level; what is generalised at one level is one branch at the next.

1. *Generalise*: of a node's children, if there are ``branches`` or more, those with less than
   a part in ``branches`` of its urls become the wildcard ``*`` and are one branch from there
   on. So a node has ``branches`` named children at most.
2. *Merge*: the named children, the most frequent first, each join the first statistically
   similar branch (shown as ``{de,fr}``), or become one. Similar is a child if what follows it
   is distributed as in the branch (total variation of the next segments, in ``BINS`` bins,
   within the bound that holds for all events at once), and if its share of blocked urls,
   where both sides have labels, differs by Hoeffding's bound at most.
3. *Reject*: the purity of a node is its share of blocked urls among its labelled ones,
   smoothed by ``strength`` urls of its parent's purity; the host's is smoothed by the rest of
   its domain, and that by the whole corpus. A template (the end of a path is a child too) is
   blocked if its purity reaches ``purity`` and it, or the nearest branch above that has so
   many, has ``support`` labelled urls. A branch without labels so takes its siblings' where
   it is merged with them, and else its parent's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import cut, fresh

#: Fixed values: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Bins of the next segments' distribution.
BINS = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: on up to ``?``, ``#`` or the end."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def generalised(path: Column, depth: int) -> Column:
    """Segments of a path with digits as ``#`` and an empty one as its end; what lies deeper than ``depth`` is one ``**``."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "#"), "/", depth + 1)
    parts = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)
    return F.concat(F.transform(parts, lambda x: F.when(x == "", "~").otherwise(x)), F.array(F.lit("")))


def _hosts(counted: DataFrame, strength: float) -> DataFrame:
    """(host, pure, held): the purity and the labelled urls of each host."""
    hosts = counted.groupBy("host").agg(F.sum("l").alias("l"), F.sum("b").alias("b")).withColumn("domain", F.substring_index("host", ".", -2))
    domains = hosts.groupBy("domain").agg(F.sum("l").alias("dl"), F.sum("b").alias("db"))
    base = counted.agg(F.coalesce(F.try_divide(F.sum("b"), F.sum("l")), F.lit(0.5)).alias("base")).first()["base"]
    prior = (F.col("db") - F.col("b") + strength * base) / (F.col("dl") - F.col("l") + strength)
    return hosts.join(domains, "domain").select("host", ((F.col("b") + strength * prior) / (F.col("l") + strength)).alias("pure"), F.col("l").alias("held"))


def _similar(alpha: float) -> str:
    """Whether a child ``k`` is distributed like the branch ``t``."""
    bound = f"sqrt(0.5 * (size(filter(zip_with(k.h, t.h, (x, y) -> x + y), x -> x > 0)) * ln(2D) + {math.log(2 / alpha)!r}D)) * (1 / sqrt(k.n) + 1 / sqrt(t.n))"
    apart = "aggregate(zip_with(k.h, t.h, (x, y) -> greatest(0D, x / k.n - y / t.n)), 0D, (a, x) -> a + x)"
    labels = f"abs(k.b / k.l - t.b / t.l) <= {math.sqrt(0.5 * math.log(2 / alpha))!r}D * (1 / sqrt(k.l) + 1 / sqrt(t.l))"
    return f"({apart} <= {bound} and (k.l = 0 or t.l = 0 or {labels}))"


def _branches(alpha: float) -> str:
    """Named children by falling count, each merged into the first (largest) similar branch so far, or a branch of its own."""
    fields = "names array<string>, n bigint, l bigint, b bigint, h array<bigint>"
    first = f"get(filter(sequence(0, size(g)), i -> i < size(g) and exists(slice(g, i + 1, 1), t -> {_similar(alpha)})), 0)"
    joined = "named_struct('names', concat(t.names, array(k.name)), 'n', t.n + k.n, 'l', t.l + k.l, 'b', t.b + k.b, 'h', zip_with(t.h, k.h, (x, y) -> x + y))"
    own = "array(named_struct('names', array(k.name), 'n', k.n, 'l', k.l, 'b', k.b, 'h', k.h))"
    placed = f"transform(array({first}), at -> if(at is null, concat(g, {own}), transform(g, (t, i) -> if(i = at, {joined}, t))))[0]"
    ranked = "array_sort(filter(kids, k -> k.name not in ('', '*')), (x, y) -> case when x.n <> y.n then cast(sign(y.n - x.n) AS int) when x.name < y.name then -1 when x.name > y.name then 1 else 0 end)"
    return f"aggregate({ranked}, cast(array() AS array<struct<{fields}>>), (g, k) -> {placed})"


def _level(live: DataFrame, at: int, branches: int, alpha: float, strength: float, support: int) -> DataFrame:
    """``live`` (host, node, shape, n, l, b, pure, held) with its nodes one level further down."""
    segment, following = F.get("shape", at), F.get("shape", at + 1)
    bin_ = F.pmod(F.xxhash64(F.coalesce(following, F.lit(""))), F.lit(BINS))
    counts = [F.sum(x).alias(x) for x in ("n", "l", "b")]
    bins = [F.sum(F.when(bin_ == i, F.col("n")).otherwise(0)).alias(f"h{i}") for i in range(BINS)]
    kids = live.withColumn("name", segment).groupBy("host", "node", "name").agg(*counts, *bins, F.max("pure").alias("pure"), F.max("held").alias("held"))
    per = kids.filter("name <> ''").groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"))
    rare = (F.col("name") != "") & (F.col("kinds") >= branches) & (F.col("n") * branches < F.col("all"))
    named = kids.join(per, ["host", "node"], "left").withColumn("name", F.when(rare, F.lit("*")).otherwise(F.col("name")))
    one = named.groupBy("host", "node", "name").agg(*counts, *(F.sum(f"h{i}").alias(f"h{i}") for i in range(BINS)), F.max("pure").alias("pure"), F.max("held").alias("held"))
    kid = F.struct("name", "n", "l", "b", F.array(*(f"h{i}" for i in range(BINS))).alias("h"))
    nodes = one.groupBy("host", "node").agg(F.collect_list(kid).alias("kids"), F.max("pure").alias("prior"), F.max("held").alias("above"))  # branches + 2 kids at most
    nodes = nodes.withColumn("found", F.expr(_branches(alpha)))
    shown = "if(size(t.names) > 1, concat('{', array_join(array_sort(t.names), ','), '}'), k.name)"
    child = f"""transform(kids, k -> transform(array(coalesce(get(filter(found, f -> array_contains(f.names, k.name)), 0), named_struct('names', array(k.name), 'n', k.n, 'l', k.l, 'b', k.b, 'h', k.h))),
        t -> named_struct('name', k.name, 'shown', {shown}, 'pure', (t.b + {strength!r}D * prior) / (t.l + {strength!r}D), 'held', if(t.l >= {support}, t.l, above)))[0])"""
    nodes = nodes.select("host", "node", F.expr(child).alias("kids"))
    # A segment that is no named child is in the wildcard.
    met = live.drop("pure", "held").join(nodes, ["host", "node"]).withColumn("kid", F.expr(f"coalesce(get(filter(kids, k -> k.name = shape[{at}]), 0), get(filter(kids, k -> k.name = '*'), 0))"))
    return met.select("host", F.concat_ws("/", F.when(F.col("node") != "", F.col("node")), F.col("kid.shown")).alias("node"), "shape", "n", "l", "b", F.col("kid.pure").alias("pure"), F.col("kid.held").alias("held"))


def templates(counted: DataFrame, branches: int, alpha: float, strength: float, purity: float, support: int) -> DataFrame:
    """(host, shape, template, purity, rejected) of counted shapes (host, shape, n, l, b)."""
    counted = cut(counted)
    live = counted.join(_hosts(counted, strength), "host").withColumn("node", F.lit(""))
    deepest = counted.agg(F.max(F.size("shape")).alias("d")).first()["d"] or 0
    done = None
    for at in range(deepest):
        live = cut(_level(live, at, branches, alpha, strength, support))
        ended = live.filter(F.size("shape") == at + 1)
        done = ended if done is None else done.unionByName(ended)
        live = live.filter(F.size("shape") > at + 1)
    done = live if done is None else done
    return done.select("host", "shape", F.regexp_replace("node", "/$", "").alias("template"), F.col("pure").alias("purity"), ((F.col("pure") >= purity) & (F.col("held") >= support)).alias("rejected"))


def url_filter(pages: DataFrame, url: str = "url", label: str | None = None, rules=RULES, branches: int = 12, depth: int = 16, alpha: float = 0.05, strength: float = 4.0, purity: float = 0.8, support: int = 5) -> DataFrame:
    """All rows of ``pages`` plus ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity``.

    ``label``: a column of blocked (1) and allowed (0) urls to learn from, null where
    unknown; by default what the rules decide. Null urls and urls without ``://`` have an
    empty host and path. Repeated rows count as often as they occur. Columns with the names
    of the results are replaced (``label`` may be one of them), all others stay. An empty
    table gives an empty result. ``template`` and ``purity`` are null where a rule decides.

    The rows' join with their templates is an ordinary one, so that adaptive execution
    splits a template with very many rows."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "template", "purity")]
    ruled, known, shape, reject = (fresh(pages, x) for x in ("__ruled", "__known", "__shape", "__rejected"))
    host, path = host_and_path(url)
    given = F.col(label).cast("int") if label else F.lit(None).cast("int")
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), host.alias("host"), path.alias("path"), given.alias(known))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, ruled: verdict, shape: generalised(F.col("path"), depth)})
    if not label:
        rows = rows.withColumn(known, F.when(F.col(ruled) == "block", 1).when(F.col(ruled) == "allow", 0))
    counted = rows.groupBy("host", F.col(shape).alias("shape")).agg(F.count("*").alias("n"), F.count(known).alias("l"), F.coalesce(F.sum(known), F.lit(0)).alias("b"))
    found = templates(counted, branches, alpha, strength, purity, support).select("host", F.col("shape").alias(shape), "template", "purity", F.col("rejected").alias(reject))
    decided = rows.filter("rule is not null").withColumns({"template": F.lit(None).cast("string"), "purity": F.lit(None).cast("double"), "verdict": F.col(ruled)})
    free = rows.filter("rule is null").join(found, ["host", shape], "left").withColumn("verdict", F.when(F.coalesce(reject, F.lit(False)), "block").otherwise("allow"))
    columns = [*(f"`{c}`" for c in kept), "host", "path", "rule", "verdict", "template", "purity"]
    return decided.select(*columns).unionByName(free.select(*columns))
