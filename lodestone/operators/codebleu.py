"""CodeBLEU of pairs of Java texts: n-grams, n-grams with keywords weighed up, subtrees and data flow, a quarter each.

Subtrees are those of the token tree of ``operators.syntax``: each bracket with what it holds, and each segment of a block,
with names and literals as their kind. Data flow: for each variable, in order of first use numbered, how many definitions
stand before a use. No value hangs on what names and literals are, only on which are equal: pairs that agree in this are
scored once, and texts that agree in it have one tree. Trees and flows come from windows over all such texts at once; a row
then holds one pair's arrays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.metrics import common_sorted
from lodestone.functions.text import KEYWORDS, LITERALS, let
from lodestone.operators import syntax
from lodestone.operators.syntax import PRIMITIVES, is_name, is_one_of, variable
from lodestone.session import shared_folder, stored

#: Weight of a word that is no keyword, and what stands for a count of zero.
OTHER, EPSILON, ORDER = 0.2, 0.1, 4
ASSIGNS = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=")


def _grams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), "\x01"))).otherwise(F.array().cast("array<string>"))


def _common(a: Column, b: Column) -> Column:
    return common_sorted(F.sort_array(a), F.sort_array(b))


def _bleu(first: Column, first_of: Column, a: Column, b: Column) -> Column:
    """Brevity penalty times the geometric mean of clipped precisions, the one of single tokens given as (matched, all); 0 without a match."""
    precision = lambda hit, of: F.when(hit == 0, EPSILON).otherwise(hit) / F.greatest(of, F.lit(1))
    logs = F.log(first / F.greatest(first_of, F.lit(1e-12)))
    for n in range(2, ORDER + 1):
        x, y = _grams(a, n), _grams(b, n)
        logs = logs + F.log(precision(_common(x, y), F.size(x)))
    short = F.when(F.size(a) > F.size(b), 1.0).otherwise(F.exp(1 - F.size(b) / F.greatest(F.size(a), F.lit(1))))
    return F.when(first > 0, short * F.exp(logs / ORDER)).otherwise(0.0)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (k, g, r) with texts told (``syntax.told_tokens``), names and literals of a pair by one numbering; a few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part, told = batch.slice(start, 256), []
            for g, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                names, literals = {}, {}
                told.append((None, None) if g is None or r is None else (syntax.told_tokens(g, names, literals), syntax.told_tokens(r, names, literals)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.string()) for x in zip(*told, strict=True))], ["k", "g", "r"])


def _tokens(kinds: str) -> Column:
    return F.when(F.col(kinds) != "", F.split(kinds, "\x01")).otherwise(F.array().cast("array<string>"))


def _own(tokens: Column) -> Column:
    """Told tokens with names numbered by this text alone and literals as ``0``, as one string."""
    name = lambda t: t.rlike("^x[0-9]+_$")
    renamed = lambda v: F.transform(v["t"], lambda t: F.when(name(t), F.concat(F.lit("x"), F.array_position(v["names"], t).cast("string"), F.lit("_"))).when(t.rlike("^0[0-9]+_$"), "0").otherwise(t))
    return F.array_join(let(F.struct(tokens.alias("t"), F.array_distinct(F.filter(tokens, name)).alias("names")), renamed), "\x01")


def _met(rows: DataFrame, facts: DataFrame, on: str, crowd: int) -> DataFrame:
    """Rows with the facts of their ``on``; ``n`` of facts is the number of their rows. Facts of more than ``crowd`` rows are broadcast, others meet their rows by a shuffle."""
    # Sizes are guessed from files, and texts that are alike take little there: unless told, all rows may be broadcast.
    often, seldom = F.broadcast(facts.filter(F.col("n") > crowd).drop("n")), facts.filter(F.col("n") <= crowd).drop("n")
    return rows.join(often, on).unionByName(rows.join(often.select(on), on, "left_anti").join(seldom.hint("merge"), on))


def _facts(tokens: DataFrame) -> DataFrame:
    """(file, shapes, flows) of the tokens (file, i, at, token) of texts."""
    tree = syntax._tree(tokens)
    literal = F.col("token").rlike(r"^[\"'0-9]|^\.[0-9]") | F.col("token").isin(*LITERALS)
    kinds = F.when(literal, "0").when(is_name("token"), "x").otherwise(F.col("token"))
    typed = is_name("prev") | is_one_of("prev", "]", *PRIMITIVES) | F.col("prev_typed")
    sets = is_one_of("next", *ASSIGNS, "++", "--") | is_one_of("prev", "++", "--") | typed
    named = Window.partitionBy("file", "token").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = tree.withColumns({"kind_": kinds, "variable": variable(), "sets": sets}).withColumn("before", F.coalesce(F.sum(F.when(F.col("variable") & F.col("sets"), 1)).over(named), F.lit(0)))
    grouped = F.col("up").isNull() | (F.col("up.token") == "{")
    # A segment reaches to the farthest end of its tokens; its first one says where.
    segment = Window.partitionBy("file", "up.pos", "seg")
    rows = rows.withColumn("reach", F.when(grouped & (F.col("pos") == F.min("pos").over(segment)), F.max(F.coalesce("close", "pos")).over(segment)))
    slot = F.struct("pos", "token", "kind_", "close", F.when(F.col("variable"), F.struct("before", "sets")).alias("use"), "reach")
    whole = rows.groupBy("file").agg(F.array_sort(F.collect_list(slot)).alias("t"))  # the tokens of one text
    kinds = F.transform("t", lambda x: x["kind_"])
    spans = F.flatten(F.transform("t", lambda x: F.filter(F.array(F.struct(x["pos"].alias("a"), x["close"].alias("b")), F.struct(x["pos"].alias("a"), x["reach"].alias("b"))), lambda y: y["b"].isNotNull())))
    part = lambda kind, a, b: F.xxhash64(F.array_join(F.slice(kind, a + 1, b - a + 1), " "))
    shapes = let(F.struct(kinds.alias("kind"), spans.alias("spans")), lambda v: F.transform(v["spans"], lambda x: part(v["kind"], x["a"], x["b"])))
    uses = F.filter("t", lambda x: x["use"].isNotNull())
    flow = lambda x, names: F.concat_ws(":", F.array_position(names, x["token"]).cast("string"), x["use"]["before"].cast("string"), x["use"]["sets"].cast("string"))
    named = lambda uses: F.struct(uses.alias("uses"), F.array_distinct(F.transform(uses, lambda x: x["token"])).alias("names"))
    flows = let(let(uses, named), lambda v: F.transform(v["uses"], lambda x: flow(x, v["names"])))
    return whole.select("file", shapes.alias("shapes"), flows.alias("flows"))


def codebleu(pairs: DataFrame, key: str, generated: str = "generated", truth: str = "ground_truth", crowd: int = 1 << 10) -> DataFrame:
    """(key, ngram, weighted, syntax, dataflow, codebleu) of pairs with different keys; parts unrounded, the value rounded to six places.

    Null where a side is null or blank, or neither has a token. A side of comments alone has no tokens and scores 0 in what needs them. A true text without
    data flow counts as met. Rows with a null key are left out.

    Pairs that differ in which names and literals they have, in white space and in comments alone are scored once. What more than ``crowd``
    pairs share is broadcast (a ``crowd``-th of all pairs at most)."""
    some = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) != ""
    valid = lambda c: F.when(some(generated) & some(truth), F.make_valid_utf8(F.col(c)))
    keyed = pairs.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), valid(generated).alias("g"), valid(truth).alias("r"))
    told = keyed.mapInArrow(_told, T.StructType([keyed.schema["k"], T.StructField("g", T.StringType()), T.StructField("r", T.StringType())]))
    path = f"{shared_folder(pairs.sparkSession)}/pairs-{uuid.uuid4().hex}"
    told.withColumn("pair", F.when((F.col("g") != "") | (F.col("r") != ""), F.unhex(F.sha2(F.concat("g", F.lit("\x01\x01"), "r"), 256)))).write.parquet(path)
    rows = pairs.sparkSession.read.parquet(path).select("k", "pair", "g", "r")
    unlike = rows.filter("pair is not null").groupBy("pair", "g", "r").agg(F.count("*").alias("n")).select("pair", "n", _tokens("g").alias("g"), _tokens("r").alias("r"))
    side = lambda c: F.unhex(F.sha2(_own(F.col(c)), 256))
    unlike = stored(unlike.withColumns({"g_side": side("g"), "r_side": side("r")}))

    sides = unlike.select(F.explode(F.array(F.struct(F.col("g_side").alias("file"), F.col("g").alias("t")), F.struct(F.col("r_side").alias("file"), F.col("r").alias("t")))).alias("x")).select("x.file", _own(F.col("x.t")).alias("own"))
    sides = stored(sides.groupBy("file", "own").agg(F.count("*").alias("n")))
    facts = _facts(sides.select("file", F.posexplode(_tokens("own")).alias("i", "token")).withColumn("at", F.col("i")))
    known = F.coalesce("shapes", F.array().cast("array<bigint>")).alias("shapes"), F.coalesce("flows", F.array().cast("array<string>")).alias("flows")
    facts = stored(sides.select("file", "n").join(facts.hint("merge"), "file", "left").select("file", "n", *known))
    both = unlike
    for c in ("g", "r"):
        both = _met(both, facts.select(F.col("file").alias(f"{c}_side"), "n", F.col("shapes").alias(f"{c}_shapes"), F.col("flows").alias(f"{c}_flows")), f"{c}_side", crowd)

    a, b = F.col("g"), F.col("r")
    hit, kept = _common(a, b), lambda t: F.filter(t, lambda x: x.isin(*KEYWORDS))
    weighed = lambda all_, keywords: all_ * OTHER + keywords * (1 - OTHER)
    share = lambda c: F.when(F.size(f"r_{c}") > 0, _common(F.col(f"g_{c}"), F.col(f"r_{c}")) / F.size(f"r_{c}"))
    parts = both.select(
        "pair", "n", _bleu(hit.cast("double"), F.size(a).cast("double"), a, b).alias("ngram"), _bleu(weighed(hit, _common(kept(a), kept(b))), weighed(F.size(a), F.size(kept(a))), a, b).alias("weighted"),
        F.coalesce(share("shapes"), F.lit(0.0)).alias("syntax"), F.coalesce(share("flows"), F.lit(1.0)).alias("dataflow"),
    )
    names = ("ngram", "weighted", "syntax", "dataflow")
    valued = stored(parts.withColumn("codebleu", F.round(sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names), 6)))
    scored = _met(rows.select("k", "pair").filter("pair is not null"), valued, "pair", crowd)
    blank = rows.filter("pair is null").select("k", *(F.lit(None).cast("double").alias(n) for n in (*names, "codebleu")))
    return scored.select("k", *names, "codebleu").unionByName(blank).withColumnRenamed("k", key)
