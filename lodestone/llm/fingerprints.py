"""Document fingerprints by consistent weighted sampling, in native expressions only.

A text is a bag of words, each weighted by its count x. For sample k and a word, one hash of
both gives r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1); with t = floor(ln x / r + b) let
a = c / exp(r (t - b) + r). The sample is the word of least a together with its t. Two texts
agree on a sample with probability equal to their generalised Jaccard similarity (sum of
least counts over sum of greatest).

a depends on (k, word, t) alone, so its least value stands for the sample itself: a signature
is a plain minimum per sample, which Spark aggregates within the tasks, in generated code.

Most words cannot be the least: in a text of W words the least a is below 20 / W but once in
5e8, and a is at least c * q / x for q = exp(-r), and at least c * q / (q + (1 - b) (1 - q))
where x is 1. As q and exp(-c) come from the hash by products, this test needs no logarithm and drops
three of four words; logarithms and sums are made for the rest. (A sample without any word
below 20 / W would read as empty, in equal texts alike.)

With 64 samples the standard error of a likeness is 0.0625 at most. A fingerprint holds 16
bits of each sample, four hexadecimal digits, by which two unlike samples agree by chance once in
65,536 times; a likeness is the share of equal samples of two fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import SPACE_CLASS, cut, shards, stash

SAMPLES = 64
#: The least a of a text of W words is below LEAST / W with probability 1 - exp(-LEAST).
LEAST = 20.0


def _uniform(hash_: Column, low: int, width: int) -> Column:
    """In (0, 1), from so many bits of a hash."""
    bits = F.shiftrightunsigned(hash_, low) if low else hash_
    bits = bits if low + width == 64 else bits.bitwiseAND(F.lit((1 << width) - 1))
    return (bits + F.lit(0.5)) * F.lit(2.0**-width)


def draws(hash_: Column) -> tuple[Column, Column, Column]:
    """(q, u, e) of a hash: r = -ln q and c = -ln u are Gamma(2, 1), e = 1 - b is uniform."""
    q = _uniform(hash_, 52, 12) * _uniform(hash_, 40, 12)
    u = _uniform(hash_, 26, 14) * _uniform(hash_, 12, 14)
    return q, u, F.lit(1.0) - _uniform(hash_, 0, 12)


def terms(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, h, x, lx, bar): hash, count and its logarithm of each distinct word, and LEAST over the number of words.

    Hashes are sorted within the row and counted by runs, so nothing is shuffled. Texts without a word have no row."""
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), f"{SPACE_CLASS}+"), "")
    sorted_ = rows.select(*keys, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("__h"))
    ends = sorted_.withColumn("__e", F.expr("filter(sequence(0, size(__h)), k -> k > 0 and (k = size(__h) or __h[k] <> __h[k - 1]))"))
    runs = ends.select(*keys, F.size("__h").alias("w"), F.explode(F.expr("transform(__e, (e, j) -> struct(__h[e - 1] AS h, cast(e - coalesce(get(__e, j - 1), 0) AS double) AS x))")).alias("run"))
    return runs.select(*keys, F.col("run.h").alias("h"), F.col("run.x").alias("x"), F.when(F.col("run.x") == 1, F.lit(0.0)).otherwise(F.log("run.x")).alias("lx"), (F.lit(LEAST) / F.greatest("w", F.lit(1))).alias("bar"))


def samples_of(weighted: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """(keys, k, a): the least a of each sample."""
    facts = [*keys, "k", "x", "lx", "bar"]
    hashed = weighted.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).select(*facts, F.xxhash64("h", "k").alias("hash"))
    q, u, e = draws(F.col("hash"))
    drawn = hashed.select(*facts, q.alias("q"), u.alias("u"), e.alias("e"))
    q, u, e = F.col("q"), F.col("u"), F.col("e")
    may = (1 - u) * q < F.col("bar") * F.when(F.col("lx") == 0, q + e * (1 - q)).otherwise(F.col("x"))
    r = -F.log(q)
    t = F.floor(F.col("lx") / r + (1 - e)).cast("double")
    return drawn.filter(may).select(*keys, "k", (-F.log(u) * F.exp(-r * (t + e))).alias("a")).groupBy(*keys, "k").agg(F.min("a").alias("a"))


def _scaled(hash_: Column, parts) -> Column:
    """0 to parts - 1, ascending with a signed hash."""
    return F.least(F.floor((hash_ / F.lit(2.0**64) + F.lit(0.5)) * parts), parts - 1).cast("long")


def _in_order(docs: DataFrame, key: str, text: str, bucket_bytes: int) -> DataFrame:
    """Rows with ``__b``, a bucket that ascends with (key, text hash).

    Buckets are cut at up to 1,024 quantiles of the key, and between two of them evenly, so
    that their number follows the input (65,536 at most). Rows without a key, and those of a
    key that takes a quantile or more by itself, are cut by their text's hash."""
    n = shards(docs.select(key, text), bucket_bytes, most=65_536)
    marks = min(n, 1024)
    inner = -(-n // marks)
    k, h = F.col(key).cast("long"), F.xxhash64(text)
    facts = docs.agg(F.percentile_approx(k, [i / marks for i in range(1, marks)] or [0.5], 10_000).alias("p"), F.min(k).alias("lo"), F.max(k).alias("hi")).first()
    if facts["lo"] is None:
        return docs.withColumn("__b", _scaled(h, F.lit(n)))
    often = {e: facts["p"].count(e) for e in facts["p"]}
    ends = sorted({*often, facts["hi"]})
    array = lambda v: F.expr(f"array({', '.join(f'{x}L' for x in v)})")
    steps = len(ends).bit_length()
    # A binary search in native expressions over at most 1,025 literals.
    at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(ends) - 1).alias("hi")), lambda a, _: F.when(a["lo"] < a["hi"], F.when(F.get(array(ends), F.floor((a["lo"] + a["hi"]) / 2).cast("int")) < k, F.struct((F.floor((a["lo"] + a["hi"]) / 2).cast("int") + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), F.floor((a["lo"] + a["hi"]) / 2).cast("int").alias("hi")))).otherwise(a), lambda a: a["lo"])
    placed = docs.withColumn("__at", at)
    end, before = F.get(array(ends), F.col("__at")), F.get(array([facts["lo"], *(e + 1 for e in ends[:-1])]), F.col("__at"))
    wide = F.get(array([often.get(e, 1) for e in ends]), F.col("__at")) * inner
    part = F.when((k == end) & (wide > inner), inner + _scaled(h, wide)).otherwise(F.least(F.floor((k - before) / (end - before + 1) * inner), F.lit(inner - 1)))
    stride = (max([1, *often.values()]) + 1) * inner
    return placed.withColumn("__b", F.when(k.isNull(), _scaled(h, F.lit(n)) - n).otherwise(F.col("__at").cast("long") * stride + part)).drop("__at")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = 1 << 20) -> DataFrame:
    """Rows with ``__b``, ``__n`` (place in ascending key order), ``__nb``, ``__nn`` (the next row's place, the
    first's after the last) and ``__next`` (the next row's text). Null keys come first; equal keys follow their text hash."""
    order = [F.col(key).asc_nulls_first(), F.xxhash64(text)]
    placed = _in_order(docs, key, text, bucket_bytes)
    inside = Window.partitionBy("__b").orderBy(*order)
    whole = F.coalesce(F.col(text), F.lit(""))
    seen = placed.withColumns({"__n": F.row_number().over(inside), "__next": F.lead(whole).over(inside)})
    # The first row of each bucket: its key and hash first, its text by a lookup. Only (bucket, next bucket) pairs, 65,536 at most, meet in one task.
    rank = F.struct(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))).alias("k"), F.xxhash64(text).alias("x"))
    least = cut(placed.groupBy("__b").agg(F.min(rank).alias("__least")))
    heads = placed.withColumn("__rank", rank).join(F.broadcast(least), "__b").filter(F.col("__rank") == F.col("__least")).select("__b", whole.alias("__head")).dropDuplicates(["__b"])
    ring = Window.orderBy("__b")
    chain = least.select("__b", F.coalesce(F.lead("__b").over(ring), F.first("__b").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__hb"))
    after = cut(chain.join(heads.select(F.col("__b").alias("__hb"), "__head"), "__hb"))
    last = F.col("__next").isNull()
    linked = seen.join(after, "__b").withColumns({"__nb": F.when(last, F.col("__hb")).otherwise(F.col("__b")), "__nn": F.when(last, 1).otherwise(F.col("__n") + 1), "__next": F.coalesce("__next", "__head")})
    return linked.drop("__hb", "__head")


def edited_text(text: Column, following: Column) -> Column:
    """The last half (rounded down) of the text's code points replaced by as many first ones of the following text, or all it has."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(t, F.lit(1), n - half), F.substring(F.coalesce(following, F.lit("")), F.lit(1), half))


def likeness(one: str, two: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples; two texts without a word are alike."""
    same = F.aggregate(F.zip_with(one, two, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.lit(float(samples))


def print_of(signature: str) -> Column:
    """The fingerprint as text: four hexadecimal digits per sample."""
    return F.lower(F.array_join(F.transform(signature, lambda v: F.lpad(F.hex(v.cast("int").bitwiseAND(F.lit(0xFFFF))), 4, "0")), ""))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs``: key, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``.

    The key must be of an integral type, as its order is cut into ranges; others raise a
    TypeError. A null text counts as empty; texts without words share one fingerprint. Rows
    that share a key or have none are told apart by their place. A single row follows
    itself. An empty table gives an empty result; other columns are not carried."""
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"the key {key!r} must be of an integral type")
    chained = with_next(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__key", "__text")
    at = ["__b", "__n"]
    edited = chained.withColumn("__edited", edited_text(F.col("__text"), F.col("__next")))
    facts = edited.select(*at, "__key", "__nb", "__nn", F.length(F.coalesce("__text", F.lit(""))).cast("long").alias("n_chars"), F.sha2("__edited", 256).alias("edited_sha256"))
    both = edited.select(*at, F.posexplode(F.array("__text", "__edited")).alias("kind", "t"))
    least = samples_of(terms(both, [*at, "kind"], "t"), [*at, "kind"], samples)
    slots = least.select(*at, F.struct((F.col("kind") * samples + F.col("k")).alias("slot"), F.shiftright(F.xxhash64("a"), 48).cast("short").alias("bits")).alias("s"))
    signed = slots.groupBy(*at).agg(F.sort_array(F.collect_list("s")).alias("s"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(2 * samples - 1)), lambda i: F.coalesce(F.get(F.filter("s", lambda x: x["slot"] == i), 0)["bits"], F.lit(-1).cast("short")))
    # Bits alone, two bytes a sample, go through the join's shuffle.
    signed = signed.select(*at, F.when(F.size("s") == 2 * samples, F.col("s.bits")).otherwise(filled).alias("bits"))
    signed = facts.join(signed, at, "left").withColumn("bits", F.coalesce("bits", F.array_repeat(F.lit(-1).cast("short"), 2 * samples)))
    signed = stash(signed.select("*", F.slice("bits", 1, samples).alias("__os"), F.slice("bits", samples + 1, samples).alias("__es")).drop("bits"), "signatures")
    following = signed.select(F.col("__b").alias("__nb"), F.col("__n").alias("__nn"), F.col("__os").alias("__ns"))
    joined = signed.join(following, ["__nb", "__nn"])
    return joined.select(F.col("__key").alias(key), "n_chars", "edited_sha256", print_of("__os").alias("fingerprint"), print_of("__es").alias("edited_fingerprint"), likeness("__os", "__es", samples).alias("near_edited"), likeness("__os", "__ns", samples).alias("near_next"))
