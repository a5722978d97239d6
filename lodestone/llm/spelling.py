"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Words meet in groups that share all but one stretch of their letters. A single edit leaves one half
of the longer word whole, so a word stands under its first and its second half, for its own length and for
being the shorter one of a pair. A group of more than ``most`` words is halved again in the stretch that
is not shared, until it is small or the stretch has two letters, where the alphabet bounds it. A pair thus
meets wherever its edit can lie, and counts only where its first difference lies: once.

Within a group a positional q-gram index is built over the open stretch. For a word, the postings of its grams at
the positions that one edit allows are merged by a heap; only words found in as many lists as one edit must
leave alone are verified letter by letter.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import discard, stash, trimmed

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Q = 2


def corpus_words(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7, times: int = 2, every: int = 31) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A-Z lower-cased, with their number in all of them.

    A run loses one code point where ``every`` divides the checksum of key and run. Words of fewer than
    ``least`` code points or ``times`` occurrences are left out. A null text has no words, a null key reads as
    empty, and repeated rows count as often as they stand; an empty table gives no words."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({LETTERS}{{{least},}})"), F.lit(1))).alias("run"))
    run = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    drawn = run.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.pmod(F.col("h"), F.lit(every)) == 0, cut).otherwise(F.col("run"))
    return drawn.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def _keyed(rows: DataFrame) -> DataFrame:
    """``key``: hash of what is fixed. Words that meet by a collision are told apart when they are verified."""
    fixed = F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(F.col("word"), F.length("word") - F.col("b") + 1, F.col("b"))
    return rows.withColumn("key", F.xxhash64("l", "a", "b", *fixed))


def _halves(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """The open stretch from ``a`` to ``l - b`` of the longer word, halved: its first half joins what is fixed, or its second."""
    h = F.floor((l - a - b) / 2).cast("int")
    return F.array(F.struct(l.alias("l"), (a + h).alias("a"), b.alias("b")), F.struct(l.alias("l"), a.alias("a"), (l - a - h).alias("b")))


def groups(words: DataFrame, most: int = 512, few: int = 1 << 18) -> tuple[DataFrame, list[DataFrame]]:
    """(word, n, l, a, b, key) rows and the stashed tables behind them: each word in each of its groups.

    ``l`` is the length of the group's longer words, whose letters from a to l - b are open. Groups of over ``most``
    words are halved as long as three letters are open. Keys of such groups are at most one per ``most`` rows;
    they are broadcast where counted to be ``few`` or fewer, and met by a shuffle otherwise."""
    length = F.length("word")
    zero = F.lit(0)
    begun = F.concat(_halves(length, zero, zero), _halves(length + 1, zero, zero))
    rows = _keyed(words.select("word", "n", F.explode(begun).alias("g")).select("word", "n", "g.*"))
    done: list[DataFrame] = []
    kept: list[DataFrame] = []
    while True:
        rows = stash(rows, "spelling-rows")
        kept.append(rows)
        crowded = stash(rows.filter(F.col("l") - F.col("a") - F.col("b") > 2).groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("key"), "spelling-crowded")
        kept.append(crowded)
        of = crowded.count()
        if not of:
            done.append(rows)
            break
        keys = F.broadcast(crowded) if of <= few else crowded
        # A collision may bring a group of two open letters under a crowded key; it stays whole.
        done.append(rows.join(keys, "key", "left_anti").unionByName(rows.filter(F.col("l") - F.col("a") - F.col("b") <= 2).join(keys, "key", "left_semi")))
        split = rows.filter(F.col("l") - F.col("a") - F.col("b") > 2).join(keys, "key", "left_semi")
        rows = _keyed(split.select("word", "n", F.explode(_halves(F.col("l"), F.col("a"), F.col("b"))).alias("g")).select("word", "n", "g.*"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found, kept


class Index:
    """Positional q-gram index over the open stretches of one group."""

    def __init__(self):
        self.lists: dict[tuple[int, int, str], list[int]] = {}
        self.sizes: dict[int, int] = {}

    def add(self, i: int, size: int, grams: list[str]) -> None:
        self.sizes[size] = self.sizes.get(size, 0) + 1
        for at, gram in enumerate(grams):
            self.lists.setdefault((size, at, gram), []).append(i)

    def candidates(self, grams: list[str], size: int, shorter: bool) -> list[int]:
        """Words of ``size`` (one less than the asking word's if ``shorter``) that share all but Q of its grams in place.

        One edit changes Q of a word's padded grams at most; a gram behind it may stand one place earlier in a shorter word.
        A word found often enough is in one of any Q + 1 lists, so the shortest ones are merged and the others looked up."""
        if size not in self.sizes:
            return []
        get = self.lists.get
        if shorter:
            found = [[x for at_ in (at, at - 1) if (x := get((size, at_, gram)))] for at, gram in enumerate(grams)]
        else:
            found = [[x] if (x := get((size, at, gram))) else [] for at, gram in enumerate(grams)]
        bound = len(grams) - Q
        if bound <= 0:  # one open letter: any two words are an edit apart
            return sorted({i for (s, _, _), held in self.lists.items() if s == size for i in held})
        found.sort(key=lambda held: sum(map(len, held)))
        merged, rest = found[: Q + 1], found[Q + 1 :]
        passing = []
        for i, same in groupby(heapq.merge(*(x for held in merged for x in held))):
            count = min(sum(1 for _ in same), Q + 1)
            for k, held in enumerate(rest):
                if count >= bound or count + len(rest) - k < bound:
                    break
                count += any((p := bisect_left(x, i)) < len(x) and x[p] == i for x in held)
            if count >= bound:
                passing.append(i)
        return passing


def difference(one: str, two: str, start: int) -> int | None:
    """Where ``one`` first differs from ``two``, which is as long or a letter shorter, if one edit turns it into the other."""
    i, end = start, len(two)
    while i < end and one[i] == two[i]:
        i += 1
    if i == len(one) or one[:start] != two[:start]:
        return None
    return i if one[i + 1 :] == two[i + 1 if len(one) == len(two) else i :] else None


def links(members: list[tuple[str, int]], l: int, a: int, b: int):  # noqa: E741
    """Pairs (i, j) of members one edit apart whose first difference lies in the group's open stretch."""
    index = Index()
    padded = []
    for word, _ in members:
        open_ = "\x00" + word[a : len(word) - b] + "\x01"
        padded.append([open_[k : k + Q] for k in range(len(open_) - Q + 1)])
    shorter = [i for i, (word, _) in enumerate(members) if len(word) < l]
    longer = [i for i, (word, _) in enumerate(members) if len(word) == l]
    for i in shorter:
        index.add(i, l - 1, padded[i])
    for i in longer:
        word = members[i][0]
        for size, less in ((l - 1, True), (l, False)):
            for j in index.candidates(padded[i], size, less):
                at = difference(word, members[j][0], a)
                if at is not None and at < l - b:
                    yield i, j
        index.add(i, l, padded[i])


def near_words(words: DataFrame, most: int = 512) -> DataFrame:
    """(word, n, n_near, form, form_n) of a table (word, n) of different words, which is read more than once.

    ``n_near`` counts the words one edit apart. ``form`` is that of the largest n among them (the smallest in
    code-point order of equal ones) if its n is ten times the word's or more, else null. Words without a near one have 0
    and nulls; a null word is left out, and an empty table gives none."""
    rows, kept = groups(words.filter(F.col("word").isNotNull()).select("word", "n"), most)
    by = ("key", "l", "a", "b")
    sorted_ = rows.repartition(*(F.col(c) for c in by)).sortWithinPartitions(*by)

    def run(batches):
        def flow():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in (*by, "word", "n")), strict=True)

        out: list[tuple] = []
        for (_, l, a, b), same in groupby(flow(), key=lambda r: r[:4]):  # noqa: E741
            members = [(r[4], r[5]) for r in same]
            if len(members) < 2:
                continue
            best: dict[int, list] = {}
            for pair in links(members, l, a, b):
                for i, j in (pair, pair[::-1]):
                    near = (-members[j][1], members[j][0])
                    have = best.get(i)
                    if have is None:
                        best[i] = [1, near]
                    else:
                        have[0] += 1
                        have[1] = min(have[1], near)
            out += [(members[i][0], count, least[0], least[1]) for i, (count, least) in best.items()]
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    found = sorted_.mapInArrow(trimmed(run), "word string, near long, less long, with string")
    none = words.filter(F.col("word").isNotNull()).select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("less"), F.lit(None).cast("string").alias("with"))
    whole = none.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "near", "less", "with"))
    # Null structs (words of their own) come before all others in order, but min() skips nulls.
    near = F.min(F.when(F.col("less").isNotNull(), F.struct("less", "with")))
    joined = whole.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), near.alias("best"))
    much = -F.col("best.less") >= 10 * F.col("n")
    result = stash(joined.select("word", "n", "n_near", F.when(much, F.col("best.with")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n")), "spelling-near")
    discard(*kept)
    return result


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["word", "near", "less", "with"])


def with_roots(near: DataFrame) -> DataFrame:
    """Rows of ``near_words`` plus ``root``: the last word that one comes to by following forms; a word without a form is its own.

    A form stands ten times as often, so chains are as short as the logarithm of the counts, and each round doubles the steps."""
    steps, before = near.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), None
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = stash(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if before is not None:
            discard(before)
        steps, before = doubled.select("word", "root"), doubled
        if not doubled.filter("moved").limit(1).count():
            break
    return near.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7, times: int = 2, every: int = 31, most: int = 512) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of whole texts; see ``corpus_words``, ``near_words`` and ``with_roots``."""
    words = stash(corpus_words(docs, text, key, least, times, every), "spelling-words")
    near = near_words(words, most)
    discard(words)
    return with_roots(near)
