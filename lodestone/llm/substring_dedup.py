"""Removal of passages that occur more than once, by suffix automata of reference shards.

A window is ``length`` consecutive words of one document. Every word under a window whose
word sequence also starts anywhere else is removed; windows are judged on the input.

Each window names a *key*: the smallest hash of its inner ``grain``-word grams. Equal
windows name equal keys, so windows can be judged key by key. Consecutive windows with one
key form a *piece*, of ``MOST`` windows at most (about a third of its words lie in no other piece).

1. Count pieces per key (partial sums in the mappers). Keys met once hold no repeat.
2. Pieces of equal words (128 bits of hash) are one *body*. One occurrence stands for them
   all, weighted by their number, so a passage in a third of all documents is one body.
3. Bodies are dealt by key into reference shards. A shard's task builds the suffix automata
   of its bodies and streams the same bodies through them for matching statistics; a match of
   ``length`` words with two or more (weighted) end positions is a repeat. The shards are
   dealt and not broadcast: all shards together are as large as the repeated part of the
   corpus, so a broadcast of them would have no bound, and a body need only meet the shard of
   its own key. What a body's spans are is carried to all its occurrences.
4. An automaton holds ``room`` words. A key whose bodies have more (a line in very many
   different surroundings) is dealt on by whole windows: such a shard is one word sequence,
   known by 128 bits of hash, and whether it ends twice is a weighted count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import discard, fresh, places, stash, trimmed
from lodestone.llm._words import U, chunks, mix

#: Windows of a piece at most, so that a text that repeats one gram is many pieces.
MOST = 256


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over x[i : i + w], by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pieces(words, length: int, grain: int):
    """(first word, number of windows, key, hash of the words, loops) of each piece.

    A piece loops if the gram that names its key stands in it more than once, so that a
    window may repeat within the piece itself."""
    n, w = len(words.hash), length - grain + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(U), none.astype(U), none.astype(bool)
    sums = words.sums()
    start = np.arange(n - grain + 1)
    grams = words.stretch(sums, start, start + grain)
    key = _window_min(grams, w)
    inside = words.doc[: n - length + 1] == words.doc[length - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (key[1:] != key[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (key[1:] != key[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    left, right = a.copy(), b + w - 1
    for step in range(w):
        left = np.where((left == a + step) & (grams[np.minimum(a + step, len(grams) - 1)] != key[a]), left + 1, left)
        right = np.where((right == b + w - 1 - step) & (grams[b + w - 1 - step] != key[a]), right - 1, right)
    loops, n = left != right, b - a + 1
    if len(n) and n.max() > MOST:  # longer than a window's grams, so it loops
        parts = -(-n // MOST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        a, loops, n = np.repeat(a, parts) + nth * MOST, np.repeat(loops, parts), np.minimum(np.repeat(n, parts) - nth * MOST, MOST)
    return a, n, mix(key[a]), words.stretch(sums, a, a + n + length - 1), loops


class Automaton:
    """Suffix automaton of several word sequences with weighted end-position counts."""

    def __init__(self):
        self.go, self.link, self.len, self.count = [{}], [-1], [0], [0]

    def add(self, sequence, weight: int) -> None:
        go, link, length, count = self.go, self.link, self.len, self.count
        last = 0
        for c in sequence:
            p, q = last, go[last].get(c)
            if q is not None:  # an earlier sequence went this way
                if length[p] + 1 == length[q]:
                    last = q
                    count[q] += weight
                    continue
                new = len(go)
                go.append(go[q].copy()), link.append(link[q]), length.append(length[p] + 1), count.append(weight)
                link[q] = new
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = new
                    p = link[p]
                last = new
                continue
            new = len(go)
            go.append({}), link.append(0), length.append(length[last] + 1), count.append(weight)
            while p >= 0 and c not in go[p]:
                go[p][c] = new
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(go)
                    go.append(go[q].copy()), link.append(link[q]), length.append(length[p] + 1), count.append(0)
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def close(self) -> None:
        """Carries end-position counts to the suffixes."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def matches(self, sequence, length: int):
        """End positions (exclusive) where the longest repeated suffix has at least ``length`` words."""
        go, link, size, count, v, have = self.go, self.link, self.len, self.count, 0, 0
        for at, c in enumerate(sequence, 1):
            to = go[v].get(c)
            while to is None or count[to] < 2:
                v = link[v]
                if v < 0:
                    v = have = 0
                    break
                have = size[v]
                to = go[v].get(c)
            else:
                v, have = to, have + 1
                if have >= length:
                    yield at


def spans_of(ends, length: int):
    """Maximal spans under windows that end at these ascending places."""
    begin = until = -1
    for end in ends:
        if end - length > until:
            if until >= 0:
                yield begin, until
            begin = end - length
        until = end
    if until >= 0:
        yield begin, until


def _mapper(length: int, grain: int, kind: str):
    """kind ``count``: pieces per key of a chunk; ``pieces``: all pieces."""

    def run(batches):
        for batch in batches:
            one, two = (batch.column(k).to_numpy() for k in (0, 1))
            for at, _, words in chunks(batch.column(2), False):
                a, n, key, body, loops = pieces(words, length, grain)
                if kind == "count":
                    key, count = np.unique(np.concatenate([key, key[loops]]), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "n": pa.array(count.astype(np.int64))})
                else:
                    doc = words.doc[a]
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "body": pa.array(body.view(np.int64)), "place": pa.array(one[at + doc]), "place2": pa.array(two[at + doc]), "start": pa.array((a - words.first[doc]).astype(np.int32)), "windows": pa.array(n.astype(np.int32)), "loops": pa.array(loops)})

    return trimmed(run)


ANSWER = "key long, body long, weight int, start int, one long, two long, words binary"


def _answer(length: int):
    """Texts with their wanted bodies to the bodies' words; those of crowded keys to one row for each window."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ends, wanted = lists.offsets.to_numpy(), lists.values
            field = {k: wanted.field(k).to_numpy(zero_copy_only=False) for k in ("key", "body", "start", "windows", "weight", "crowded")}
            for at, to, words in chunks(batch.column(0), False):
                lo, hi = ends[at], ends[to]
                of = {k: v[lo:hi] for k, v in field.items()}
                first = words.first[np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))] + of["start"]
                calm = ~of["crowded"]
                n, none = int(calm.sum()), pa.nulls(int(calm.sum()), pa.int64())
                held = [words.hash[a:b].tobytes() for a, b in zip(first[calm], (first + of["windows"] + length - 1)[calm], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(of["key"][calm]), pa.array(of["body"][calm]), pa.array(of["weight"][calm]), pa.array(np.zeros(n, np.int32)), none, none, pa.array(held, pa.binary())], names=[x.split(" ")[0] for x in ANSWER.split(", ")])
                if n < hi - lo:
                    sums, windows = words.sums(), of["windows"][~calm]
                    nth = (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
                    s = np.repeat(first[~calm], windows) + nth
                    one = words.stretch(sums, s, s + length)
                    two = mix(words.hash[s] ^ mix(words.hash[s + length // 2] ^ mix(words.hash[s + length - 1] + one)))
                    each = [pa.array(np.repeat(of[k][~calm], windows)) for k in ("key", "body", "weight")]
                    yield pa.RecordBatch.from_arrays([*each, pa.array(nth), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.nulls(len(s), pa.binary())], names=[x.split(" ")[0] for x in ANSWER.split(", ")])

    return trimmed(run)


def _shard(length: int):
    """One reference shard: builds its automata, key by key, and streams its bodies through them."""

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.select(["key", "body", "weight", "words"]).sort_by("key")
        key, body, weight = (batch.column(k).to_numpy() for k in ("key", "body", "weight"))
        words = batch.column("words")
        out = []
        edges = np.flatnonzero(np.diff(key)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(key)], strict=True):
            sequences = [np.frombuffer(words[i].as_buffer(), np.int64).tolist() for i in range(lo, hi)]
            automaton = Automaton()
            for i, s in zip(range(lo, hi), sequences, strict=True):
                automaton.add(s, int(weight[i]))
            automaton.close()
            for i, s in zip(range(lo, hi), sequences, strict=True):
                out += ((key[i], body[i], a, b) for a, b in spans_of(automaton.matches(s, length), length))
        key, body, first, last = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"key": pa.array(key, pa.int64()), "body": pa.array(body, pa.int64()), "from": pa.array(first, pa.int32()), "to": pa.array(last, pa.int32())})

    return run


def _strip(own: str, marks: str):
    """Texts (column ``own``) and spans (column ``marks``) to kept texts."""

    def run(batches):
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            kept, n, removed = [], [], []
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for text, spans in zip(columns.pop(own).to_pylist(), columns.pop(marks).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n.append(len(words))
                if spans:
                    out, at = [], 0
                    for s in sorted(spans, key=lambda s: s["from"]):
                        out += words[at : max(at, s["from"])]
                        at = max(at, s["to"])
                    words = out + words[at:]
                kept.append(b" ".join(words).decode())
                removed.append(n[-1] - len(words))
            yield pa.RecordBatch.from_pydict(columns | {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return trimmed(run)


def repeated_spans(source: DataFrame, length: int = 35, grain: int = 12, room: int = 1 << 16) -> DataFrame:
    """Spans ``[from, to)`` of words under repeated windows, of a table (place, place2, text).

    Returns (place, place2, spans), one row for each row with spans; spans may overlap."""
    at = ["place", "place2"]
    source = source.select(*at, "text").filter(F.length("text") >= 2 * length - 1)
    keys = source.mapInArrow(_mapper(length, grain, "count"), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    everything = source.mapInArrow(_mapper(length, grain, "pieces"), "key long, body long, place long, place2 long, start int, windows int, loops boolean")
    found = stash(everything.join(keys, "key", "left_semi"), "pieces")
    bodies = found.groupBy("key", "body").agg(F.count("*").alias("copies"), F.min(F.struct(*at, "start")).alias("one"), F.max("windows").alias("windows"), F.max("loops").alias("loops"))
    per_key = bodies.groupBy("key").agg(F.sum("copies").alias("pieces"), F.sum(F.col("windows") + (length - 1)).alias("held"))
    judged = bodies.join(per_key, "key").filter("pieces > 1 or loops")
    facts = F.struct("key", "body", F.col("one.start").alias("start"), "windows", F.least("copies", F.lit(2)).cast("int").alias("weight"), (F.col("held") > room).alias("crowded"))
    wanted = judged.groupBy("one.place", "one.place2").agg(F.collect_list(facts).alias("wanted"))  # as long as the document at most
    answer = stash(source.join(wanted, at).select("text", "wanted").mapInArrow(_answer(length), ANSWER), "answers")
    bodies_ = answer.filter("words is not null")
    n = max(bodies_.count() // 20_000 + 1, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shards = bodies_.select("key", "body", "weight", "words", F.pmod(F.xxhash64("key"), F.lit(n)).alias("shard"))
    matched = shards.groupBy("shard").applyInArrow(_shard(length), "key long, body long, from int, to int")
    windows = answer.filter("words is null").select("key", "body", "weight", "start", "one", "two")
    again = windows.groupBy("one", "two").agg(F.sum("weight").alias("n")).filter("n > 1").select("one", "two")
    counted = windows.join(again, ["one", "two"], "left_semi").select("key", "body", F.col("start").alias("from"), (F.col("start") + length).alias("to"))
    marks = stash(matched.unionByName(counted).groupBy("key", "body").agg(F.collect_set(F.struct("from", "to")).alias("spans")), "marks")
    discard(answer)
    there = F.transform("spans", lambda s: F.struct((s["from"] + F.col("start")).alias("from"), (s["to"] + F.col("start")).alias("to")))
    return found.join(marks, ["key", "body"]).groupBy(*at).agg(F.flatten(F.collect_list(there)).alias("spans"))


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 35, grain: int = 12, room: int = 1 << 16) -> DataFrame:
    """All rows of ``docs`` plus ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    Works row by row even where ``key`` is null or repeats: a row is known by 128 bits of
    hash of its key and text, and rows equal in both are treated alike, as copies of each
    other. The key may be of any type that can be hashed. A null text has no words. Columns
    of ``docs`` that bear the names of the results are replaced; all others stay as they are,
    whatever their names. An empty table gives an empty result."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    own, marks, one, two = (fresh(docs, x) for x in ("__text", "__spans", "__place", "__place2"))
    place, place2 = places(key, text)
    rows = docs.withColumns({one: place, two: place2, own: F.col(text)})
    spans = repeated_spans(rows.select(F.col(one).alias("place"), F.col(two).alias("place2"), F.col(text).alias("text")), length, grain, room)
    joined = rows.join(spans.select(F.col("place").alias(one), F.col("place2").alias(two), F.col("spans").alias(marks)), [one, two], "left")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return joined.select(*docs.columns, own, marks).mapInArrow(_strip(own, marks), f"{fields}n_words long, n_removed long, kept_text string")
