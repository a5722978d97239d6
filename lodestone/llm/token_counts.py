"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word are a linked list, its mergeable neighbours a heap by merge rank.
The lowest pair is popped and merged until none is left; the count is the number of initial
symbols minus the number of merges. No identifiers are made on the way out.

Words come from the byte-level pattern; special strings of the vocabulary are cut out of
the text first and count one each. Counts are kept per word in a bounded cache.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import fresh, trimmed

#: Fixed value: the published pattern of byte-level pre-tokenisation.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that a cache of words may hold.
ROOM = 24 << 20
#: That of the counter's two caches: it holds numbers alone, and most of its time goes to words that are met again.
COUNTS_ROOM = 112 << 20
PAIR = re.compile(r"\s\s").search


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary spells each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Kept(dict):
    """Results of a function by word, within ``room`` bytes; long words are not kept.

    Two generations of half the room each: when the young one is full, it becomes the old one, and words that are met again come
    back from there, so words in use stay and only those not met for a generation are made anew."""

    def __init__(self, make, room: int | None = None):
        self.make, self.room, self.held, self.old = make, room or ROOM, 0, {}

    def __missing__(self, word):
        made = self.old.get(word)
        if made is None:
            made = self.make(word)
        if len(word) < 64:
            self.held += 200 + 2 * len(word) + (len(made) if isinstance(made, bytes) else 0)
            if self.held > self.room // 2:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[word] = made
        return made


class Merges:
    """Counts tokens of a text for one vocabulary file. Lives in a worker; loads on first use."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids = file["model"]["vocab"]
        self.first = [ids[c] for c in byte_letters()]
        self.rank = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[a] << 20 | ids[b]] = rank << 20 | ids[a + b]
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(PATTERN).findall
        self.cache = Kept(self.word, COUNTS_ROOM)
        self.units = Kept(lambda unit: self.pieces(f" {unit}"), COUNTS_ROOM)

    def word(self, word: str) -> int:
        symbols = [self.first[b] for b in word.encode()]
        n = len(symbols)
        if n < 2:
            return n
        rank = self.rank.get
        heap = []
        for i in range(n - 1):
            found = rank(symbols[i] << 20 | symbols[i + 1])
            if found is not None:
                heap.append((found, i))
        if not heap:
            return n
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            found, i = heappop(heap)
            j = after[i]
            # Entries of symbols that have since changed are stale.
            if symbols[i] < 0 or j >= n or rank(symbols[i] << 20 | symbols[j]) != found:
                continue
            symbols[i], symbols[j] = found & 0xFFFFF, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := rank(symbols[i] << 20 | symbols[k])) is not None:
                    heappush(heap, (found, i))
            if (h := before[i]) >= 0 and (found := rank(symbols[h] << 20 | symbols[i])) is not None:
                heappush(heap, (found, h))
        return n - merges

    def pieces(self, text: str) -> int:
        """By the pattern, word by word."""
        return sum(map(self.cache.__getitem__, self.words(text)))

    def plain(self, text: str) -> int:
        if PAIR(text):
            return self.pieces(text)
        # Without two white-space characters in a row, each " word" between blanks is cut up by itself.
        lines = text.split("\n")
        total = len(lines) - 1
        for line in lines:
            units = line.split(" ")
            total += self.pieces(units[0]) + sum(map(self.units.__getitem__, units[1:]))
        return total

    def text(self, text: str) -> int:
        if self.special is None or not (cuts := self.special.findall(text)):
            return self.plain(text)
        return len(cuts) + sum(map(self.plain, self.special.split(text)))


_loaded: dict[str, Merges] = {}


def counter(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """All rows of ``docs`` plus ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    A null or empty text has no bytes and no tokens. Rows are independent: repeats count
    alike, an empty table stays empty. Columns with the names of the results are replaced.
    ``vocabulary`` is the path of a byte-level BPE file, readable on every executor."""

    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    own = fresh(docs, "__text")

    def run(batches):
        count = counter(vocabulary).text
        for batch in batches:
            at = batch.schema.get_field_index(own)
            n = [count(t) if t else 0 for lo in range(0, batch.num_rows, 512) for t in batch.column(at).slice(lo, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(n, pa.int64())], names=[*(x for x in batch.schema.names if x != own), "n_tokens"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return (
        docs.withColumn(own, F.col(text))
        .withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .mapInArrow(trimmed(run), f"{fields}n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
