"""Packing of tokenised documents into fixed-size sequences by linear grouping.

Only the number of pieces of each length matters to the plan, and lengths are at most the
capacity, so the plan is made from a histogram of that many counts whatever the corpus.

1. Pieces over ``small`` tokens, longest first, fall into groups of equal cardinality; all
   of a group count as long as its longest. The few sizes left make a configuration
   problem, whose linear relaxation is solved by column generation.
2. Whole multiples of each configuration become runs of sequences. The actual pieces of a
   group take its slots, so a run splits where their lengths change.
3. What rounding left over and the small pieces, longest first, go where they fit best;
   new sequences open only where nothing has room.

The plan is a list of intervals: pieces of one length with ranks lo, lo + 1, ... go to
sequences bin, bin + 1, ... at one offset. Its size depends on capacity and groups alone.
Ranks come from salted counts, so a length shared by most documents loads no single task.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import shards, stash, trimmed
from lodestone.llm.token_counts import PAIR, PATTERN, Kept, byte_letters


def best_configuration(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack: the most valuable slots that fit, as (value, {index of size: slots})."""
    best = [0.0] * (capacity + 1)
    took = [-1] * (capacity + 1)
    order = [(sizes[i], float(values[i]), i) for i in range(len(sizes)) if values[i] > 1e-9]
    table = np.zeros(capacity + 1)
    from_ = np.full(capacity + 1, -1)
    for size, value, i in order:
        # Repeats of one size fit at most capacity // size times.
        for _ in range(capacity // size):
            shifted = np.concatenate([np.full(size, -1.0), table[:-size] + value])
            better = shifted > table + 1e-12
            if not better.any():
                break
            table = np.where(better, shifted, table)
            from_[better] = i
    best, took = table, from_
    at = int(np.argmax(best))
    slots: dict[int, int] = {}
    total = 0.0
    while at > 0 and took[at] >= 0:
        i = int(took[at])
        slots[i] = slots.get(i, 0) + 1
        total += float(values[i])
        at -= sizes[i]
    return total, slots


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[dict[int, int], float]]:
    """The covering relaxation ``min sum(x), A x >= demand`` by column generation: basic configurations and their multiples."""
    n = len(sizes)
    columns = [{i: capacity // s} for i, s in enumerate(sizes)]
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag(1.0 / np.diag(basis)) if n else basis
    x = inverse @ np.array(demand, float)
    for _ in range(rounds):
        duals = np.ones(n) @ inverse
        value, slots = best_configuration(duals, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        column = np.zeros(n)
        for i, k in slots.items():
            column[i] = k
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        theta = ratio[leave]
        x = x - theta * step
        x[leave] = theta
        columns[leave] = slots
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
    return [(c, max(0.0, float(v))) for c, v in zip(columns, x, strict=True)]


def plan(histogram: dict[int, int], capacity: int, groups: int = 192, small: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (length, lo, pieces, first sequence, offset) that place every piece, and the number of sequences."""
    small = capacity // 4 if small is None else small
    left = {length: n for length, n in histogram.items() if n}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("a piece is empty or longer than a sequence")
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs (first sequence, sequences)
    free: list[int] = []
    bins = 0

    def open_(first: int, n: int, space: int) -> None:
        if n and space:
            if space not in room:
                room[space] = []
                insort(free, space)
            room[space].append((first, n))

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    large = sorted((length for length in left if length > small), reverse=True)
    total = sum(left[length] for length in large)
    each = -(-total // groups) if total else 1
    members: list[list[list[int]]] = []  # of each group: [length, pieces], longest first
    filled = each
    for length in large:
        n = left[length]
        while n:
            if filled == each:
                members.append([])
                filled = 0
            take = min(n, each - filled)
            members[-1].append([length, take])
            filled += take
            n -= take
    merged: dict[int, list[list[int]]] = {}
    for m in members:  # groups with one longest length are one size
        merged.setdefault(m[0][0], []).extend(m)
    sizes = list(merged)
    groups_of = [merged[s] for s in sizes]
    found = configurations(sizes, [sum(n for _, n in m) for m in groups_of], capacity) if sizes else []
    for slots, x in sorted(found, key=lambda c: -c[1]):
        supply = {i: sum(n for _, n in groups_of[i]) for i in slots}
        times = min([int(x + 1e-6), *(supply[i] // k for i, k in slots.items())])
        if times <= 0:
            continue
        queues = []
        for i, k in slots.items():
            for _ in range(k):
                queue, need = [], times
                while need:
                    length, n = groups_of[i][0]
                    take = min(n, need)
                    queue.append([length, take])
                    need -= take
                    if take == n:
                        groups_of[i].pop(0)
                    else:
                        groups_of[i][0][1] -= take
                queues.append(queue)
        first, bins = bins, bins + times
        while times:
            run = min(q[0][1] for q in queues)
            offset = 0
            for q in queues:
                put(q[0][0], run, first, offset)
                offset += q[0][0]
                q[0][1] -= run
                if not q[0][1]:
                    q.pop(0)
            open_(first, run, capacity - offset)
            first, times = first + run, times - run
    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect_left(free, length)
            if at == len(free):
                n = -(-left[length] // (capacity // length))
                open_(bins, n, capacity)
                bins += n
                continue
            space = free[at]
            first, n = room[space].pop()
            if not room[space]:
                del room[space]
                free.pop(at)
            take = min(n, left[length])
            put(length, take, first, capacity - space)
            open_(first, take, space - length)
            open_(first + take, n - take, space)
    return out, bins


#: Bytes that the encoder's cache of words with their identifiers may hold; that of first words of lines, a quarter.
IDS_ROOM = 64 << 20


class Encoder:
    """Identifiers of a text by a byte-level ``tokenizers`` file, as little-endian unsigned 32-bit bytes.

    Where the file numbers its merges in order, as byte-level files do, words are encoded by
    their ranks with ``tiktoken``, which gives the same identifiers in a sixth of the time."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.ids = self.ranked(path) or (lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.units = Kept(lambda unit: self.one(f" {unit}"), IDS_ROOM)
        self.heads = Kept(self.one, IDS_ROOM // 4)

    @staticmethod
    def ranked(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        ids = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if ids != sorted(set(ids)):
            return None
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def one(self, text: str) -> bytes:
        ids = self.ids(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> bytes:
        if PAIR(text):
            return self.one(text)
        lines = []
        for line in text.split("\n"):
            units = line.split(" ")
            lines.append(self.heads[units[0]] + b"".join(map(self.units.__getitem__, units[1:])))
        return self.heads["\n"].join(lines)

    def text(self, text: str) -> bytes:
        if self.cut and any(s in text for s in self.special):
            return b"".join(self.special.get(t) or self.plain(t) for t in self.cut(text))
        return self.plain(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, key: str, text: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document: its tokens and ``end_id``, cut from the end into pieces of ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        code = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                keys, column = batch.column(0).slice(at, 512), batch.column(1).slice(at, 512)
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(column.to_pylist()):
                    body = code.text(t or "") + end
                    n = len(body) // 4
                    lo, k = 0, 0
                    while lo < n:
                        hi = lo + ((n - lo) % capacity or capacity)
                        part = body[4 * lo : 4 * hi]
                        rows.append(i), piece.append(k), start.append(lo), length.append(hi - lo), crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int64))
                        lo, k = hi, k + 1
                arrays = [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(trimmed(run), f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * with_ids)


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, groups: int = 192, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens, as few as the method finds.

    Returns one row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset`` and, on demand, ``ids``. A null text counts as empty, so its
    document is the end token alone. Null and repeated keys are packed like any others;
    an empty table gives an empty result. Other columns of ``docs`` are not carried."""
    made = stash(pieces(docs, vocabulary, key, text, capacity, end_id, with_ids), "pieces")
    salts = shards(made, 8 << 20, least=16)
    order = [F.col("key"), F.col("piece"), F.col("start"), F.col("length"), F.col("ids_crc32")]
    salted = made.withColumn("salt", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    intervals, _ = plan(histogram, capacity, groups)
    steps = docs.sparkSession.createDataFrame(intervals or [(0, 0, 0, 0, 0)], "length long, lo long, n long, first long, offset long")
    ranked = salted.join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    placed = ranked.join(F.broadcast(steps), (ranked["length"] == steps["length"]) & (ranked["rank"] >= steps["lo"]) & (ranked["rank"] < steps["lo"] + steps["n"]))
    ids = ["ids"] if with_ids else []
    return placed.select(F.col("key").alias(key), "piece", "start", ranked["length"], "ids_crc32", *ids, (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
