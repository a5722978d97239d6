"""A quality classifier over document statistics.

Statistics of each whole text (shares of symbols, capitals, repeated lines and windows, word lengths, ...) are computed in
vectorised passes over Arrow batches. Random Fourier features approximate a Gaussian kernel over them; each partition
sums its normal equations, and the sums of all partitions, kept by fold, give the ridge regression. Leaving a
fold's sums out gives the error of every strength of the ridge and scores of rows that a model has not seen; isotonic
regression of the labels on those scores calibrates them into probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import fresh, trimmed
from lodestone.llm._words import Words, chunks

STATISTICS = (
    "words", "word_length", "length_spread", "longest_word", "symbols", "capitals", "digits", "calls", "stops", "other_marks", "line_ends",
    "repeated_lines", "distinct_words", "commonest_word", "repeated_windows", "beyond_ascii", "symbol_ends", "lone_symbols",
)
#: Byte classes, in the order of the table's bits.
SYMBOLS, CAPITALS, SMALL, DIGITS, CALLS, STOPS, MARKS, ENDS, LEADS, STARTS = range(10)
_CLASS = np.zeros((10, 256), bool)
for _k, _s in ((SYMBOLS, b"#*$%&|<>@^~_=+\\{}[]/"), (CAPITALS, bytes(range(65, 91))), (SMALL, bytes(range(97, 123))), (DIGITS, b"0123456789"), (CALLS, b"!?"), (STOPS, b"."), (MARKS, b",;:'\"()-`"), (ENDS, b"\n"), (LEADS, bytes(range(0xC0, 0x100))), (STARTS, bytes(b for b in range(256) if not 0x80 <= b < 0xC0))):
    _CLASS[_k, list(_s)] = True
FOLDS = 4
#: Raw scores are counted in steps of a thousandth between these bounds.
LOW, HIGH, STEP = -0.5, 1.5, 0.001


def _within(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: the number of different values and of the commonest one's places."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(d)))
    kinds, top = np.bincount(d[at], minlength=n), np.zeros(n, np.int64)
    np.maximum.at(top, d[at], runs)
    return kinds, top


def _statistics(w: Words) -> np.ndarray:
    n = len(w.bounds) - 1
    many = w.first[1:] - w.first[:-1]
    some = np.maximum(many, 1)

    def counted(k: int) -> np.ndarray:
        total = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_CLASS[k][w.data], out=total[1:])
        return total

    starts = counted(STARTS)
    chars = np.maximum(starts[w.bounds[1:]] - starts[w.bounds[:-1]], 1)
    of = {k: (c := counted(k))[w.bounds[1:]] - c[w.bounds[:-1]] for k in range(LEADS + 1) if k != STARTS}
    length = (starts[w.end] - starts[w.start]).astype(float)
    mean = np.bincount(w.doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(w.doc, length**2, n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, length)
    kinds, top = _within(w.doc, w.hash, n)
    at, window = w.windows(3)
    windows, _ = _within(w.doc[at], window, n)
    spans = np.bincount(w.doc[at], minlength=n)
    # Lines with a word: from a word behind a line end (or first of its text) to the word before the next such.
    ends = counted(ENDS)[w.start]
    begins = np.ones(len(w.doc), bool)
    begins[1:] = (ends[1:] != ends[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(begins)
    line = w.stretch(w.sums(), first, np.append(first[1:], len(w.doc))) if len(first) else np.zeros(0, np.uint64)
    lines = np.bincount(w.doc[first], minlength=n)
    different, _ = _within(w.doc[first], line, n)
    tail = _CLASS[SYMBOLS][w.data[w.end - 1]] if len(w.end) else np.zeros(0, bool)
    lone = tail & (w.end - w.start == 1)
    letters = np.maximum(of[CAPITALS] + of[SMALL], 1)
    share = (
        of[SYMBOLS] / chars, of[CAPITALS] / letters, of[DIGITS] / chars, of[CALLS] / some, of[STOPS] / some, of[MARKS] / some, of[ENDS] / some,
        1 - different / np.maximum(lines, 1) * (lines > 0) - (lines == 0), kinds / some, top / some, 1 - windows / np.maximum(spans, 1) * (spans > 0) - (spans == 0),
        of[LEADS] / chars, np.bincount(w.doc, tail, n) / some, np.bincount(w.doc, lone, n) / some,
    )
    return np.column_stack([np.log1p(many), np.log1p(mean), spread / (mean + 1), np.log1p(longest), *(np.sqrt(np.maximum(x, 0)) for x in share)]).astype(np.float32)


def statistics_of(column: pa.Array) -> np.ndarray:
    """Statistics (texts x ``STATISTICS``) of a string column; a null text counts as empty."""
    parts = [_statistics(words) for _, _, words in chunks(column, lower=False)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.float32)


def document_statistics(docs: DataFrame, text: str = "text", into: str = "x") -> DataFrame:
    """All rows of ``docs`` without the text, plus its statistics as an array of floats; rows are independent, and a column ``into`` is replaced."""
    kept = [c for c in docs.columns if c not in (text, into)]
    own = fresh(docs, "__text")

    def run(batches):
        for batch in batches:
            x = statistics_of(batch.column(len(kept)))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[*kept, into])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias(own))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(trimmed(run), f"{fields}`{into}` array<float>")


class Features:
    """Standardised statistics through random cosines: products of two rows come near exp(-|x - y|^2 / (2 width^2))."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, size: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.size = mean, scale, size
        self.turn, self.phase = rng.normal(0, 1 / width, (len(mean), size)), rng.uniform(0, 2 * np.pi, size)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Rows of features, with a constant one last."""
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.column_stack([np.sqrt(2 / self.size) * np.cos(z @ self.turn + self.phase), np.ones(len(x))])


class Model:
    """Features, weights and the steps of the calibration (raw scores and probabilities, both ascending)."""

    def __init__(self, features: Features | None, weights: np.ndarray, raw: np.ndarray, probability: np.ndarray):
        self.features, self.weights, self.raw, self.probability = features, weights, raw, probability

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:  # nothing was learned, or one label only
            return np.full(len(x), self.probability[0])
        return np.interp(self.features.of(x) @ self.weights, self.raw, self.probability)


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)).flatten(), np.float64).reshape(batch.num_rows, -1)


def _sums(rows: DataFrame, features: Features) -> dict[int, np.ndarray]:
    """Normal equations by fold: one square matrix each of the products of (features, label).

    Partitions sum their own rows; sums are added in two rounds, so a task adds at most a 64th of the partitions' matrices
    before the last round of 64 matrices a fold. Only ``FOLDS`` matrices reach the driver."""
    side = features.size + 2
    shared = rows.sparkSession.sparkContext.broadcast(features)

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            made = np.column_stack([shared.value.of(_rows(batch, "x")), np.asarray(batch.column("y"), np.float64)])
            fold = np.asarray(batch.column("fold"))
            for f in np.unique(fold):
                part = made[fold == f]
                total[int(f)] = total.get(int(f), 0) + part.T @ part
        yield _matrices([(f, TaskContext.get().partitionId() % 64, m) for f, m in total.items()])

    def added(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for f, part, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total[f, part] = total.get((f, part), 0) + np.frombuffer(m).reshape(side, side)
        yield _matrices([(f, part, m) for (f, part), m in total.items()])

    schema = "fold int, part int, m binary"
    once = rows.mapInArrow(trimmed(products), schema)
    twice = once.repartition("fold", "part").mapInArrow(added, schema)
    last = twice.withColumn("part", F.lit(0)).repartition("fold").mapInArrow(added, schema)
    found = {r["fold"]: np.frombuffer(bytes(r["m"])).reshape(side, side) for r in last.collect()}
    shared.destroy()
    return found


def _matrices(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["fold", "part", "m"])


def solved(m: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from a matrix of products; the constant is not shrunk."""
    side = len(m) - 1
    shrink = np.full(side, ridge * m[side - 1, side - 1])
    shrink[-1] = 1e-9
    return np.linalg.solve(m[:side, :side] + np.diag(shrink), m[:side, side])


def error(m: np.ndarray, weights: np.ndarray) -> float:
    """Sum of squared errors of the rows behind a matrix of products."""
    full = np.append(weights, -1.0)
    return float(full @ m @ full)


def isotonic(at: np.ndarray, good: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares ascending fit of shares good / of at ascending places: centres of the pools and their shares."""
    pools: list[list[float]] = []
    for a, g, n in zip(at, good, of, strict=True):
        pools.append([a * n, g, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(rows: DataFrame, size: int = 160, seed: int = 13, ridges: tuple[float, ...] = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)) -> Model:
    """Learns from (key, x, y) rows: statistics and a label 0 or 1. All rows are read; the table is read four times, so it should be stored.

    Rows without statistics, or with another label, are left out; repeated rows count as often as they stand. Without rows
    every score is 0.5, with one label only it is that label. The driver gets moments, ``FOLDS`` matrices and counts by score."""
    rows = rows.filter(F.col("x").isNotNull() & F.col("y").isin(0, 1)).select("x", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))
    d = len(STATISTICS)
    moments = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *(F.avg(F.get("x", F.lit(i))).alias(f"a{i}") for i in range(d)), *(F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d))).first()
    if not moments["n"] or moments["y"] in (0.0, 1.0):
        return Model(None, np.zeros(0), np.zeros(1), np.array([0.5 if not moments["n"] else moments["y"]]))
    mean, scale = np.array([moments[f"a{i}"] for i in range(d)]), np.array([max(moments[f"s{i}"], 1e-3) for i in range(d)])
    features = Features(mean, scale, size, np.sqrt(d), seed)
    by_fold = _sums(rows, features)
    whole = sum(by_fold.values())
    # A fold that holds all rows has no others to learn from; it is judged by itself then.
    others = {f: whole - m if len(by_fold) > 1 else whole for f, m in by_fold.items()}
    ridge = min(ridges, key=lambda r: sum(error(m, solved(others[f], r)) for f, m in by_fold.items()))
    held = np.stack([solved(others[f], ridge) if f in others else np.zeros(size + 1) for f in range(FOLDS)])
    shared = rows.sparkSession.sparkContext.broadcast((features, held))

    def placed(batches):
        f, weights = shared.value
        for batch in batches:
            raw = (f.of(_rows(batch, "x")) * weights[np.asarray(batch.column("fold"))]).sum(axis=1)
            at = np.floor((np.clip(raw, LOW, HIGH) - LOW) / STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["at", "y"])

    counts = rows.mapInArrow(trimmed(placed), "at int, y int").groupBy("at").agg(F.sum("y").alias("good"), F.count("*").alias("of")).orderBy("at").collect()  # (HIGH - LOW) / STEP rows at most
    shared.destroy()
    at, good, of = (np.array([r[c] for r in counts], float) for c in ("at", "good", "of"))
    return Model(features, solved(whole, ridge), *isotonic(LOW + (at + 0.5) * STEP, good, of))


def score(rows: DataFrame, model: Model, least: float = 0.3, into: str = "score", decision: str = "predicted") -> DataFrame:
    """All rows with statistics ``x`` plus the probability of label 1, and 1 where it is ``least`` or more, else 0; ``x`` goes.

    Columns of these names are replaced. Statistics exist for every text, so empty ones have a score too."""
    kept = [c for c in rows.columns if c not in ("x", into, decision)]
    shared = rows.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches):
        for batch in batches:
            p = shared.value.score(_rows(batch, "x")) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p, pa.float64()), pa.array((p >= least).astype(np.int32))], names=[*kept, into, decision])

    rows = rows.select(*(F.col(f"`{c}`") for c in kept), "x")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(trimmed(run), f"{fields}`{into}` double, `{decision}` int")
