"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams, of 1 to ``order`` bytes, that both
hold (presence, blended spectrum, A-Z lower-cased), over the square root of the product of
their own numbers. n-grams of three bytes and more share ``bits`` hashed places. Nyström
landmarks give an explicit feature map, on which one ridge regression per language is
fitted, one versus the rest. As the kernel is linear in presence, landmarks and weights
multiply into one matrix (places x languages), and a batch of texts is scored by one
product of its sparse presence matrix with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import fresh, trimmed
from lodestone.llm._words import documents

LETTER = regex.compile(r"\p{L}").search
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Presence:
    """Places of the n-grams of a text: 256 for single bytes, 65,536 for pairs, 2 ** bits for longer ones."""

    def __init__(self, order: int = 4, bits: int = 16):
        self.order, self.bits = order, bits
        self.size = 256 + (1 << 16) + ((1 << bits) if order > 2 else 0)
        self.seen = np.zeros(self.size, bool)

    def of(self, data: np.ndarray) -> np.ndarray:
        code = _LOWER[data].astype(np.uint32)
        self.seen[code] = True
        base = 256
        for n in range(2, min(self.order, len(code)) + 1):
            if n == 2:
                gram = code[:-1] << np.uint32(8) | code[1:]
                self.seen[base + gram.astype(np.int64)] = True
                base += 1 << 16
            else:
                gram = gram[:-1] * np.uint32(0x01000193) ^ code[n - 1 :]
                mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                self.seen[base + (mixed >> np.uint32(32 - self.bits)).astype(np.int64)] = True
        at = np.flatnonzero(self.seen)
        self.seen[at] = False
        return at


def _sampled(rows: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, by a hash of the key: the same rows on every run."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("of"))
    share = F.lit(float(per_language)) / F.col("of")
    return rows.join(F.broadcast(counts), "lang").filter((F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share).select("key", "text", "lang")


class Model:
    """languages, and ``weights``: float32 (places x languages)."""

    def __init__(self, languages: list[str], weights: np.ndarray, order: int, bits: int):
        self.languages, self.weights, self.order, self.bits = languages, weights, order, bits

    def score(self, column: pa.Array) -> np.ndarray:
        """Regression values (texts x languages), by one sparse product for the batch."""
        presence = Presence(self.order, self.bits)
        data, bounds = documents(column)
        at = [presence.of(data[bounds[i] : bounds[i + 1]]) for i in range(len(column))]
        n = np.array([len(x) for x in at])
        out = np.zeros((len(at), len(self.languages)))
        some = n > 0
        if some.any():
            flat = np.concatenate(at)
            out[some] = np.add.reduceat(self.weights[flat].astype(np.float64), (np.cumsum(n) - n)[some], axis=0)
            out[some] /= np.sqrt(n[some])[:, None]
        return out


def fit(rows: DataFrame, per_language: int = 400, landmarks: int = 40, order: int = 4, bits: int = 16, ridge: float = 0.05, room: int = 512 << 20) -> Model:
    """Learns from (key, text, lang) rows with a language.

    About ``per_language`` texts of each language are sampled, and up to ``landmarks`` of them are its landmarks. With many languages
    both shrink so that the sample's bits, the landmarks and the weights take ``room`` bytes each at most: the more languages there are,
    the fewer texts stand for each. Languages whose weights alone would take more (1,022 by default) are refused
    and never dropped in silence. Repeated rows have the same key and are sampled alike; without rows the model knows no language."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("key", "text", "lang")
    places = Presence(order, bits).size
    most = max(1, room // (4 * places))
    known = rows.select("lang").distinct().limit(most + 1).count()
    if known > most:
        raise ValueError(f"more than {most} languages take more than {room} bytes; raise room")
    per_language = max(1, min(per_language, room // (max(1, known) * (places // 8 + 1))))
    landmarks = max(1, min(landmarks, room // (4 * places * max(1, known))))

    def bits_of(batches):
        presence = Presence(order, bits)
        for batch in batches:
            data, bounds = documents(batch.column(1))
            made = []
            for i in range(batch.num_rows):
                row = np.zeros(presence.size, bool)
                row[presence.of(data[bounds[i] : bounds[i + 1]])] = True
                made.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["key", "lang", "bits"])

    kind = dict(rows.dtypes)["key"]
    sample = sorted(_sampled(rows, per_language).mapInArrow(trimmed(bits_of), f"key {kind}, lang string, bits binary").collect(), key=lambda r: (str(r["lang"]), str(r["key"]), bytes(r["bits"])))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return Model([], np.zeros((Presence(order, bits).size, 0), np.float32), order, bits)
    size = Presence(order, bits).size
    unpack = lambda r: np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=size).astype(np.float32)
    taken, per = [], dict.fromkeys(languages, 0)
    for i, r in enumerate(sample):
        if per[r["lang"]] < landmarks:
            per[r["lang"]] += 1
            taken.append(i)
    marks = np.stack([unpack(sample[i]) for i in taken])
    marks /= np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]
    kernel = np.empty((len(sample), len(taken)))
    for at in range(0, len(sample), 64):
        block = np.stack([unpack(r) for r in sample[at : at + 64]])
        kernel[at : at + 64] = block @ marks.T / np.sqrt(np.maximum(block.sum(axis=1), 1))[:, None]
    own = kernel[taken]
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-6 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    features = np.hstack([kernel @ half])
    target = np.where(np.array([[r["lang"] == x for x in languages] for r in sample]), 1.0, -1.0)
    # Every language has the same say, however few of its rows there are.
    share = {x: max(1, sum(r["lang"] == x for r in sample)) for x in languages}
    weight = np.sqrt(np.array([1.0 / share[r["lang"]] for r in sample]))[:, None]
    a, b = features * weight, target * weight
    solved = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]) / max(1, len(sample)) * len(languages), a.T @ b)
    return Model(languages, (marks.T @ (half @ solved).astype(np.float32)).astype(np.float32), order, bits)


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows of ``docs`` plus the predicted language and its score (0 to 1).

    A null text, or one without a letter, is ``und`` with score 0; so is every text where
    nothing was learned. Rows are independent; columns of these names are replaced."""
    docs = docs.drop(pred, score)
    own = fresh(docs, "__text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # places x languages: bounded by the model's parameters

    def run(batches):
        m = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(own)
            column = batch.column(at)
            labels, scores = [], []
            for lo in range(0, batch.num_rows, 256):
                part = column.slice(lo, 256)
                values = m.score(part)
                for t, v in zip(part.to_pylist(), values, strict=True):
                    if not m.languages or not t or not LETTER(t):
                        labels.append("und"), scores.append(0.0)
                        continue
                    best = int(np.argmax(v))
                    e = np.exp(np.clip(3 * (v - v[best]), -50, 0))
                    labels.append(m.languages[best]), scores.append(float(1 / e.sum()))
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*(batch.schema.names[i] for i in kept), pred, score])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return docs.withColumn(own, F.col(text)).mapInArrow(trimmed(run), f"{fields}`{pred}` string, `{score}` double")
