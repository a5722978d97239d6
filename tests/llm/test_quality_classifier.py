import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm.quality_classifier import FOLDS, STATISTICS, Features, _sums, document_statistics, error, fit, isotonic, score, solved, statistics_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS, MARKS = "#*$%&|<>@^~_=+\\{}[]/", ",;:'\"()-`"


def words_of(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(text):
    text = text or ""
    ws = words_of(text)
    n, some, chars = len(ws), max(len(ws), 1), max(len(text), 1)
    lengths = [len(w) for w in ws]
    mean = sum(lengths) / some
    spread = math.sqrt(max(sum(x * x for x in lengths) / some - mean**2, 0))
    letters = max(sum(c.isascii() and c.isalpha() for c in text), 1)
    lines = [tuple(words_of(x)) for x in text.split("\n")]
    lines = [x for x in lines if x]
    windows = [tuple(ws[i : i + 3]) for i in range(n - 2)]
    count = Counter(ws)
    tails = [w[-1] in SYMBOLS for w in ws]

    def of(letters_):
        return sum(c in letters_ for c in text)

    shares = [
        of(SYMBOLS) / chars, sum("A" <= c <= "Z" for c in text) / letters, of("0123456789") / chars, of("!?") / some, of(".") / some, of(MARKS) / some, of("\n") / some,
        1 - len(set(lines)) / len(lines) if lines else 0, len(count) / some, max(count.values(), default=0) / some, 1 - len(set(windows)) / len(windows) if windows else 0,
        sum(not c.isascii() for c in text) / chars, sum(tails) / some, sum(t and len(w) == 1 for t, w in zip(tails, ws, strict=True)) / some,
    ]
    return [math.log1p(n), math.log1p(mean), spread / (mean + 1), math.log1p(max(lengths, default=0)), *(math.sqrt(x) for x in shares)]


def test_statistics_equal_plain_ones(odd, odd_rows, empty):
    texts = [t for _, t in odd_rows] + ["a b\nc d\na b\n\na  b\n", "x\nx", "| a | b |", "é" * 9 + " É"]
    got = statistics_of(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-5)
    rows = document_statistics(odd.select("doc_id", "text", F.lit("kept").alias("x"), F.lit("own").alias("y")))
    assert rows.columns == ["doc_id", "y", "x"]
    assert sorted(repr((r["doc_id"], [round(v, 3) for v in r["x"]])) for r in rows.collect()) == sorted(repr((i, [round(float(v), 3) for v in x])) for (i, _), x in zip(odd_rows, got, strict=False))
    assert document_statistics(empty).count() == 0


def test_features_come_near_the_kernel():
    d = len(STATISTICS)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (40, d))
    made = Features(np.zeros(d), np.ones(d), 20_000, np.sqrt(d), 5).of(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(made @ made.T - np.exp(-distance / (2 * d))).max() < 0.05


def made_rows(spark, n=400, parts=7):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (n, len(STATISTICS)))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.4, n) > 0.3).astype(int)
    return x, y, spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)], "key long, x array<float>, y int").repartition(parts)


def test_partition_sums_give_the_dense_solution(spark):
    x, y, rows = made_rows(spark)
    features = Features(x.mean(axis=0), x.std(axis=0), 50, 4.0, 2)
    folded = rows.withColumn("fold", F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    sums = _sums(folded, features)
    fold = {r["key"]: r["fold"] for r in folded.select("key", "fold").collect()}
    z = features.of(x.astype(np.float32).astype(float))
    for f, m in sums.items():
        mine = np.array([fold[i] == f for i in range(len(x))])
        made = np.column_stack([z, y])[mine]
        assert np.allclose(m, made.T @ made)
    whole, ridge = sum(sums.values()), 1e-3
    shrink = np.diag([ridge * len(x)] * 50 + [1e-9])
    dense = np.linalg.solve(z.T @ z + shrink, z.T @ y)
    assert np.allclose(solved(whole, ridge), dense)
    assert np.isclose(error(whole, dense), ((z @ dense - y) ** 2).sum())


def test_isotonic_is_the_best_ascending_fit():
    rng = random.Random(6)
    for _ in range(50):
        of = [rng.randint(1, 5) for _ in range(6)]
        good = [rng.randint(0, n) for n in of]
        at, value = isotonic(np.arange(6.0), np.array(good, float), np.array(of, float))
        assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
        # By the max-min formula of isotonic regression.
        want = [max(min(sum(good[a:b]) / sum(of[a:b]) for b in range(i + 1, 7)) for a in range(i + 1)) for i in range(6)]
        assert np.allclose(sorted(set(np.round(want, 9))), np.round(value, 9))


def test_learning_and_odd_labels(spark):
    x, y, rows = made_rows(spark, 1200)
    learned = score(rows, fit(rows.filter("key % 3 > 0"))).collect()
    assert {r["predicted"] for r in learned} == {0, 1} and all(0 <= r["score"] <= 1 for r in learned)
    held = [(r["score"], r["y"]) for r in learned if r["key"] % 3 == 0]
    good, bad = [s for s, v in held if v], [s for s, v in held if not v]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.85
    # Calibrated: mean score near the share of the label.
    assert abs(np.mean([s for s, _ in held]) - np.mean([v for _, v in held])) < 0.06
    none = rows.filter("key < 0")
    assert {(r["score"], r["predicted"]) for r in score(rows, fit(none)).collect()} == {(0.5, 1)}
    assert {(r["score"], r["predicted"]) for r in score(rows, fit(rows.filter("y = 0"))).collect()} == {(0.0, 0)}
    assert {r["score"] for r in score(rows, fit(rows.filter("y = 1"))).collect()} == {1.0}
    same = rows.limit(1).withColumn("x", F.array(*(F.lit(0.5).cast("float") for _ in STATISTICS)))
    both = same.withColumn("y", F.lit(0)).unionByName(same.withColumn("y", F.lit(1))).unionByName(same.withColumn("y", F.lit(None).cast("int"))).unionByName(same.withColumn("x", F.lit(None).cast("array<float>")))
    assert abs(score(same, fit(both)).first()["score"] - 0.5) < 1e-6
    assert score(none, fit(rows)).count() == 0


def test_held_out_documents(spark):
    """The registered query on documents whose labels it hasn't seen."""
    from lodestone.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall())
    got = [r for r in QUERIES["op13_quality_classifier"](spark, folder).collect()]
    assert len(got) == 1000
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([p for _, p, y in held if y]) > 0.98


@pytest.mark.parametrize("text", ["x" * 2_000_000, "a " * 600_000, "\n" * 500_000])
def test_very_long_texts(text):
    assert np.isfinite(statistics_of(pa.array([text, None, "short one"], pa.string()))).all()
