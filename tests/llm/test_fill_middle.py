import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm.fill_middle import Splitter, fill_in_middle, restored

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text, percent=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(tokens[a:b]) for a, b in ((0, one), (one, two), (two, n)))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made(df):
    return sorted(repr((r["doc_id"], r["text"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]))) for r in df.collect())


@pytest.mark.parametrize("percent", [50, 100])
def test_odd_rows(odd, odd_rows, empty, percent):
    got = fill_in_middle(odd, percent=percent)
    assert made(got) == sorted(repr((i, t, plain(i, t, percent))) for i, t in odd_rows)
    assert {"row", "tag", "kind", "score"} <= set(got.columns)
    assert fill_in_middle(empty).count() == 0


def test_texts_that_look_like_sentinels(spark):
    rng = random.Random(2)
    parts = ["<P", "<S", "<M", ">", "P>", "S>", "<", " ", "\n", "é", "🙂", "x ", "<P>", "\x00", "\x85"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_in_middle(docs, percent=100)
    assert made(got) == sorted(repr((i, t, plain(i, t, 100))) for i, t in rows)
    back = got.withColumn("back", restored(F.col("form"), F.col("output")))
    assert back.filter(~F.col("back").eqNullSafe(F.col("text"))).count() == 0
    assert {r["form"] for r in got.select("form").distinct().collect()} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("stretch", [1, 3, 7, 50])
def test_stretches_cut_no_token(stretch):
    rng = random.Random(stretch)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "漢", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "bb"]) for _ in range(rng.randint(0, 40)))
        assert Splitter().ends(text, stretch).tolist() == [m.end() for m in TOKEN.finditer(text)]


def test_very_long_texts():
    for text in ("a" * 3_000_000, " " * 2_000_000, "ab " * 700_000 + "\n" * 400_000):
        assert Splitter().ends(text).tolist() == [m.end() for m in TOKEN.finditer(text)]


def test_sentinels_of_ones_own(spark):
    docs = spark.createDataFrame([(i, "one two three four") for i in range(40)], "doc_id long, text string")
    own = ("‹pre›", "‹suf›", "‹mid›")
    got = fill_in_middle(docs, percent=100, sentinels=own)
    assert got.filter(restored(F.col("form"), F.col("output"), own) == F.col("text")).count() == 40
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<S<", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_in_middle(docs, sentinels=bad)
