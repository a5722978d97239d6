import random

import pytest

#: Names that operators use inside, or give to results.
CLASHES = ("row", "tag", "key", "class", "n", "h", "x", "start", "kind", "n_words", "host", "path", "score", "__text", "fingerprint", "label")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def base_texts():
    rng = random.Random(11)
    passage = words(rng, 45)
    a = words(rng, 120)
    near = a.split(" ")
    near[60] = "changed"
    return [
        a, a, " ".join(near), a.upper(), words(rng, 30) + "\n" + passage + " " + words(rng, 30), words(rng, 20) + "  " + passage + "\t" + words(rng, 25), passage,
        "", None, " \n\t ", "x", "one two three", "one two three", "Été à la plage: où est-ce? ▁▁ 漢字 🙂🙂", "<|endoftext|> a <|endoftext|>", "abab " * 80, "\u00a0\u2003 a\x1cb\x85c",
        "z" * 5000, words(rng, 3000), "Licensed under CC BY 4.0.\nAll rights reserved. GNU General Public License, version 3; cc by cc-by", "!!! ### $$$ %%% " * 30,
    ]


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, repeats, ties, empty, short, very long and odd texts."""
    rows = [(i * 3, t) for i, t in enumerate(base_texts())]
    return [*rows, (0, rows[0][1]), (3, "other text of a key that repeats"), (None, None), (None, "no key but words"), (None, rows[0][1])]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    full = [(i, t, "en" if (i or 0) % 2 else None, None, None, *CLASHES) for i, t in odd_rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def plain(spark):
    """Unique keys, all the same texts."""
    return spark.createDataFrame([(i, t, "en", "s", 0, *CLASHES) for i, t in enumerate(base_texts())], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """A larger made-up corpus with copies, near copies, shared passages and repetition."""
    rng = random.Random(5)
    texts = [words(rng, rng.choice([3, 20, 60, 150, 300]), 3000) for _ in range(120)]
    shared = [words(rng, 50, 3000) for _ in range(3)]
    for i in range(60):
        w = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(shared).split(" ")
        texts.append(" ".join(w))
    texts += ["a b c " * 40, "a b " * 60, "q " * 90]
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
