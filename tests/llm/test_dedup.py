import random
from collections import Counter, defaultdict

import pytest

from lodestone.llm.jaccard_join import components, near_duplicates
from lodestone.llm.substring_dedup import Automaton, spans_of, substring_dedup


def split(text):
    return (text or "").encode().split()


def brute_dedup(texts, k=35):
    seen = Counter()
    for t in texts:
        w = split(t)
        seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for t in texts:
        w = split(t)
        drop = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                drop[i : i + k] = [True] * k
        out.append((len(w), sum(drop), b" ".join(x for x, d in zip(w, drop, strict=True) if not d).decode()))
    return out


@pytest.mark.parametrize(("length", "grain", "room"), [(35, 12, 1 << 16), (35, 12, 0), (7, 3, 40), (7, 3, 1 << 16)])
def test_dedup_equals_brute_force(corpus, length, grain, room):
    rows = corpus.orderBy("doc_id").collect()
    got = substring_dedup(corpus, length=length, grain=grain, room=room).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in got] == brute_dedup([r["text"] for r in rows], length)


def test_dedup_of_long_repetitions(spark):
    """Texts that repeat one word or line far beyond a piece, and the same stretch elsewhere."""
    texts = ["a " * 1500, "b a " * 700, "x " + "c d e f " * 90, "c d e f " * 8 + "c d e", "lone " + " ".join(f"w{i}" for i in range(900)), "y " + " ".join(f"w{i}" for i in range(300, 700))]
    for room in (1 << 16, 600):
        got = substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), room=room).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in got] == brute_dedup(texts)


def test_dedup_of_odd_rows(odd, odd_rows, empty):
    got = substring_dedup(odd)
    assert got.columns == [*(c for c in odd.columns if c != "n_words"), "n_words", "n_removed", "kept_text"]
    want = sorted(map(repr, ((i, *b) for (i, _), b in zip(odd_rows, brute_dedup([t for _, t in odd_rows]), strict=True))))
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"])) for r in got.collect()) == want
    assert substring_dedup(empty).count() == 0


def test_automaton_counts_repeats():
    rng = random.Random(2)
    for _ in range(200):
        seqs = [[rng.randrange(3) for _ in range(rng.randint(0, 9))] for _ in range(3)]
        a = Automaton()
        for s in seqs:
            a.add(s, 1)
        a.close()
        k = rng.randint(1, 4)
        seen = Counter(tuple(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1))
        for s in seqs:
            assert list(a.matches(s, k)) == [i + k for i in range(len(s) - k + 1) if seen[tuple(s[i : i + k])] > 1]


def test_spans_join_up():
    assert list(spans_of([5, 6, 8, 20], 3)) == [(2, 8), (17, 20)]


def brute_components(texts, keys, k=5):
    sets = []
    for t in texts:
        w = [x.lower() for x in split(t)]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(sets)):
        least[find(i)].append(keys[i])
    return [(keys[i], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i in range(len(sets))]


def test_join_equals_brute_force(corpus):
    rows = corpus.orderBy("doc_id").collect()
    got = near_duplicates(corpus).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == brute_components([r["text"] for r in rows], [r["doc_id"] for r in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_join_of_a_large_group_of_near_copies(spark, seed):
    """Variants of few originals around the bar, with edits that many share, a common line and copies: links, non-links and chains."""
    rng = random.Random(seed)
    texts = []
    for _ in range(3):
        original = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([90, 200, 400]))]
        for _ in range(70):
            w = list(original)
            for _ in range(rng.randrange(1, 2 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(6)}"
            if rng.random() < 0.2:
                w = w[: rng.randrange(len(w) // 2, len(w))]
            texts.append(" ".join(w))
    line = " ".join(f"c{i}" for i in range(12))
    texts += [f"{line} " + " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([2, 5, 40]))) for _ in range(150)]
    texts += [rng.choice(texts) for _ in range(40)]
    keys = list(range(len(texts)))
    got = near_duplicates(spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string").repartition(4)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts, keys)


def test_join_takes_keys_of_other_types(spark, corpus):
    got = near_duplicates(corpus.selectExpr("lpad(doc_id, 6, '0') AS name", "text AS body"), "name", "body")
    want = {r["doc_id"]: r["component_id"] for r in near_duplicates(corpus).collect()}
    assert {int(r["name"]): int(r["component_id"]) for r in got.collect()} == want


def test_join_of_odd_rows(odd, odd_rows, empty):
    got = sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in near_duplicates(odd).collect())
    assert got == sorted(map(repr, brute_components([t for _, t in odd_rows], [i for i, _ in odd_rows])))
    assert near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3}
