import random
import zlib
from collections import Counter

import pytest
import regex

from lodestone.llm.spelling import Index, corpus_words, links, near_words, spelling_variants, with_roots

RUN = regex.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_words(rows):
    count = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    out, form = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = [n, len(near), form[w], words[form[w]] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def variants(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def made_up(seed, size, letters="abcé", length=(7, 10)):
    rng = random.Random(seed)
    found = {"".join(rng.choice(letters) for _ in range(rng.randint(*length))) for _ in range(size)}
    for w in list(found):
        i = rng.randrange(len(w))
        found |= {w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "z" + w[i + 1 :]}
    return {w: rng.choice([2, 3, 21, 30, 250, 4000]) for w in found if len(w) >= 7}


@pytest.mark.parametrize(("most", "few"), [(512, 1 << 18), (6, 1 << 18), (3, 0)])
def test_every_pair_is_found_once(spark, monkeypatch, most, few):
    """Also where groups are split to the last letters, and where their keys are too many to broadcast."""
    import lodestone.llm.spelling as spelling

    whole = spelling.groups
    monkeypatch.setattr(spelling, "groups", lambda words, m: whole(words, m, few))
    words = made_up(most, 150)
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert variants(with_roots(near_words(table, most))) == plain_variants(words)


def test_a_crowd_under_one_half(spark):
    """All words share their second half, and most of the first; chains of forms lead over several steps."""
    words = {a + b + c + "xxxxxxxxxx": 2 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    words |= {"aaa" + "xxxxxxxxxx": 20, "aab" + "xxxxxxxxxx": 200, "abb" + "xxxxxxxxxx": 2000, "bbb" + "xxxxxxxxxx": 20_000}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = variants(with_roots(near_words(table, 16)))
    assert got == plain_variants(words)
    assert got["aaaxxxxxxxxxx"][4] == "bbbxxxxxxxxxx"


def test_index_keeps_what_one_edit_allows():
    rng = random.Random(4)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 6))) for _ in range(60)]
    members = [(w, 2) for w in sorted(set(pool))]
    found = {tuple(sorted((members[i][0], members[j][0]))) for i, j in links(members, 6, 0, 0)}
    want = {tuple(sorted((a, b))) for a, _ in members for b, _ in members if one_edit(a, b) and 6 in (len(a), len(b))}
    assert found == want
    index = Index()
    index.add(0, 4, ["\x00a", "ab", "bc", "cd", "d\x01"])
    assert index.candidates(["\x00a", "ab", "bx", "xd", "d\x01"], 4, False) == [0]
    assert index.candidates(["\x00x", "xb", "bx", "xd", "d\x01"], 4, False) == []


def test_very_long_words(spark):
    long = "ab" * 60_000
    words = {long: 2, long[:-1]: 30, long[:70_000] + "z" + long[70_001:]: 400, "z" + long: 2}
    got = variants(with_roots(near_words(spark.createDataFrame(list(words.items()), "word string, n long"))))
    assert {w: x[1] for w, x in got.items()} == {long: 3, long[:-1]: 1, long[:70_000] + "z" + long[70_001:]: 1, "z" + long: 1}
    assert got[long][4] == long[:70_000] + "z" + long[70_001:]


def test_odd_rows(odd, odd_rows, spark, empty):
    texts = ["Wonderful wonderful WONDERFUL wonderfull", "wonderfull straße Ünderung Ünderung ünderung", "Àÿabcde x×÷abcdef Āabcdefg"] * 3
    rows = odd_rows + [(900 + i, t) for i, t in enumerate(texts)]
    whole = odd.select("doc_id", "text", "word", "n") if "word" in odd.columns else odd.select("doc_id", "text", "n")
    more = spark.createDataFrame([(i, t, "n") for i, t in rows[len(odd_rows) :]], "doc_id long, text string, n string")
    got = variants(spelling_variants(whole.select("doc_id", "text", "n").unionByName(more)))
    assert got == plain_variants(plain_words(rows))
    assert got
    assert spelling_variants(empty).count() == 0
    assert corpus_words(empty).count() == 0


def test_deletions_by_checksum(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["Understanding", "knowledge", "Éducation", "abcdefg", "abcdefgh"]) for _ in range(20))) for i in range(300)]
    rows.append((None, "knowledge abcdefgh"))
    got = {r["word"]: r["n"] for r in corpus_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_words(rows)
    assert len(got) > 5
