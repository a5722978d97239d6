import random
import string

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402

from lodestone.llm._common import stash  # noqa: E402
from lodestone.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = stash(stage(spark, docs, SF), "stage")
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.select("doc_id").distinct().count() == n
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


def test_odd_tables_pass_the_stages(spark, odd, empty):
    for table in (odd, empty):
        for _, stage in pipeline.STAGES[:4]:
            assert stage(spark, table, SF).columns == table.columns
            assert stage(spark, table, SF).count() <= table.count()
        assert pipeline.packed(spark, table, SF).select("doc_id").distinct().count() == table.select("doc_id").distinct().count()


def test_one_of_each_group_stays(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = pipeline.near_copies(spark, docs, SF).collect()
    texts = [r["text"].lower() for r in kept if r["text"] and r["text"].split()]
    assert len(texts) == len(set(texts)) and 0 in {r["doc_id"] for r in kept} and not {3, 6, 9} & {r["doc_id"] for r in kept if r["text"] and r["text"].startswith("w")}


def test_language_stage_goes_by_the_prediction(spark):
    rng = random.Random(7)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("size(split(text, ' ')) >= 50").select("doc_id", "text", "lang", "source", "n_chars")
    junk = [" ".join("".join(rng.choices(string.ascii_letters + string.digits + "+/", k=rng.randint(8, 60))) for _ in range(60)) for _ in range(10)]
    junk += [" ".join("".join(rng.choices("0123456789abcdef", k=16)) for _ in range(60)) for _ in range(10)]
    more = docs.unionByName(spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(junk)], docs.schema))
    kept = {r["doc_id"] for r in pipeline.language(spark, more, SF).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}
    bare = more.withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame([(-1, "12 34", None, "s", 5), (-2, None, None, "s", 0)], docs.schema))
    assert {r["doc_id"] for r in pipeline.language(spark, bare, SF).collect()} == {r["doc_id"] for r in more.collect()}


# A plain pipeline over a small table with columns that clash ---------------------------------------

CLASH = ("quality", "kept", "place", "place2", "nth", "n_words", "__w", "__lines", "carried", "lang_pred", "score", "component_id")
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_votes(text):
    ws = words_of(text)
    n, chars = max(1, len(ws)), sum(map(len, ws))
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    again = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else set()
    covered = {i + k for i, g in enumerate(grams) if g in again for k in range(3)}
    count = lambda letters: sum((text or "").count(c) for c in letters)
    below = lambda x, good, bad: 0 if x > bad else 1 if x <= good else None
    length, dups = chars / n, len(lines) - len(set(lines))
    long_ = len(ws) >= 50
    stops = count(".")
    votes = (
        below(count("#*$%&|<>") / n, 0.05, 0.15), below(len(covered) / n, 0.12, 0.3), 0 if dups > 0.25 * len(lines) else 1 if dups == 0 else None, below(count(string.ascii_uppercase) / max(1, chars), 0.1, 0.35), below(count("!?") / n, 0.05, 0.25),
        0 if length < 2 or length > 14 else 1 if 3 <= length <= 9 else None, 0 if long_ and stops == 0 else 1 if long_ and 0.005 <= stops / n <= 0.3 else None, 0 if len(set(ws)) / n < 0.1 else 1 if len(set(ws)) / n > 0.25 else None,
    )
    return votes, len(ws) < 50 or 100 * len(covered) > 50 * len(ws)


def plain_quality(rows):
    from collections import Counter

    from lodestone.llm.quality_rules import expect

    voted = [plain_votes(r["text"]) for r in rows]
    found = expect(sorted(Counter(v for v, _ in voted).items(), key=str), 8)
    return [r for r, (v, failed) in zip(rows, voted, strict=True) if not failed and found.quality(v) >= 0.5]


def plain_near(rows):
    def shingles(text):
        ws = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = [shingles(r["text"]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            best.setdefault(root(i), []).append(r)
    blank = {(r["doc_id"], r["text"]): r for r, s in zip(rows, sets, strict=True) if not s}
    return [min(rs, key=lambda r: r["doc_id"]) for rs in best.values()] + list(blank.values())


def plain_passages(rows, k=35):
    from collections import Counter

    texts = [words_of(r["text"]) for r in rows]
    starts = Counter(tuple(ws[i : i + k]) for ws in texts for i in range(len(ws) - k + 1))
    out = []
    for r, ws in zip(rows, texts, strict=True):
        gone = {i + j for i in range(len(ws) - k + 1) if starts[tuple(ws[i : i + k])] > 1 for j in range(k)}
        left = " ".join(w for i, w in enumerate(ws) if i not in gone)
        if left:
            text = left if gone else r["text"]
            out.append({**r, "text": text, "n_chars": len(text)})
    return out


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.08 else "") for _ in range(n))
    passage = sentence(50)
    texts = [sentence(rng.randint(60, 160)) for _ in range(28)]
    texts += [t + " " + sentence(3) for t in texts[:6]] + texts[6:10] + [t.upper() for t in texts[10:12]]  # near and exact copies, capitals
    texts += [sentence(40) + "\n" + passage + " " + sentence(40) for _ in range(4)] + [passage]
    texts += [sentence(70).replace(" ", " ### "), "buy now !!! " * 40, sentence(20), "", None, "12 34 " * 60, "same line here\n" * 30, " | ".join(vocabulary[:80]), sentence(3000)]
    rows = [{"doc_id": 3 * i + 1, "text": t, "lang": None, "source": f"s{i % 2}", "n_chars": len(t or "")} | {c: f"{c}{i}" for c in CLASH} for i, t in enumerate(texts)]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(4)


def test_stages_equal_plain_ones_whatever_the_columns(spark, clashing):
    rows, docs = clashing
    plain = {"quality rules": plain_quality, "language id": lambda rs: [r for r in rs if any(c.isalpha() for c in r["text"] or "")], "near copies": plain_near, "repeated passages": plain_passages}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, stage in pipeline.STAGES[:4]:
        docs = stash(stage(spark, docs, SF), "stage")
        left = plain[name](rows)
        assert 0 < len(left) < len(rows) or name == "language id"
        rows = left
        assert docs.columns == list(rows[0])
        assert sorted(map(repr, (r.asDict() for r in docs.collect()))) == sorted(map(repr, rows)), name
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    from tokenizers import Tokenizer

    from lodestone.llm.queries import vocabulary as path

    made = pipeline.packed(spark, docs, SF).collect()
    tokens = {r["doc_id"]: len(Tokenizer.from_file(path("byte_bpe_50k.json")).encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows}
    for key, n in tokens.items():
        pieces = sorted((r["piece"], r["start"], r["length"]) for r in made if r["doc_id"] == key)
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == n and all(p[1] == sum(q[2] for q in pieces[: p[0]]) for p in pieces)
    for sequence in {r["sequence_id"] for r in made}:
        inside = sorted((r["offset"], r["length"]) for r in made if r["sequence_id"] == sequence)
        assert all(at == sum(n for _, n in inside[:i]) for i, (at, _) in enumerate(inside)) and sum(n for _, n in inside) <= 1024


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("op11_")))
def test_queries_return_all_rows(spark, name):
    table, key = ("pages", "page_id") if name.startswith("op1_") else ("documents", "doc_id")
    df = QUERIES[name](spark, SF)
    assert df.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
