"""CodeBLEU hangs on which names and literals are equal: pairs that agree in this are scored once, and spelled texts are not broadcast."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import syntax
from lodestone.operators.codebleu import codebleu
from lodestone.plans import record_queries

SF = "/root/testdata/sf0.001"
PAIRS = [
    ("int a = 1; go(a);", "int a = 1; go(a);"),
    ("int bb = 2; /* b */ run( bb );", "int bb = 2; run(bb);"),  # as the first
    ("int a = 1; go(a);", "int a = 2; go(a);"),  # another literal
    ("int a = 1; go(a);", "int b = 1; go(b);"),  # another name
    ("# x;", "# x;"),
    ("\x01 x;", "# x;"),
    ("// none", "int a = 1;"),
    (None, "a;"),
    ("// none", "/* none */"),
]


def test_tokens_are_told_by_places():
    names, literals = {}, {}
    assert syntax.told_tokens("class A { A b = .5; } // A", names, literals) == "class\x01x1_\x01{\x01x1_\x01x2_\x01=\x0101_\x01;\x01}"
    assert syntax.told_tokens("b = \"\" + .5 / '\x01' # \x01;", names, literals) == "x2_\x01=\x0102_\x01+\x0101_\x01/\x0103_\x01#\x01#1\x01;"
    assert names == {"A": 1, "b": 2} and list(literals) == [".5", '""', "'\x01'"]


@pytest.mark.parametrize("crowd", [0, 1, 1 << 10])  # all broadcast, both ways, none
def test_alike_pairs_are_scored_once(spark, monkeypatch, crowd):
    seen, whole = [], syntax._tree
    monkeypatch.setattr(syntax, "_tree", lambda tokens: seen.append(tokens) or whole(tokens))
    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "id int, generated string, ground_truth string")
    got = {r["id"]: r for r in codebleu(pairs, "id", crowd=crowd).collect()}
    assert [x.select("file").distinct().count() for x in seen] == [4]  # of 13 texts with tokens
    assert sorted(got) == list(range(len(PAIRS))) and got[0][1:] == got[1][1:] == (1.0,) * 5
    assert got[2]["ngram"] < 1 and got[2]["syntax"] == 1.0 and got[3]["ngram"] < got[2]["ngram"] and got[3]["dataflow"] == 1.0
    assert got[5]["ngram"] < got[4]["ngram"] and got[6]["ngram"] == got[6]["syntax"] == got[6]["dataflow"] == 0.0 and got[7][1:] == got[8][1:] == (None,) * 5


def test_spelled_texts_are_not_broadcast(spark, monkeypatch):
    seen, whole = [], record_queries.codebleu
    monkeypatch.setattr(record_queries, "codebleu", lambda pairs, *a: seen.append(pairs) or whole(pairs.filter("path < 3"), *a))
    assert record_queries.codebleu_pairs(spark, SF).count() == 3
    assert "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString() and seen[0].agg(F.count_if(F.col("generated") == F.col("ground_truth"))).first()[0] == 0
