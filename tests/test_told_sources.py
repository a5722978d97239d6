"""Sources are told in one pass over their text, and methods meet their siblings in one pass over the methods."""

from pyspark.sql import functions as F

from lodestone.operators import dataset, syntax

TEXTS = ["class A { int x1_ = .5 + 1e+5; } // {", "/* { */ \x0b\x1c\xa0 é² Ⅷb ǅ 𝔘x { '}' \"\\ \" \"\"\"}\"\"\" / /= }", "\x01 # \" ' \\", "", "record R(int a) { } // no \r end {\n}"]


def test_told_as_the_lexer_cuts(spark):
    tokens = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "path int, text string").select("path", syntax._cut("text").alias("all")).withColumn("seen", F.filter("all", lambda t: ~t.rlike(syntax.SPACE)))
    for r in tokens.select("path", "all", "seen", F.filter("seen", lambda t: t.rlike(r"^[\p{L}_$]") & ~t.isin(*syntax._WORDS)).alias("own")).collect():
        kinds, names, braces = syntax.told_source(TEXTS[r["path"]])
        assert names == list(dict.fromkeys(r["own"])) and len(kinds.split("\x01") if kinds else []) == len(r["seen"])
        assert braces == [sum(map(len, r["all"][:i])) for i, t in enumerate(r["all"]) if t in ("{", "}")]
    assert syntax.told_source("class A { A b = 1; }") == ("class\x01X1_\x01{\x01X1_\x01x2_\x01=\x010\x01;\x01}", ["A", "b"], [8, 19])


def test_siblings_take_one_pass(spark):
    rows = spark.createDataFrame([("A", 2, "y"), ("A", 1, "x"), ("B", 1, "z"), (None, 1, "n"), ("A", 3, "w")], "t string, ord int, name string")
    made = dataset.siblings(rows, "t", "ord", ["name"])
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["t"], r["name"]): [s["name"] for s in r["siblings"]] for r in made.collect()}
    assert got == {("A", "x"): ["y", "w"], ("A", "y"): ["x", "w"], ("A", "w"): ["x", "y"], ("B", "z"): []}


def test_bodies_are_dealt_before_they_are_put_in(spark, monkeypatch):
    seen, whole = [], syntax.extract
    monkeypatch.setattr(syntax, "extract", lambda sources, *a, **k: seen.append(sources) or whole(sources, *a, **k))
    bodies = spark.createDataFrame([(1, "class A { void m() { } }", 19, 21, " go(); "), (2, "class A { }", 8, 90, ""), (3, None, 0, 1, "")], "index int, fileContent string, bodyStartOffset int, bodyEndOffset int, generatedBody string")
    got = {r["index"]: ([i["signature"] for i in r["invocations"]], r["error"]) for r in syntax.calls_in_place(bodies.repartition(3)).collect()}
    assert got == {1: (["UNRESOLVED<go>"], None), 2: ([], "offsets outside the file"), 3: ([], "no file content")}
    assert "Filter" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
