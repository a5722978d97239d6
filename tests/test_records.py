"""Records that are replaced by key, streams that go on, explanations, CodeBLEU, words, coverage by path."""

import json
import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import analysis, dataset, plugins, prompt, retrieval, scoring
from lodestone.operators.codebleu import codebleu
from lodestone.plans.queries import QUERIES
from lodestone.sources import sinks
from lodestone.streaming import progress

SF = "/root/testdata/sf0.001"


# One row a key -----------------------------------------------------------------------------------


def test_rows_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k long, j string, v int, at int"
    rng = random.Random(1)
    held = {}
    for turn in range(6):
        batch = [(rng.choice([None, *range(30)]), rng.choice("ab"), rng.randrange(99), rng.randrange(5)) for _ in range(rng.choice([0, 1, 25]))]
        if turn == 0:
            batch += [(i, "a", 0, 0) for i in range(30)]
        df = spark.createDataFrame(batch, schema).repartition(3)
        for _ in range(2):  # a replay leaves the same table
            sinks.replace_rows(df, path, ["k", "j"], order="at", buckets=4)
        for key in {r[:2] for r in batch}:
            last = max(r[3] for r in batch if r[:2] == key)
            held[key] = {r for r in batch if r[:2] == key and r[3] == last}
        got = [tuple(r) for r in sinks.read_replaced(spark, path).select("k", "j", "v", "at").collect()]
        assert sorted(map(repr, (r[:2] for r in got))) == sorted(map(repr, held))
        assert all(r in held[r[:2]] for r in got)
    with pytest.raises(ValueError, match="buckets"):
        sinks.replace_rows(spark.createDataFrame([(1, "a", 1, 1)], schema), path, ["k", "j"], buckets=5)


def test_half_a_batch_written_is_mended_by_its_replay(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(40).select("id", F.lit("old").alias("v"))
    sinks.replace_rows(df, path, ["id"], buckets=4)
    new = df.withColumn("v", F.lit("new"))
    # Two of the four folders have the new rows, as after a loss in the middle of the commit.
    bucket = F.pmod(F.xxhash64("id"), F.lit(4)).cast("int")
    new.withColumn("bucket_of_4", bucket).filter("bucket_of_4 < 2").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_of_4").parquet(path)
    assert {r["v"] for r in sinks.read_replaced(spark, path).collect()} == {"old", "new"}
    sinks.replace_rows(new, path, ["id"], buckets=4)
    assert [(r["id"], r["v"]) for r in sinks.read_replaced(spark, path).orderBy("id").collect()] == [(i, "new") for i in range(40)]


def test_rerun_of_broken_rows(spark):
    samples = spark.createDataFrame([(i, f"m{i}", "old") for i in range(10)], "id int, name string, text string").repartition(3)
    broken = spark.createDataFrame([(2,), (2,), (5,), (77,)], "id int")

    def step(batch):
        if (batch["id"] == 5).any():
            raise RuntimeError("no answer")
        return batch.assign(text="new")

    made, failed = plugins.rerun(samples.repartition(10, "id"), broken, ["id"], step, "text string")
    assert [tuple(r) for r in made.collect()] == [(2, "m2", "new")] and made.columns == samples.columns
    assert [(r["id"], "no answer" in r["step_error"]) for r in failed.collect()] == [(5, True)]


def test_generation_step(spark):
    def ask(said, room, timeout):
        if said == "long" and room > 30:
            raise plugins.ContextExceeded(70, 100)
        if said == "full":
            raise plugins.ContextExceeded(100, 100)
        if said == "slow" and timeout < 200:
            raise TimeoutError
        if said == "bad":
            raise KeyError("choices")
        return {"text": f"{said}:{room}:{timeout}", "finish": "stop"}

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "long", "full", "slow", "bad", None])], "id int, prompt string").coalesce(1)
    got = [(r["text"], r["finish"], r["error"]) for r in plugins.generated(df, ask, "prompt", "text string, finish string", 50, 100, attempts=3, wait=0.01).orderBy("id").collect()]
    assert got[0] == ("a:50:100", "stop", None) and got[1] == ("long:30:100", "stop", None) and got[3] == ("slow:50:225", "stop", None)
    assert [g[0] for g in got[2:6:2]] == [None, None] and "context of 100" in got[2][2] and "KeyError" in got[4][2] and got[5] == (None, None, "no prompt")


# Streams -----------------------------------------------------------------------------------------


def test_progress_goes_on_after_a_restart(spark, tmp_path):
    schema = "mode string, at timestamp"
    totals = spark.createDataFrame([("a", 10), ("c", 1)], "mode string, total long")
    put = lambda rows, n: spark.createDataFrame(rows, "mode string, at string").select("mode", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: progress.track(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "mode", "at", totals, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    read = lambda: {r["mode"]: (r["completed"], r["total"], str(r["last_updated"])) for r in sinks.read_replaced(spark, str(tmp_path / "out")).collect()}
    put([("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:03"), ("b", "2024-01-01 00:00:02")], 0)
    go()
    first = read()
    assert {m: x[:2] for m, x in first.items()} == {"a": (2, 10), "b": (1, None)}
    go()  # nothing new
    assert read() == first
    put([("a", "2024-01-01 00:00:09")], 1)
    go()
    assert read()["a"][:2] == (3, 10) and read()["a"][2].endswith("00:00:09") and read()["b"] == first["b"]


def test_stream_stats_twice(spark):
    one, two = (sorted(map(tuple, QUERIES["stream_stats"](spark, SF).collect())) for _ in range(2))
    assert one == two and len(one) == 5


# Consistency and recomputation -------------------------------------------------------------------


def test_ordered_calls_as_used(spark):
    call = lambda *xs: [{"signature": x, "order_index": i} for i, x in xs]
    used = lambda *xs: [{"signature": x} for x in xs]
    rows = [
        (1, "ordered_augmentation", "/* */", call((2, "b"), (1, "a")), used("a", "b")), (1, "none", None, None, None),
        (2, "ordered_augmentation", "/* */", call((2, "b"), (1, "a")), used("b", "a")), (2, "none", None, call((1, "x")), used("y")),
        (3, "ordered_augmentation", "", call((1, "a")), used("z")), (3, "none", None, None, None),
        (4, "ordered_augmentation", "/* */", call((1, "a")), None), (4, "none", None, None, None),
        (5, "ordered_augmentation", "/* */", call((1, "a")), used("z")),  # the only mode of its index
        (6, "ordered_augmentation", "/* */", [], used("z")), (6, "none", None, None, None),
        (7, "ordered_x", "/* */", call((1, "b"), (1, "a")), used("b", "a")), (7, "none", None, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, mode string, block string, calls array<struct<signature:string,order_index:int>>, used array<struct<signature:string>>").repartition(3)
    got = analysis.ordered_issues(df, "i", "mode", "block", "calls", "used").collect()
    assert sorted((r["i"], r["mode"], r["field"]) for r in got) == [(2, "ordered_augmentation", "used"), (4, "ordered_augmentation", "used")]


def test_recomputed_tree(spark, tmp_path):
    rows = [("a", "int x = 1; // one", "int y = 1;", "stale", 0.5), ("a", None, "int y;", "kept", 0.25), ("b", "", "z", "kept", 0.75), ("b", "go();", "go();", "stale", 0.1)]
    df = spark.createDataFrame(rows, "mode string, generated string, ground_truth string, normalized_generated string, mrr double").withColumn("metrics", F.struct(F.col("mrr"), F.lit(-1.0).alias("es"))).drop("mrr")
    dry = scoring.recompute_results(df, str(tmp_path / "no"), ["a", "b"], ["es", "mrr"], write=False)
    assert not (tmp_path / "no").exists()
    got = {(r["mode"], r["generated"]): r for r in dry.collect()}
    assert got["a", "int x = 1; // one"]["normalized_generated"] == "int var1 = 1;" and got["a", "int x = 1; // one"]["normalized_ground_truth"] == "int var1 = 1;"
    assert got["a", None]["normalized_generated"] == "kept" and got["b", ""]["metrics"]["es"] == -1.0
    assert got["b", "go();"]["metrics"]["es"] == 1.0 and got["b", "go();"]["metrics"]["mrr"] == 0.1
    scoring.recompute_results(df, str(tmp_path / "yes"), ["a", "b"], ["es", "mrr"])
    summary = json.loads((tmp_path / "yes" / "summary.json").read_text())
    # Samples that cannot be measured are in no aggregate.
    assert summary["a"]["sample_count"] == 1 and summary["a"]["es"]["mean"] == 1.0 and summary["b"]["mrr"]["mean"] == 0.1
    assert spark.read.json(str(tmp_path / "yes" / "samples")).count() == 4


def test_chosen_indices(spark):
    rows = [(1, "a", "x.Foo", True, True, None, [], "public void f()"), (1, "b", "x.Foo", False, None, ["e"], ["t"], "private void f()"), (2, "a", "y.Bar", False, False, [], None, None), (3, "a", None, None, None, None, None, "public x")]
    df = spark.createDataFrame(rows, "i int, mode string, name string, em boolean, compilable boolean, compile_errors array<string>, direct_test_methods array<string>, method_signature string")
    ask = lambda **how: sorted(r["i"] for r in analysis.chosen_indices(df, "i", "mode", "name", **how).collect())
    assert [ask(), ask(text="FOO"), ask(matched=True), ask(compilable=True), ask(failing=True), ask(tested=True), ask(public=True)] == [[1, 2, 3], [1], [1], [1, 3], [1], [1], [1, 3]]
    assert ask(compilable=True, public=True, text="foo") == [1] and ask(text="foo", failing=True, matched=True, tested=True) == [1]


# Explanations, words -----------------------------------------------------------------------------


def test_explanations_add_up(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, {"card": " ".join(rng.choices(words, k=20)), "types": " ".join(rng.choices(words, k=5))}) for i in range(25)], "doc int, fields map<string,string>")
    posted = retrieval.postings(docs, "doc", F.col("fields"))
    asked = spark.createDataFrame([(q, c, b, f, rng.choice(words), rng.randint(1, 2)) for q in range(4) for c, b, f in (("type", 5.0, "types"), ("signature", 3.0, "card"), ("package", 2.0, "card")) for _ in range(3)], "query int, clause string, boost double, field string, term string, mult int").dropDuplicates(["query", "clause", "field", "term"])
    scored = retrieval.score(asked, posted)
    told = {(r["query"], r["doc"]): r for r in retrieval.explain(scored, asked, posted).collect()}
    stats = retrieval.index_stats(posted)
    assert told == {(r["query"], r["doc"]): r for r in retrieval.explain(scored, asked, posted, stats).collect()}
    for r in scored.collect():
        x = told[r["query"], r["doc"]]
        assert math.isclose(x["score"], r["score"], rel_tol=1e-9)
        assert math.isclose(sum(c["share"] for c in x["clauses"]), r["score"], rel_tol=1e-9)
        assert {c["clause"]: round(c["value"], 9) for c in x["clauses"]} == {c: round(v, 9) for c, v in r["clauses"].items()}
        for c in x["clauses"]:
            assert math.isclose(sum(y["value"] for y in c["terms"]), c["value"], rel_tol=1e-9)
            assert all(math.isclose(y["weight"] * (y["bm25"] + y["jelinek_mercer"] + y["dirichlet"]), y["value"], rel_tol=1e-9) for y in c["terms"])
    assert len(told) == scored.count()


MID_LETTER, MID_NUM, MID_BOTH = ":··՟״‧︓﹕：", ",;;։،؍٬߸⁄︐︔，；", ".'‘’․﹒＇．"


def kind(c):
    name = unicodedata.name(c, "")
    if "CJK UNIFIED" in name or name.startswith("HIRAGANA"):
        return "I"
    if name.startswith("KATAKANA"):
        return "K"
    if c in MID_LETTER:
        return "l"
    if c in MID_NUM:
        return "n"
    if c in MID_BOTH:
        return "b"
    category = unicodedata.category(c)
    return "L" if category[0] == "L" else "N" if category == "Nd" else "_" if category == "Pc" else "M" if category[0] == "M" or category == "Cf" else "x"


def plain_words(said):
    """A machine over one code point at a time, with one of lookahead."""
    chars = list(said.lower())
    kinds = [kind(c) for c in chars]
    ahead = lambda i: next((k for k in kinds[i + 1 :] if k != "M"), "x")
    words, now, last = [], "", "x"
    for i, (c, k) in enumerate(zip(chars, kinds, strict=True)):
        if k == "M":
            now += c if now else ""
            continue
        joins = k in "LN_" and last in "LN_lnb" or (k in "lb" and last == "L" and ahead(i) == "L") or (k in "nb" and last == "N" and ahead(i) == "N") or (k == "K" and last == "K")
        if now and joins:
            now += c
        else:
            words += [now] if now else []
            now = c if k in "LN_IK" else ""
        last = k if now else "x"
    return words + ([now] if now else [])


def test_words_one_by_one(spark):
    rng = random.Random(9)
    parts = ["a", "B", "é", "1", "22", "_", ".", ":", "'", ",", ";", " ", "-", "漢", "ひ", "カ", "タ", "́", "‍", "’", "ß", "한", "٣", "Я", "::", "x.y", "1.5", "class:Foo", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(800)] + ["com.foo.Bar::baz(int) -> void", "a" * 700, "x." * 4000 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", retrieval.analyze("t").alias("w")).collect()}
    for i, t in enumerate(texts[:800]):
        assert got[i] == plain_words(t), t
    assert got[800] == ["com.foo.bar", "baz", "int", "void"]
    assert [len(w) for w in got[801]] == [255, 255, 190] and "".join(got[802]) == texts[802] and {len(w) for w in got[802][:-1]} == {255}


# Texts of code -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("params", "want"),
    [
        ("Map<K, V> m, int n", ["Map<K, V>", "int"]), ("int, java.lang.String", ["int", "String"]), ("", []), (None, []), ("  ", []), ("final a.b.Foo<x.Y> foo", ["final Foo<Y>"]), ("List<Map<A, List<B>>> x,int[] y", ["List<Map<A, List<B>>>", "int[]"]),
        ("Foo Bar", ["Foo Bar"]), ("String... rest,", ["String..."]), ("A<B,C>,D", ["A<B,C>", "D"]), ("T t,  , U u", ["T", "U"]), ("a > b, c", ["a >", "c"]),
    ],
)
def test_parameter_types(spark, params, want):
    assert spark.createDataFrame([(params,)], "p string").select(text.parameter_types("p").alias("t")).first()["t"] == want


@pytest.mark.parametrize(
    ("before", "want"),
    [
        ("class A {\n  void f() ", "  void f() "), ("class A {\n  @Override\n  void f() ", "  @Override\n  void f() "), ("x;\n  /** a\n   * b */\n  // c\n  @X\n  int f()\n  ", "  /** a\n   * b */\n  // c\n  @X\n  int f()\n  "),
        ("void f() ", "void f() "), ("  }\n\n  void f() ", "  void f() "), ("y\n" + " " * 600, " " * 500), ("", ""), ("@A\n@B\nint f() ", "@A\n@B\nint f() "),
    ],
)
def test_declaration_starts(spark, before, want):
    got = spark.createDataFrame([(before + "{ x }", len(before))], "c string, o int").select(text.declaration_start("c", "o").alias("s")).first()["s"]
    assert before[got:] == want


def test_source_roots_and_keys(spark):
    paths = ["m1/src/main/java/a/B.java", "m1/src/main/java/c/D.java", "src/main/java/X.java", "/abs/m2/SRC/Main/Java/q/R.java", "m3\\src\\main\\java\\S.java", "docs/x", "notsrc/main/java/y", None]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r["root"] for r in dataset.source_roots(files, "path", "/p").collect()] == ["/abs/m2/SRC/Main/Java", "m1/src/main/java", "m3/src/main/java", "src/main/java"]
    assert [r["root"] for r in dataset.source_roots(files.filter("path = 'docs/x'"), "path", "/p").collect()] == ["/p"]
    names = {"a.b.Foo": "a/b/Foo.java", "a.b.Foo.Inner": "a/b/Foo.java", "Foo": "Foo.java", "a.b.foo": "a/b/foo.java", "x": "x.java"}
    assert {r["n"]: r["k"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", text.source_key("n").alias("k")).collect()} == names
    lines = spark.createDataFrame([("a/b/Foo.java", 1, 1, 0), ("b/Foo.java", 1, 1, 0), ("Foo.java", 2, 0, 1)], "source_key string, line int, covered int, missed int")
    methods = spark.createDataFrame([(1, "m/src/main/java/a/b/Foo.java", "zz.Q"), (2, "m/x/b/Foo.java", "zz.Q"), (3, "m/y/Foo.java", "zz.Q"), (4, "m/Bar.java", "a.b.Foo"), (5, None, "a.b.Foo.I"), (6, "m\\b\\Foo.java", "zz.Q")], "id int, filePath string, classFqn string")
    assert {r["id"]: r["source_key"] for r in dataset.with_source_keys(methods, lines).collect()} == {1: "a/b/Foo.java", 2: "b/Foo.java", 3: "Foo.java", 4: "a/b/Foo.java", 5: "a/b/Foo.java", 6: "b/Foo.java"}


def test_prompts_within_a_budget(spark):
    body = "{ return 1; }"
    content = "package p;\nclass A {\n  int f() " + body + "\n}\n"
    at = content.index(body)
    rows = [(i, content, at, at + len(body), "p.A", [], [], fragments) for i, fragments in enumerate([["// one\n" + "a b c d " * 40] * 6, [], None])]
    schema = "id int, fileContent string, bodyStartOffset int, bodyEndOffset int, classFqn string, invocations array<struct<signature:string,resolutionMode:string,orderIndex:int>>, usedTypes array<string>, results array<string>"
    df = spark.createDataFrame(rows, schema)
    got = {budget: {r["id"]: r for r in prompt.fitted_prompts(df, "id", "rag_x", "results", budget).collect()} for budget in (700, 5000)}
    assert got[5000][0]["n_results"] == 6 and 0 < got[700][0]["n_results"] < 6
    assert all(got[b][i]["n_results"] == 0 and got[b][i]["full_prompt"] for b in got for i in (1, 2))
    assert got[700][0]["full_prompt"].count("// one") == got[700][0]["n_results"]


# CodeBLEU ----------------------------------------------------------------------------------------

TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[A-Za-z_]\w*|\d+|[-+*/=<>!&|]=|\+\+|--|&&|\|\||\S')


def plain_bleu(first, of, a, b):
    if first <= 0:
        return 0.0
    logs = math.log(first / of)
    for n in range(2, 5):
        grams = lambda x: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))  # noqa: E731, B023
        x, y = grams(a), grams(b)
        hit = sum((x & y).values())
        logs += math.log((hit or 0.1) / max(1, sum(x.values())))
    short = 1.0 if len(a) > len(b) else math.exp(1 - len(b) / max(1, len(a)))
    return short * math.exp(logs / 4)


def plain_tree(tokens):
    """Subtrees of brackets and of segments between ``;`` and ``}`` outside round brackets, names and literals as their kind."""
    words = [t for t in tokens]
    shape = ["0" if re.match(r'["\d]', t) or t in ("true", "false", "null") else "x" if re.match(r"[A-Za-z_]", t) and t not in text.KEYWORDS else t for t in words]
    parts, stack, start = [], [], {None: 0}
    for i, t in enumerate(words):
        up = stack[-1] if stack else None
        if t in "([{":
            stack.append(i)
            start[i] = i + 1
        elif t in ")]}":
            stack.pop()
            parts.append(" ".join(shape[up : i + 1]))
            if words[up] == "{" and start[up] < i:
                parts.append(" ".join(shape[start[up] : i]))
            up = stack[-1] if stack else None
            if t == "}" and (up is None or words[up] == "{"):
                parts.append(" ".join(shape[start[up] : i + 1]))
                start[up] = i + 1
        elif t == ";" and (up is None or words[up] == "{"):
            parts.append(" ".join(shape[start[up] : i + 1]))
            start[up] = i + 1
    if start[None] < len(words):
        parts.append(" ".join(shape[start[None] :]))
    return parts


def plain_flow(tokens, variables):
    order, sets, out = {}, Counter(), []
    for i, t in enumerate(tokens):
        if t not in variables:
            continue
        before, after = tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else ""
        if after in (".", "(") or before == ".":
            continue
        defines = after in ("=", "+=", "-=", "++", "--") or before in ("++", "--", "int", "Foo", "]")
        out.append((order.setdefault(t, len(order)), sets[t], defines))
        sets[t] += defines
    return out


def plain_codebleu(g, r, variables):
    a, b = TOKENS.findall(g), TOKENS.findall(r)
    common = lambda x, y: sum((Counter(x) & Counter(y)).values())
    keep = lambda x: [t for t in x if t in text.KEYWORDS]
    hit = common(a, b)
    weigh = lambda n, k: 0.2 * n + 0.8 * k
    parts = [plain_bleu(hit, len(a), a, b), plain_bleu(weigh(hit, common(keep(a), keep(b))), weigh(len(a), len(keep(a))), a, b)]
    x, y = plain_tree(a), plain_tree(b)
    parts.append(common(x, y) / len(y) if y else 0.0)
    x, y = plain_flow(a, variables), plain_flow(b, variables)
    parts.append(common(x, y) / len(y) if y else 1.0)
    return sum(parts) / 4


def test_codebleu_equals_a_plain_version(spark):
    rng = random.Random(12)
    variables = ["a", "b", "c"]
    lines = ["int a = 1;", "int b = a + 2;", "Foo c = make(a, b);", "a++;", "b = c.size() - a;", "if (a > b) { b += 3; } else { go(); }", "while (a != 9) { a--; run(b); }", "return a;", "for (int c : list(a)) { use(c); }", 'say("x y", b);', "int[] c = pick(b);", "{ stop(); }"]
    pairs = [(i, " ".join(rng.choices(lines, k=rng.randint(1, 6))), " ".join(rng.choices(lines, k=rng.randint(1, 6)))) for i in range(60)]
    pairs += [(60, lines[5], lines[5]), (61, "go();", "stop(1);"), (62, "x", "go(); go();")]
    odd = [(70, None, "a;"), (71, "a;", "  \n"), (72, "", ""), (73, "// only said", "int a = 1;"), (74, "int a = 1;", "/* no */")]
    df = spark.createDataFrame(pairs + odd, "id int, generated string, ground_truth string").repartition(3)
    got = {r["id"]: r for r in codebleu(df, "id").collect()}
    for i, g, r in pairs:
        assert abs(got[i]["codebleu"] - plain_codebleu(g, r, {*variables, "x"})) < 1e-6, (g, r, got[i])
    assert got[60]["codebleu"] == 1.0
    assert [got[i]["codebleu"] for i in (70, 71, 72)] == [None] * 3
    assert got[73]["ngram"] == got[73]["syntax"] == 0.0 and got[74]["dataflow"] == 1.0
    assert codebleu(df.filter("id < 0"), "id").count() == 0


# Retrieval metrics and blocks --------------------------------------------------------------------


def plain_retrieval(results, calls, block, truth):
    exact = [c for c in calls if c[1] == "EXACT"]
    parse = lambda x: (x.split("::")[0], x.split("::")[1].split("(")[0]) if "::" in x else (x, "")
    oracle = [parse(c[0]) for c in exact]
    simple = lambda o: o.split("<")[0].rsplit(".", 1)[-1].lower()
    shown = (block or "").lower()
    recall = 0.0 if not shown else sum(simple(o) in shown and m.lower() in shown for o, m in oracle) / len(oracle) if oracle else 1.0
    needed = set(oracle)
    texts = [f"{c} {p}".lower() for c, p, _ in results]
    covered = sum(any(o.rsplit(".", 1)[-1].lower() in t and m.lower() in t for t in texts) for o, m in needed) / len(needed) if needed else 1.0
    low = {(o.lower(), m.lower()) for o, m in needed}
    apis = [{(x.split("::")[0].lower(), x.split("::")[1].split("(")[0].lower()) for x in p.split("\n") if "::" in x and not x.startswith(("bigram:", "trigram:"))} for _, p, _ in results]
    gains = [len(low & a) for a in apis]
    dcg = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g))
    ideal = dcg(sorted(gains, reverse=True))
    ndcg = 0.0 if not results else 1.0 if not low else dcg(gains) / ideal if ideal else 0.0
    precision = 0.0 if not results else 1.0 if not low else sum(g > 0 for g in gains) / len(gains)
    words = lambda t: set(re.findall(r"[a-zA-Z_]\w*|[0-9]+(?:\.[0-9]+)?|[^\s]", t or ""))
    mrr = next((1 / (i + 1) for i, (_, _, b) in enumerate(results) if words(b) and words(truth) and len(words(b) & words(truth)) / len(words(b) | words(truth)) >= 0.3), 0.0)
    owners = {o for o, _ in low}
    return [recall, covered, mrr, precision, ndcg, len(owners & {o for a in apis for o, _ in a}) / len(owners) if owners else 1.0]


def test_retrieval_metrics_made_anew(spark):
    rng = random.Random(5)
    names = [f"a.b.{o}::{m}(int) -> void" for o in ("Foo", "Bar", "Zed") for m in ("get", "put")]
    profile = lambda: "\n".join([*(n + rng.choice(["", " x2"]) for n in rng.sample(names, rng.randint(0, 3))), "bigram: Foo::get -> Bar::put"])
    rows = []
    for i in range(80):
        results = [(rng.choice(["class: Foo", "get zed", ""]), profile(), rng.choice(["return a + b;", "go(x);", "", None])) for _ in range(rng.randint(0, 3))]
        calls = [(rng.choice([*names, "helper"]), rng.choice(["EXACT", "EXACT", "UNRESOLVED"])) for _ in range(rng.randint(1, 4))]
        rows.append((i, results, calls, rng.choice(["Foo get put", "bar", "", None]), rng.choice(["return a - b;", "x", ""])))
    table = [(i, [(f"r{k}", c, p, b, k + 1) for k, (c, p, b) in enumerate(rs)], [(s, m, k) for k, (s, m) in enumerate(cs)], b, t) for i, rs, cs, b, t in rows]
    table += [(90, None, [("x", "EXACT", 0)], "b", "t"), (91, [], [], "b", "t"), (92, [], None, "b", "t")]
    schema = "i int, retrieval_results array<struct<id:string,methodCard:string,invocationProfile:string,methodBody:string,rank:int>>, invocations_ordered array<struct<signature:string,resolution_mode:string,order_index:int>>, augmentation_block string, ground_truth string"
    df = spark.createDataFrame(table, schema).withColumn("metrics", F.struct(F.lit(0.5).alias("es"), F.lit(-1.0).alias("mrr"), F.lit(0.7).alias("retrieval_type_iou"))).repartition(3)
    made = scoring.recompute_retrieval(df)
    assert made.columns == df.columns
    got = {r["i"]: r["metrics"] for r in made.collect()}
    names = ("recall_at_k", "api_coverage_at_k", "mrr", "retrieval_precision_at_k", "retrieval_ndcg_at_k", "owner_type_recall")
    for i, results, calls, block, truth in rows:
        assert [round(got[i][n], 9) for n in names] == [round(x, 9) for x in plain_retrieval(results, calls, block, truth)], rows[i]
        assert (got[i]["es"], got[i]["retrieval_type_iou"]) == (0.5, 0.7)
    assert all(got[i]["mrr"] == -1.0 and got[i]["recall_at_k"] is None for i in (90, 91, 92))


def test_blocks_end_where_a_result_begins(spark):
    from lodestone.operators import enrich

    mark = "<|file_sep|>"
    for sizes, room in [((10, 10, 10), 100), ((300, 10), 20), ((60, 60, 60), 40), ((60, 60, 60), 41), ((60, 60, 60), 45), ((5,) * 40, 90), ((0,), 1)]:
        rows = [(1, k, f"p{k}", "a.A", "s", None, "y" * n or "z") for k, n in enumerate(sizes)]
        df = spark.createDataFrame(rows, "query int, rank int, path string, class_fqn string, signature string, method_body string, content string")
        block = "\n".join(f"{mark}p{k}\n{'y' * n or 'z'}" for k, n in enumerate(sizes))
        if len(block) > 4 * room:
            cut = block[: 4 * room].rfind(f"\n{mark}")
            block = block[:cut] if cut > 0 else block[: 4 * room]
        assert enrich.result_block(df, max_tokens=room).first()["block"] == block


def test_verdicts_of_samples(spark, tmp_path):
    from lodestone.sources import readers

    folder = tmp_path / "a" / "samples"
    folder.mkdir(parents=True)
    for i, m in enumerate([{"compilable": False, "compile_errors": ["e"], "compile_exit_code": 1}, {"compilable": True}, {"em": True, "codebleu": 0.5, "lcs_tokens": ["x"]}]):
        (folder / f"sample_{i:03d}.json").write_text(json.dumps({"mode": "a", "metrics": m, "retrieval_results": [{"id": "r", "rank": 1}], "retrieval_query": {"topK": 5}}))
    got = {r["sample_index"]: r for r in readers.with_verdict(readers.read_samples(spark, str(tmp_path))).collect()}
    assert [got[i]["compilability"] and tuple(got[i]["compilability"]) for i in range(3)] == [(False, ["e"], 1), (True, [], 0), None]
    assert got[2]["metrics"]["codebleu"] == 0.5 and got[2]["metrics"]["lcs_tokens"] == ["x"] and got[0]["retrieval_results"][0]["rank"] == 1 and json.loads(got[0]["retrieval_query"]) == {"topK": 5}
