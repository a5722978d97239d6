"""Java sources as tables: tokens, methods, calls, roles of names."""

import re

import pytest

from lodestone.operators.syntax import extract, source_tokens, strip_by_syntax, syntax_tree

STORE = '''package shop.core;

import java.util.*;
import java.util.function.Function;
import shop.io.Disk;
import static shop.io.Disk.open;

/** A { store }. */
@Deprecated(since = "1")
public final class Store<T extends Comparable<T>> extends Base<T> implements Shelf, java.io.Closeable {
    private static final Map<String, List<T>> items = new HashMap<>(), others;
    int[] sizes = {1, 2}, more;
    protected Disk disk = new Disk("a}b", 1) { @Override public void run() { tick(); } };

    public Store(Disk disk) { super(disk); this.disk = disk; }
    Store() { this(new Disk("x", 2)); }

    @Override @SuppressWarnings({"a", "b"})
    public <R extends Number> Map<String, List<R>> find(final String name, @Nonnull Function<? super T, R> f, int... at) throws java.io.IOException, Oops {
        // no { call() here
        if (name.isEmpty()) { return null; } else helper(1);
        for (int i = 0; i < at.length; i++) sum(at[i], 2);
        do { i--; } while (i > 0);
        try { disk.write(name.trim().length()); } catch (Oops | Bad e) { log(e); } finally { close(); }
        Runnable r = () -> { helper(3); };
        char c = '"'; String s = "f(1) \\" }";
        Shelf shelf = Shelf.of(disk.read(), new Box<String>(name)).put(open(name));
        return (Map<String, List<R>>) items;
    }

    private void helper(int n) { }
    private int sum(int a, int b) { return a + b; }
    private int sum(int a) { return a; }
    abstract void nothing();
    static { helper(9); }
    enum Kind { ONE(1) { int v() { return two(); } }, TWO { }; final int n; Kind(int n) { this.n = n; } Kind() { this(0); } int v() { return n; } }
    interface Shelf { static Shelf of(Object o, Box<String> b) { return null; } default Shelf put(Object o) { return Inner.make(); } }
    record Point(int x, int y) { int norm() { return Math.abs(x); } class Deep { void down() { } } }
    public void close() { class Local { void act() { helper(7); } } new Local().act(); int x = switch (n) { case 1 -> { yield 2; } default -> 3; }; ; }
}
'''
DISK = "package shop.io;\npublic class Disk {\n  public Disk(String path, int mode) { }\n  public byte[] read() { return null; }\n  public void write(int n) { read(); }\n  public static Disk open(String p) { return null; }\n}\n"


@pytest.fixture(scope="module")
def rows(spark):
    sources = spark.createDataFrame([("Store.java", STORE), ("Disk.java", DISK), ("empty.java", ""), ("null.java", None), ("junk.java", ") } ] class { ( [ new < \" ' /* open")], "path string, text string").repartition(3)
    return {(r["classFqn"], r["methodSignature"]): r for r in extract(sources).collect()}


def calls(row):
    return [i["signature"] if i["resolutionMode"] == "EXACT" else i["signature"].removeprefix("UNRESOLVED") for i in row["invocations"]]


def test_tokens_cover_the_text(spark):
    texts = [STORE, DISK, 'x = """\n a "quoted" } \\""" b\n""" + 0x1F_Fp+2 - 1e-5f + .5 + \'\\\'\' ;', "a" * 100_000, '"' + "\\\"x" * 50_000 + '"', "'", '"open', "/* open", "é漢🙂 $x _y #", "/*" + "*" * 60_000 + "*/"]
    got = source_tokens(spark.createDataFrame(list(enumerate(texts)), "path int, text string")).orderBy("file", "i").collect()
    for k, text in enumerate(texts):
        tokens = [r for r in got if r["file"] == k]
        assert "".join(r["token"] for r in tokens) == text
        at = 0
        for r in tokens:
            assert r["at"] == at
            at += len(r["token"])
    assert '"""\n a "quoted" } \\""" b\n"""' in {r["token"] for r in got} and {"0x1F_Fp+2", "1e-5f", ".5", "'\\''"} <= {r["token"] for r in got}


def test_methods(rows):
    store, disk = "shop.core.Store", "shop.io.Disk"
    assert set(rows) == {
        (store, "public Store(Disk disk)"), (store, "Store()"), (store, "public Map<String,List<R>> find(String name, Function<? super T,R> f, int... at)"),
        (store, "private void helper(int n)"), (store, "private int sum(int a, int b)"), (store, "private int sum(int a)"), (store, "public void close()"),
        (f"{store}.Kind", "Kind(int n)"), (f"{store}.Kind", "Kind()"), (f"{store}.Kind", "int v()"), (f"{store}.Shelf", "static Shelf of(Object o, Box<String> b)"), (f"{store}.Shelf", "default Shelf put(Object o)"),
        (f"{store}.Point.Deep", "void down()"), (f"{store}.Local", "void act()"),
        (disk, "public Disk(String path, int mode)"), (disk, "public byte[] read()"), (disk, "public void write(int n)"), (disk, "public static Disk open(String p)"),
    }


def test_a_method_in_full(rows):
    r = rows["shop.core.Store", "public Map<String,List<R>> find(String name, Function<? super T,R> f, int... at)"]
    assert (r["methodName"], r["returnType"], r["parameterTypes"]) == ("find", "Map<String,List<R>>", ["String", "Function<? super T,R>", "int[]"])
    assert r["thrownExceptions"] == ["java.io.IOException", "Oops"]
    assert r["supertypes"] == ["Base<T>", "Shelf", "java.io.Closeable"]
    assert r["imports"] == ["java.util", "java.util.function.Function", "shop.io.Disk", "shop.io.Disk.open"]
    assert [(f["name"], f["typeFqn"]) for f in r["classFields"]] == [("items", "Map<String,List<T>>"), ("others", "Map<String,List<T>>"), ("sizes", "int[]"), ("more", "int[]"), ("disk", "Disk")]
    assert r["methodBody"] == STORE[r["bodyStartOffset"] : r["bodyEndOffset"]] and r["methodBody"].startswith("{\n        // no") and r["methodBody"].endswith("items;\n    }")
    assert r["statementCount"] == 9
    assert [i["orderIndex"] for i in r["invocations"]] == list(range(len(r["invocations"])))
    assert r["usedTypes"] == ["Oops", "Bad", "Runnable", "String", "Shelf", "Box", "Map", "List", "R"]


def test_calls_in_order_of_visit(rows):
    find = calls(rows["shop.core.Store", "public Map<String,List<R>> find(String name, Function<? super T,R> f, int... at)"])
    assert find == [
        "<isEmpty>", "shop.core.Store::helper(int) -> void", "shop.core.Store::sum(int, int) -> int", "shop.io.Disk::write(int) -> void", "<length>", "<trim>", "<log>", "shop.core.Store::close() -> void",
        "shop.core.Store::helper(int) -> void", "<put>", "shop.core.Store.Shelf::of(Object, Box<String>) -> Shelf", "shop.io.Disk::read() -> byte[]", "<<init>(Box<String>)>", "<open>",
    ]
    assert calls(rows["shop.core.Store", "public Store(Disk disk)"]) == ["<super>"]
    assert calls(rows["shop.core.Store", "Store()"]) == ["shop.core.Store::<init>(Disk) -> shop.core.Store", "shop.io.Disk::<init>(String, int) -> shop.io.Disk"]
    # What a local class calls belongs to its own method and to the one around it.
    assert calls(rows["shop.core.Store.Local", "void act()"]) == ["shop.core.Store::helper(int) -> void"]
    assert calls(rows["shop.core.Store", "public void close()"]) == ["shop.core.Store::helper(int) -> void", "<act>", "<<init>(Local)>"]
    assert calls(rows["shop.core.Store.Kind", "Kind()"]) == ["shop.core.Store.Kind::<init>(int) -> shop.core.Store.Kind"]
    assert calls(rows["shop.io.Disk", "public void write(int n)"]) == ["shop.io.Disk::read() -> byte[]"]
    assert rows["shop.core.Store", "public void close()"]["statementCount"] == 4
    assert rows["shop.core.Store", "private void helper(int n)"]["statementCount"] == 0


def test_brackets_pair(spark):
    text = "a ( b [ c ] { d ( ) } ) e < f , g < h > > i"
    tree = {r["pos"]: r for r in syntax_tree(spark.createDataFrame([("f", text)], "path string, text string")).collect()}
    words = text.split()
    around = lambda t: words[tree[words.index(t)]["up"]["pos"]] if tree[words.index(t)]["up"] else None
    assert [around(t) for t in "abcde"] == [None, "(", "[", "{", None]
    assert {words[p] + words[r["close"]] for p, r in tree.items() if r["close"] is not None} == {"()", "[]", "{}"}
    assert [tree[words.index(t)]["angle"] for t in "efghi"] == [0, 1, 1, 2, 0]


CASES = [
    ("int count = 5;", "int _ = _;"), ("String s = \"a b\" + 'c';", "String _ = _ + _;"), ("foo.bar(baz);", "foo.bar(_);"), ("this.x = y;", "this.x = _;"), ("return a.b.c;", "return a.b.c;"),
    ("List<String> xs = new ArrayList<>();", "List<String> _ = new ArrayList<>();"), ("for (Item i : items) use(i);", "for (Item _ : _) use(_);"), ("if (flag && !done) { stop(); }", "if (_ && !_) { stop(); }"),
    ("Object o = (Foo) thing;", "Object _ = (Foo) _;"), ("x = (y) + 1;", "_ = (_) + _;"), ("try { run(); } catch (IOException | Oops e) { }", "try { run(); } catch (IOException | Oops _) { }"),
    ("int[] a = {1, 2}; a[0]++;", "int[] _ = {_, _}; _[_]++;"), ("Map<String, List<Foo>> m;", "Map<String, List<Foo>> _;"), ("boolean b = o instanceof Foo;", "boolean _ = _ instanceof Foo;"), ("boolean b = i < n && j > m;", "boolean _ = _ < _ && _ > _;"),
    ("x -> x + 1", "_ -> _ + _"), ("String::valueOf", "_::_"), ("@Override public void go(int n) throws Bad, Worse { }", "@Override public void go(int _) throws Bad, Worse { }"), ("class A extends B implements C, D { int f; A(int f) { this.f = f; } }", "class A extends B implements C, D { int _; A(int _) { this.f = _; } }"),
    ("enum E { ONE, TWO(2); int v; }", "enum E { ONE, TWO(_); int _; }"), ("import a.b.C;\npackage p.q;", "import a.b.C;\npackage p.q;"), ("label: while (true) break label;", "_: while (_) break _;"), ("Object n = null; // keep x\n", "Object _ = _; // keep x\n"),
    ("var v = 0x1F + 1.5e3f;", "var _ = _ + _;"), ("double d = a < b ? c : e;", "double _ = _ < _ ? _ : _;"), ("final Foo.Bar fb = Foo.make();", "final Foo.Bar _ = Foo.make();"), ("synchronized (lock) { n--; }", "synchronized (_) { _--; }"),
    ("String t = \"\"\"\n  x\n  \"\"\";", "String _ = _;"), ("throw new Oops(msg, e);", "throw new Oops(_, _);"), ("assert x != y : z;", "assert _ != _ : _;"), ("a = b ? c(d) : e[f];", "_ = _ ? c(_) : _[_];"), ("int x, y = z;", "int _, _ = _;"),
]


def test_stripped_by_syntax(spark):
    sources = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)] + [(900, None), (901, "")], "path int, text string").repartition(4)
    got = {r["file"]: r["stripped"] for r in strip_by_syntax(sources).collect()}
    assert {CASES[i][0]: t for i, t in got.items()} == dict(CASES)


def test_sources_with_odd_rows(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert extract(none).count() == 0 and strip_by_syntax(none).count() == 0
    deep = "class A { void f() { " + "if (x) { " * 300 + "g(); " + "}" * 300 + " } }"
    wide = "class A { " + " ".join(f"void m{i}(int a{i}) {{ n{i}(a{i}); }}" for i in range(400)) + " }"
    got = extract(spark.createDataFrame([("d", deep), ("w", wide)], "path string, text string")).collect()
    assert sum(r["filePath"] == "w" for r in got) == 400
    assert [calls(r) for r in got if r["filePath"] == "d"] == [["<g>"]]
    assert all(re.fullmatch(r"<n\d+>", calls(r)[0]) for r in got if r["filePath"] == "w")


def test_categories_and_siblings(spark):
    from lodestone.operators.syntax import with_siblings

    text = """package a;
class A {
  int x; Other o;
  A(int x) { super(x); }
  int getX() { return x; }
  boolean isX() { return x > 0; }
  void setX(int x) { this.x = x; }
  void setTwo(int x, int y) { this.x = x; }
  int go(int a, int b) { return o.go(a, b); }
  void run(int a) { Helper.<T>run(a); }
  void all(int a) { o.go(a, 1); }
  int made(int a) { return new Other(a); }
  void local(int a) { int b = go(a); }
  int sum(int a) { return a + go(a); }
  int getBoth() { x++; return x; }
  void getNone() { }
  @Test void tried() { }
  @org.junit.Test(timeout = 1) void again(int a) { a(); }
  @javax.annotation.Generated("x") @Override public void built() { f(); }
  void loop(int a) { for (;;) { go(a); } }
}
"""
    rows = spark.createDataFrame([("src/main/A.java", text), ("src/test/B.java", "class B { int getX() { return 1; } }")], "path string, text string")
    got = extract(rows)
    kinds = {r["methodName"]: r["category"] for r in got.filter("classFqn = 'a.A'").collect()}
    assert kinds == {
        "getX": "GETTER", "isX": "GETTER", "setX": "SETTER", "setTwo": "NORMAL", "go": "DELEGATOR", "run": "DELEGATOR", "all": "NORMAL", "made": "NORMAL", "local": "NORMAL", "sum": "NORMAL", "getBoth": "NORMAL",
        "A": "NORMAL", "getNone": "GETTER", "tried": "TEST", "again": "TEST", "built": "GENERATED", "loop": "NORMAL",
    }
    whole = {(r["classFqn"], r["methodName"]): r for r in with_siblings(got).collect()}
    assert whole["B", "getX"]["category"] == "TEST" and whole["B", "getX"]["siblingMethods"] == []
    assert [s["methodName"] for s in whole["a.A", "setX"]["siblingMethods"]] == [n for n in re.findall(r"(\w+)\([^)]*\) {", text) if n != "setX"]
    assert whole["a.A", "setX"]["siblingMethods"][5]["signature"] == "void run(int a)" and whole["a.A", "setX"]["fileContent"] == text


def test_calls_of_bodies_in_place(spark):
    from lodestone.operators.syntax import calls_in_place

    at = DISK.index("{ read(); }")
    end = at + len("{ read(); }")
    rows = [(1, DISK, at, end, " read(); other(n); "), (2, DISK, at, end - 1, " write(n); "), (3, None, 0, 1, "x"), (4, DISK, at, end, None), (5, DISK, -1, 4, "x"), (6, DISK, at, 10_000, "x"), (7, DISK, 3, 9, "x();"), (8, DISK, None, 3, "x"), (9, DISK, at, end, "")]
    df = spark.createDataFrame(rows, "index int, fileContent string, bodyStartOffset int, bodyEndOffset int, generatedBody string").repartition(3)
    got = {r["index"]: (calls(r), r["error"]) for r in calls_in_place(df).collect()}
    assert got[1] == (["shop.io.Disk::read() -> byte[]", "<other>"], None) and got[2] == (["shop.io.Disk::write(int) -> void"], None) and got[9] == ([], None)
    assert {i: e for i, (c, e) in got.items() if not c} == {3: "no file content", 4: "no generated body", 5: "offsets outside the file", 6: "offsets outside the file", 7: "no method at the offset", 8: "offsets outside the file", 9: None}
