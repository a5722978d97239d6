"""Code and text functions as Column expressions; nothing here leaves the JVM.

Patterns follow Unicode word characters, as marked by ``(?U)``. ``ascii_only`` drops that
mark, for engines whose regular expressions know ASCII words only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
TOKEN = r"([a-zA-Z_]\w*|[0-9]+(?:\.[0-9]+)?|[^\s])"
CHUNK = r"[A-Za-z]+|[0-9]+|[^\s\w]|\s+"
JVM_TYPE = r"(\[*(?:[ZBCSIJFD]|L[^;]+;))"
STRINGS = (r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'")
NUMBERS = r"\b(?:0[xXbB])?[0-9][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[fFdDlL]?\b"
CUT_TOKENS = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>", "<|fim_pad|>", "<|endoftext|>")
KEYWORDS = (
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default",
    "do", "double", "else", "enum", "extends", "false", "final", "finally", "float", "for", "goto", "if", "implements",
    "import", "instanceof", "int", "interface", "long", "native", "new", "null", "package", "permits", "private", "protected",
    "public", "record", "return", "sealed", "short", "static", "strictfp", "super", "switch", "synchronized", "this",
    "throw", "throws", "transient", "true", "try", "var", "void", "volatile", "while", "yield",
)
#: Words that are literals and not names.
LITERALS = ("true", "false", "null")
#: Words as Unicode parts text: letters, digits and ``_`` together, and single signs between two letters or between two digits;
#: ideographs and Hiragana one by one, Katakana in runs.
_APART = r"\p{IsIdeographic}\p{IsHiragana}\p{IsKatakana}"
_LETTER = rf"[\p{{IsAlphabetic}}&&[^{_APART}]]"
WORDS = (
    rf"(?:(?:{_LETTER}|[\p{{Nd}}\p{{Pc}}])[\p{{M}}\p{{Cf}}]*+|(?<={_LETTER}[\p{{M}}\p{{Cf}}]{{0,8}})[.'\u2018\u2019\u2024\uFE52\uFF07\uFF0E:\u00B7\u0387\u055F\u05F4\u2027\uFE13\uFE55\uFF1A][\p{{M}}\p{{Cf}}]*+(?={_LETTER})"
    rf"|(?<=\p{{Nd}}[\p{{M}}\p{{Cf}}]{{0,8}})[.'\u2018\u2019\u2024\uFE52\uFF07\uFF0E,;\u037E\u0589\u060C\u060D\u066C\u07F8\u2044\uFE10\uFE14\uFF0C\uFF1B][\p{{M}}\p{{Cf}}]*+(?=\p{{Nd}}))++|[\p{{IsIdeographic}}\p{{IsHiragana}}][\p{{M}}\p{{Cf}}]*+|\p{{IsKatakana}}[\p{{IsKatakana}}\p{{M}}\p{{Cf}}]*+"
)
#: Longer words are cut into pieces of so many characters.
LONGEST_WORD = 255
#: Fixed value: finds local declarations.
DECLARATION = r"\b(?:(?:final\s+)?(?:var|int|long|float|double|boolean|byte|char|short|String|[A-Z]\w*(?:<[^>]*>)?))\s+(\w+)\s*[=;,)]"
#: Query terms that are never looked up.
STOP_TERMS = (
    "public", "private", "protected", "static", "final", "abstract", "void", "int", "long", "double", "float", "boolean",
    "char", "byte", "short", "class", "interface", "enum", "extends", "implements", "import", "package", "return", "if",
    "else", "for", "while", "do", "switch", "case", "break", "continue", "try", "catch", "finally", "throw", "throws",
    "new", "this", "super", "null", "true", "false",
    "string", "object", "list", "map", "set", "optional", "collection", "integer", "exception", "override", "deprecated",
    "get", "is", "has", "the", "and", "not", "java", "lang", "util",
    "logger", "log", "builder", "config", "service", "manager", "factory", "handler", "listener", "event", "plugin",
    "type", "name", "value", "result", "data", "info", "node", "context",
)
#: Type names that say nothing about a method.
STOP_TYPES = ("string", "object", "list", "map", "set", "optional", "integer", "boolean", "void", "exception", "override")


def _mode(ascii_only: bool) -> str:
    return "" if ascii_only else "(?U)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is made once a row: what a lambda takes from around it by its expression is made anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_comments(code) -> Column:
    """Line comments, then block comments; not aware of string literals."""
    return F.regexp_replace(F.regexp_replace(col(code), r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")


def collapse_whitespace(text) -> Column:
    """Each line's words joined by one blank; empty lines go."""
    lines = F.split(col(text), r"\R|[\x1c-\x1e]")
    tidy = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)[\s\x1f]+", " "), "^ | $", ""))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def normalize_code(code) -> Column:
    return collapse_whitespace(strip_comments(code))


def tokens(code, ascii_only: bool = False) -> Column:
    """Identifiers, numbers and single other characters."""
    return F.regexp_extract_all(col(code), F.lit(_mode(ascii_only) + TOKEN), F.lit(1))


def count_tokens(text, ascii_only: bool = False) -> Column:
    """Estimated model tokens: 0.85 per chunk of letters, digits, space or a sign, rounded half up, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.regexp_count(col(text), F.lit(_mode(ascii_only) + CHUNK)) * F.lit(0.85) + F.lit(0.5)).cast("int"))


def strip_identifiers(code, ascii_only: bool = False) -> Column:
    """Literals and lower-case names that are no keyword, as ``_``; so are ``true``, ``false`` and ``null``."""
    out = col(code)
    for pattern in (*STRINGS, _mode(ascii_only) + NUMBERS):
        out = F.regexp_replace(out, pattern, "_")
    kept = "|".join(k for k in KEYWORDS if k not in LITERALS)
    return F.regexp_replace(out, rf"{_mode(ascii_only)}\b(?!(?:{kept})\b)[a-z_]\w*\b", "_")


def unify_identifiers(code, ascii_only: bool = False) -> Column:
    """Names of local declarations as ``var1``, ``var2``, ... by first occurrence, all at once.

    The code is cut into words and what stands between; each word is looked up in the list of declared names."""
    mode = _mode(ascii_only)
    declared = F.regexp_extract_all(col(code), F.lit(mode + DECLARATION), F.lit(1))
    names = F.array_distinct(F.filter(declared, lambda x: ~x.isin(*KEYWORDS) & ~x.rlike(r"^\p{Lu}")))
    pieces = F.regexp_extract_all(col(code), F.lit(mode + r"\w+|\W+"), F.lit(0))
    shown = lambda x, known: F.coalesce(F.concat(F.lit("var"), F.nullif(F.array_position(known, x), F.lit(0)).cast("string")), x)
    return let(F.struct(pieces.alias("pieces"), names.alias("names")), lambda v: F.array_join(F.transform(v["pieces"], lambda x: shown(x, v["names"])), ""))


def body_block(body, most: int = 50) -> Column:
    """A body without its outer braces and blank edges, moved to the margin, ``most`` lines and a mark at most; null if nothing is left."""
    inner = F.regexp_replace(F.regexp_replace(col(body), r"^(?U)\s*\{?", ""), r"(?U)\}?\s*$", "")
    lines = F.split(inner, "\n")
    full = lambda x: x.rlike(r"(?U)\S")
    places = F.filter(F.transform(lines, lambda x, i: F.when(full(x), i)), lambda i: i.isNotNull())
    kept = F.slice(lines, F.array_min(places) + 1, F.array_max(places) - F.array_min(places) + 1)
    margin = F.array_min(F.transform(F.filter(kept, full), lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^(?U)\s+", ""))))
    moved = F.transform(kept, lambda x: F.when(F.length(x) >= margin, F.substring(x, margin + 1, F.length(x))).otherwise(x))
    cut = F.when(F.size(moved) > most, F.concat(F.slice(moved, 1, most), F.array(F.lit("    // ...")))).otherwise(moved)
    return F.when(F.size(places) > 0, F.array_join(cut, "\n"))


def cut_completion(text) -> Column:
    """Up to the first special token; white space at the end goes."""
    special = "|".join(t.replace("|", r"\|") for t in CUT_TOKENS)
    return F.regexp_replace(F.regexp_replace(col(text), f"(?s)(?:{special}).*", ""), r"(?U)\s+\z", "")


def simplify_signature(signature) -> Column:
    """Without access modifiers and package names."""
    plain = F.regexp_replace(col(signature), r"\b(?:public|private|protected)\s+", "")
    return F.regexp_replace(plain, r"\b(?:[a-z_][\w]*\.)+([A-Z]\w*)", "$1")


def simple_name(name) -> Column:
    """After the last dot, without generics."""
    return F.substring_index(F.substring_index(col(name), "<", 1), ".", -1)


def strip_generics(name) -> Column:
    return F.substring_index(col(name), "<", 1)


def short_invocation(signature) -> Column:
    """``a.b.Foo::bar(int)`` as ``Foo::bar``."""
    s = col(signature)
    head = F.substring_index(s, "(", 1)
    return F.when(F.contains(head, F.lit("::")), F.concat(simple_name(F.substring_index(head, "::", 1)), F.lit("::"), F.substring_index(head, "::", -1))).otherwise(head)


def invocation_owner(signature) -> Column:
    return F.substring_index(col(signature), "::", 1)


def invocation_method(signature) -> Column:
    """Method name of a signature ``owner::method(...)``; empty without ``::``."""
    s = col(signature)
    return F.when(F.contains(s, F.lit("::")), F.substring_index(F.element_at(F.split(s, "::"), 2), "(", 1)).otherwise(F.lit(""))


def canonical_invocation(signature) -> Column:
    """No blank after a comma before the first ``->``, single blanks after it, one around it."""
    s = col(signature)
    at = F.instr(s, "->")
    head = F.trim(F.regexp_replace(F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(s), r",\s+", ","))
    tail = F.trim(F.regexp_replace(F.substring(s, at + 2, F.length(s)), r"\s+", " "))
    return F.when(at > 0, F.concat(head, F.lit(" -> "), tail)).otherwise(head)


def vertex_id(class_fqn, name, params, returns) -> Column:
    """``class::name(p1,p2) -> ret``, canonical; without a return type ``void``."""
    return canonical_invocation(F.concat(col(class_fqn), F.lit("::"), col(name), F.lit("("), F.array_join(col(params), ","), F.lit(") -> "), F.coalesce(F.nullif(col(returns), F.lit("")), F.lit("void"))))


def type_tokens(text) -> Column:
    """Lower-cased distinct alphanumeric tokens of three letters or more that begin with a capital."""
    return F.array_distinct(F.transform(F.filter(F.split(col(text), "[^a-zA-Z0-9]+"), lambda x: (F.length(x) >= 3) & x.rlike(r"^\p{Lu}")), F.lower))


def generic_types(text) -> Column:
    """Simple names of the parts of a generic type, capitalised ones of three letters or more."""
    return F.filter(F.transform(F.split(col(text), r"[<>,\s]+"), simple_name), lambda x: (F.length(x) >= 3) & x.rlike(r"^\p{Lu}"))


def query_terms(texts) -> Column:
    """Lower-cased parts of three letters or more outside the stop list, in order, with repeats."""
    parts = F.split(F.lower(F.array_join(col(texts), " ")), "[^a-z0-9]+")
    return F.filter(parts, lambda x: (F.length(x) >= 3) & ~x.isin(*STOP_TERMS))


def parameter_types(params) -> Column:
    """Types of a parameter list with or without names: commas inside type arguments part nothing, package names go.

    The last word of a parameter is its name if there is another before it, it begins with no capital and holds no ``<``."""
    pieces = F.regexp_extract_all(F.coalesce(col(params), F.lit("")), F.lit(r"[<>,]|[^<>,]+"), F.lit(0))

    def add(have: Column, x: Column) -> Column:
        depth = have["depth"] + F.when(x == "<", 1).when(x == ">", -1).otherwise(0)
        parts = (x == ",") & (have["depth"] <= 0)
        return F.struct(depth.alias("depth"), F.when(parts, F.concat(have["done"], F.array(have["now"]))).otherwise(have["done"]).alias("done"), F.when(parts, "").otherwise(F.concat(have["now"], x)).alias("now"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    listed = F.aggregate(pieces, start, add, lambda have: F.concat(have["done"], F.array(have["now"])))
    given = F.filter(F.transform(listed, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    last = lambda p: F.regexp_extract(p, r"(?U)(\S+)$", 1)
    named = lambda p: p.rlike(r"(?U)\s") & ~last(p).rlike(r"^\p{Lu}") & ~F.contains(last(p), F.lit("<"))
    typed = F.transform(given, lambda p: F.when(named(p), F.regexp_replace(F.regexp_replace(p, r"(?U)\s+\S+$", ""), r"(?U)\s+", " ")).otherwise(p))
    return F.transform(typed, lambda p: F.regexp_replace(p, r"(?<![\w$])(?:[a-z][a-z0-9]*\.)+(?=[\w$])", ""))


def declaration_start(content, offset, reach: int = 500) -> Column:
    """Offset of the line in which the declaration of the body at ``offset`` begins, its annotations and comments included.

    Lines are looked at from the body upwards, over ``reach`` characters: a line of the brace alone belongs to the one above it, and
    so do lines above that begin with ``@``, ``//``, ``*`` or ``/*``. Where the window ends first, its start."""
    text, at = col(content), col(offset)
    low = F.greatest(at - reach, F.lit(0))
    lines = F.reverse(F.split(F.substring(text, low + 1, at - low), "\n"))

    def up(have: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        held = F.when(have["n"] == 0, True).when(have["bare"], True).otherwise(bare.rlike(r"^(?:@|//|\*|/\*)"))
        goes = have["goes"] & held
        taken = F.length(line) + F.when(have["n"] > 0, 1).otherwise(0)
        return F.struct((have["n"] + 1).alias("n"), goes.alias("goes"), (goes & (bare.isin("", "{")) & ((have["n"] == 0) | have["bare"])).alias("bare"), (have["back"] + F.when(goes, taken).otherwise(0)).alias("back"))

    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("goes"), F.lit(False).alias("bare"), F.lit(0).alias("back"))
    return (at - F.aggregate(lines, start, up, lambda have: have["back"])).cast("int")


def source_root(path) -> Column:
    """The folder of a path up to and with ``src/main/java``, the first if there are several; null without one."""
    p = F.translate(col(path), "\\", "/")
    return F.nullif(F.regexp_extract(p, r"(?i)^((?:.*?/)??src/main/java)(?:/|$)", 1), F.lit(""))


def source_key(fqn) -> Column:
    """Where a class stands in a coverage report: package folders, and the file of the first name with a capital (else of the last)."""
    parts = F.split(col(fqn), r"\.")
    first = F.coalesce(F.array_position(F.transform(parts, lambda p: p.rlike(r"^\p{Lu}")), True), F.lit(0)).cast("int")
    n = F.when(first > 0, first).otherwise(F.size(parts))
    return F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit(".java"))


def jvm_types(descriptor) -> Column:
    """Parameter types of a method descriptor: arrays as ``[]``, ``L...;`` with dots."""
    names = {"Z": "boolean", "B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double", "V": "void"}
    plain = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))

    def named(t: Column) -> Column:
        base = F.regexp_replace(t, r"^\[+", "")
        depth = F.length(t) - F.length(base)
        name = F.when(F.startswith(base, F.lit("L")), F.translate(F.substring(base, F.lit(2), F.length(base) - 2), "/", ".")).otherwise(F.try_element_at(plain, base))
        return F.concat(name, F.repeat(F.lit("[]"), depth))

    d = col(descriptor)
    valid = d.rlike(r"^\((?:\[*(?:[ZBCSIJFD]|L[^;]+;))*\)(?:\[*(?:[ZBCSIJFDV]|L[^;]+;))$")
    found = F.transform(F.regexp_extract_all(F.regexp_extract(d, r"^\(([^)]*)\)", 1), F.lit(JVM_TYPE), F.lit(1)), named)
    returned = named(F.regexp_extract(d, r"\)(.*)$", 1))
    return F.when(valid, F.struct(found.alias("params"), returned.alias("returns"))).otherwise(F.struct(F.array().cast("array<string>").alias("params"), F.lit("void").alias("returns")))


def test_class_of_path(path) -> Column:
    """Class name of a test source path, or null where no source root is met."""
    inner = F.regexp_extract(F.translate(col(path), "\\", "/"), r"(?:^|/)(?:src/test/java|src/test/kotlin|src/test/groovy|src/main/java)/(.+)\.(?:java|kt|groovy)$", 1)
    return F.when(inner != "", F.translate(inner, "/", "."))


def outer_class(fqn) -> Column:
    """Simple name of a class without package and without what it encloses."""
    return F.substring_index(F.substring_index(col(fqn), ".", -1), "$", 1)


def class_simple_name(fqn) -> Column:
    """Without package, enclosed class and one test suffix."""
    name = outer_class(fqn)
    out = name
    for suffix in ("Spec", "IT", "Test", "Tests"):
        out = F.when(F.endswith(name, F.lit(suffix)) & (F.length(name) > len(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(out)
    return out


def failed_test(name) -> Column:
    """(class, method) of a failed test's name, cut at the last dot; brackets after the method go. A name without a dot is a class."""
    n, dotted = col(name), F.contains(col(name), F.lit("."))
    last = F.regexp_replace(F.regexp_replace(F.substring_index(n, ".", -1), r"(?s)\[.*$", ""), r"(?s)\(.*$", "")
    return F.struct(F.when(dotted, F.regexp_extract(n, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(n).alias("test_class"), F.when(dotted, F.nullif(last, F.lit(""))).alias("test_method"))


def method_of_signature(signature) -> Column:
    """The name before the first bracket of a signature; empty without one."""
    return F.regexp_extract(F.coalesce(col(signature), F.lit("")), r"\b([A-Za-z_$][\w$]*)\s*\(", 1)


def module_of_path(path) -> Column:
    """First folder unless it is ``src``; else null."""
    first = F.substring_index(col(path), "/", 1)
    return F.when(F.contains(col(path), F.lit("/")) & (first != "src"), first)


def line_of_offset(content, offset) -> Column:
    """1-based line of a character offset."""
    return F.regexp_count(F.substring(col(content), F.lit(1), col(offset)), F.lit("\n")) + 1


def package_of(fqn) -> Column:
    return F.when(F.contains(col(fqn), F.lit(".")), F.regexp_extract(col(fqn), r"^(.*)\.[^.]*$", 1)).otherwise(F.lit("(default)"))


def call_simple_name(signature) -> Column:
    """Name of a call in any of three spellings: ``UNRESOLVED<x>``, ``a::b(...)``, ``obj.m``."""
    s = col(signature)
    head = F.substring_index(s, "(", 1)
    return F.when(s.rlike("^UNRESOLVED<.*>$"), F.regexp_extract(s, "^UNRESOLVED<(.*)>$", 1)).when(F.contains(head, F.lit("::")), F.substring_index(head, "::", -1)).otherwise(F.substring_index(head, ".", -1))


def api_class(exact: Column, project: Column) -> Column:
    """Share of exact calls outside the standard library: over 0.7 project, under 0.3 standard, else mixed."""
    share = F.try_divide(project.cast("double"), exact)
    return F.when(F.coalesce(exact, F.lit(0)) == 0, "no_invocations").when(share > 0.7, "project").when(share < 0.3, "standard").otherwise("mixed")


def complexity_class(n) -> Column:
    return F.when(col(n) <= 3, "simple").when(col(n) <= 10, "moderate").otherwise("complex")


def scaled_weight(weight, top, scale: str = "log") -> Column:
    """Edge weight in 0 to 1: ``log``, ``linear`` or ``binary``."""
    w, m = col(weight).cast("double"), col(top).cast("double")
    if scale == "binary":
        return F.when(w > 0, 1.0).otherwise(0.0)
    return F.try_divide(w, m) if scale == "linear" else F.try_divide(F.log1p(w), F.log1p(m))


def or_else(value, other) -> Column:
    """The first of two texts that is neither null nor empty."""
    return F.coalesce(F.nullif(col(value), F.lit("")), col(other))


def short_id(name, most: int = 90) -> Column:
    return F.when(F.length(col(name)) > most, F.concat(F.substring(col(name), 1, most - 1), F.lit("…"))).otherwise(col(name))


def path_is_suffix(a, b) -> Column:
    """Whether one path is the other or its tail, folder by folder."""
    x, y = F.split(F.translate(col(a), "\\", "/"), "/"), F.split(F.translate(col(b), "\\", "/"), "/")
    n = F.least(F.size(x), F.size(y))
    return F.slice(F.reverse(x), F.lit(1), n) == F.slice(F.reverse(y), F.lit(1), n)


def record_hash(generated, method_id) -> Column:
    """SHA-256 of ``{"generated": ..., "method_id": ...}`` as JSON with sorted keys."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.sha2(F.concat(F.lit('{"generated": '), quoted(col(generated)), F.lit(', "method_id": '), quoted(col(method_id)), F.lit("}")), 256)
