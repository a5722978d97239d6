"""Java sources as tables: tokens, the tree of their brackets, roles of names, and what types declare.

A source is cut into tokens by one pattern; all else is windows over (file, position). The depth of brackets is a running sum;
the bracket around a token is the last one opened at its depth, so one window makes the tree. Segments (what stands
between ``;`` and blocks) and pairs of angle brackets come from windows within a bracket, and kinds of braces from
the words of their segment. Types, methods, parameters and calls are groups of these rows. All windows are dealt by file, so tokens
are shuffled once; a task holds running values of a file and not the file.

Names are resolved by what sources declare and import; there is no class path.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import KEYWORDS, LITERALS
from lodestone.operators.dataset import category, siblings
from lodestone.session import shared_folder, stored

#: One token; loops are possessive, so that long literals take no stack.
LEXER = "|".join(
    (
        r'(?s:"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+""")', r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", r"(?s:/\*.*?\*/)", r"//[^\n]*+", r"[\p{L}_$][\p{L}\p{N}_$]*+",
        r"0[xX][0-9a-fA-F_.]++(?:[pP][+-]?[0-9_]++)?[lLfFdD]?", r"\.?[0-9](?:[eE][+-]?[0-9]|[0-9a-zA-Z_.])*+", r"->|::|\.\.\.|[=!<>]=|&&|\|\||\+\+|--|[-+*/%&|^]=", r"\s++", r"(?s:.)",
    )
)
#: What is no part of the tree, and what is a literal beside the words of ``LITERALS``.
SPACE, LITERAL = r"^(?:\s|/\*|//)", r"^[\"'0-9]|^\.[0-9]"
MODIFIERS = ("public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed")
PRIMITIVES = ("boolean", "byte", "char", "double", "float", "int", "long", "short", "void")
#: Words that are names wherever the grammar doesn't make them words of its own.
CONTEXTUAL = ("record", "permits", "sealed", "yield", "var")
SIGNS = tuple("@()[]{}.,;:?&|^=!<>+-*/%~") + ("->", "::", "...", "==", "<=", ">=", "!=", "&&", "||", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=")
TYPES = ("class", "interface", "enum", "record", "annotation")
_WORDS = tuple(sorted({*KEYWORDS, *LITERALS, *CONTEXTUAL, *MODIFIERS, *PRIMITIVES, *TYPES}))
_FIXED = frozenset((*SIGNS, *_WORDS))


def is_one_of(c: str, *values: str) -> Column:
    """Whether a column has one of the values; null has none."""
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def is_name(c: str) -> Column:
    """A name, and no keyword; contextual words count as names unless they start a declaration."""
    return F.coalesce(F.col(c).rlike(r"^[\p{L}_$]") & ~F.col(c).isin(*(k for k in KEYWORDS if k not in CONTEXTUAL)), F.lit(False))


def _when(condition: Column, value) -> Column:
    return F.when(condition, value if isinstance(value, Column) else F.col(value))


def _file():
    return Window.partitionBy("file").orderBy("pos")


def _cut(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(LEXER), F.lit(0))


def source_tokens(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(file, i, at, token): all tokens of each source, white space and comments too; ``at`` is their offset in code points.

    ``key`` names the source. A null text has no tokens; sources of one key are read as one after the other in no set order."""
    cut = sources.select(F.col(key).alias("file"), F.posexplode(_cut(text)).alias("i", "token"))
    return cut.withColumn("at", F.coalesce(F.sum(F.length("token")).over(Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _with_parents(rows: DataFrame, *held: str) -> DataFrame:
    """``up``: a struct of the bracket around each token (``pos`` and the columns held), null outside all.

    A bracket stands twice: as a member of the one around it, and as the opener of its own level."""
    opens = is_one_of("token", "(", "[", "{")
    closes = is_one_of("token", ")", "]", "}")
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(_file())
    level = F.col("depth") - F.when(opens, 1).otherwise(0)
    both = F.when(opens, F.array(F.struct(level.alias("level"), F.lit(False).alias("opener")), F.struct(F.col("depth").alias("level"), F.lit(True).alias("opener")))).otherwise(F.array(F.struct(level.alias("level"), F.lit(False).alias("opener"))))
    twice = rows.drop("up", "level").withColumn("depth", depth).withColumn("g", F.explode(both)).select("*", "g.*").drop("g")
    by = Window.partitionBy("file", "level").orderBy("pos", "opener").rowsBetween(Window.unboundedPreceding, 0)
    opened = twice.withColumn("up", F.last(_when(F.col("opener"), F.struct("pos", *held)), ignorenulls=True).over(by))
    # Outside all brackets nothing is open; a level that only stray closing brackets reach has no opener.
    return opened.filter(~F.col("opener")).drop("opener", "depth").withColumn("up", F.when(F.col("level") > 0, F.col("up")))


def _pairs() -> object:
    """Brackets of one depth in order: an opening one is followed by its closing one."""
    return Window.partitionBy("file", "pair", "bracket").orderBy("pos")


def syntax_tree(sources: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """One row per token that is no space or comment, with its neighbours, bracket, segment and flags.

    ``up`` is the bracket around it (position, token, the token before it, for braces their kind, flags); ``seg`` counts the
    segments of that bracket; ``close`` is the position of an opening bracket's partner. ``angle``: depth of type arguments.
    ``anno``: part of an annotation. ``kind`` of a brace: class, interface, enum, record, annotation, anonymous or block;
    ``named`` is the name of such a type. ``params``: an opening bracket of declared parameters; ``body``: a brace of a method's body.
    Unbalanced sources have rows like others: brackets then pair by depth."""
    return _tree(source_tokens(sources, key, text))


def _tree(tokens: DataFrame) -> DataFrame:
    """``syntax_tree`` of tokens (file, i, at, token)."""
    seen = tokens.filter(~F.col("token").rlike(SPACE))
    rows = seen.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("i")) - 1)
    near = {f"prev{k or ''}": F.lag("token", k or 1).over(_file()) for k in (0, 2)} | {f"next{k or ''}": F.lead("token", k or 1).over(_file()) for k in (0, 2)}
    rows = _with_parents(rows.withColumns(near), "token", "prev")
    opens, closes = is_one_of("token", "(", "[", "{"), is_one_of("token", ")", "]", "}")
    rows = rows.withColumns({"bracket": opens | closes, "pair": F.col("level")}).withColumns({"close": F.when(opens, F.lead("pos").over(_pairs()))})

    # Annotations, and what follows ``new``: chains of names that nothing else breaks.
    within = Window.partitionBy("file", "up.pos").orderBy("pos")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    at_chain = (is_one_of("token", "@") & ~is_one_of("next", "interface")) | is_one_of("token", ".") | (is_name("token") & is_one_of("prev", "@", "."))
    new_chain = is_name("token") & ~is_one_of("prev", ")") | is_one_of("token", "new", ".", "<", ">", ",", "?", "&", "extends", "super", "@", *PRIMITIVES)
    last = lambda condition, window: F.coalesce(F.last(_when(condition, "pos"), ignorenulls=True).over(window), F.lit(-1))
    rows = rows.withColumns({"l_at": last(is_one_of("token", "@") & ~is_one_of("next", "interface"), upto), "l_break": last(~at_chain, before), "l_new": last(is_one_of("token", "new"), upto), "n_break": last(~new_chain, before)})
    rows = rows.withColumns(
        {
            "anno": (F.col("l_at") > F.col("l_break")) & (at_chain | (is_one_of("token", "(") & is_name("prev"))),
            "made": (F.col("l_new") > F.col("n_break")) & is_one_of("token", "(") & (is_name("prev") | is_one_of("prev", ">")),
            "fresh": (F.col("l_new") > F.col("n_break")) & new_chain,
            "chooses": is_one_of("token", "(") & is_one_of("prev", "switch") & ~F.coalesce(F.col("prev2").isin("{", "}", ";", ":", ")", "else", "do"), F.lit(True)),
            "calls": is_one_of("token", "(") & (is_name("prev") | is_one_of("prev", ">")),
        }
    )
    flags = ("anno", "made", "chooses", "calls")
    rows = rows.withColumns({f: F.when(is_one_of("token", ")"), F.lag(f).over(_pairs())).otherwise(F.col(f)) for f in flags})
    # A brace that an expression holds ends no segment, and neither does the body of a constant.
    holds = F.lag("made").over(_file()) | F.lag("chooses").over(_file())
    rows = rows.withColumns({"anonymous": is_one_of("token", "{") & is_one_of("prev", ")") & F.coalesce(F.lag("made").over(_file()), F.lit(False)), "expr": is_one_of("token", "{") & (is_one_of("prev", "=", "]", ",", "(", "->", "return") | (is_one_of("prev", ")") & F.coalesce(holds, F.lit(False))) | (is_one_of("prev", "{") & (F.col("up.prev").isin("=", "]", ","))))})
    rows = rows.withColumn("constant", is_one_of("token", "{") & (is_name("prev") | (is_one_of("prev", ")") & F.coalesce(F.lag("calls").over(_file()), F.lit(False)))))
    rows = rows.withColumns({f: F.when(is_one_of("token", "}"), F.lag(f).over(_pairs())).otherwise(F.col(f)) for f in ("expr", "constant", "anonymous")})
    grouped = F.col("up").isNull() | (F.col("up.token") == "{")
    carries = F.col("expr") | (F.col("constant") & is_one_of("next", ",", ";")) | F.col("anonymous")
    ends = grouped & (is_one_of("token", ";") | (is_one_of("token", "}") & ~F.coalesce(carries, F.lit(False))))
    rows = rows.withColumn("ends", ends).withColumn("seg", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)))

    # Type arguments: angle brackets that pair within a run of what may stand between them.
    may = is_name("token") | is_one_of("token", ".", ",", "&", "[", "]", "<", ">", "extends", "super", "@", *PRIMITIVES) | (is_one_of("token", "?") & is_one_of("prev", "<", ","))
    rows = rows.withColumn("run", F.sum(F.when(may, 0).otherwise(1)).over(within))
    running = Window.partitionBy("file", "up.pos", "run").orderBy("pos")
    step = F.when(is_one_of("token", "<"), 1).when(is_one_of("token", ">"), -1).otherwise(0)
    rows = rows.withColumn("slope", F.sum(step).over(running) + F.when(is_one_of("token", ">"), 1).otherwise(0))
    paired = Window.partitionBy("file", "up.pos", "run", "slope", is_one_of("token", "<", ">")).orderBy("pos")
    rows = rows.withColumn("typed", (is_one_of("token", "<") & F.coalesce(F.lead("token").over(paired) == ">", F.lit(False))) | (is_one_of("token", ">") & F.coalesce(F.lag("token").over(paired) == "<", F.lit(False))))
    rows = rows.withColumn("angle", F.sum(F.when(F.col("typed"), step).otherwise(0)).over(running))
    rows = rows.withColumn("next_typed", F.coalesce(F.lead("typed").over(_file()), F.lit(False))).withColumn("prev_typed", F.coalesce(F.lag("typed").over(_file()), F.lit(False)))

    # What a segment has held so far decides the kind of a brace and which bracket declares parameters.
    segment = Window.partitionBy("file", "up.pos", "seg").orderBy("pos")
    so_far = segment.rowsBetween(Window.unboundedPreceding, -1)
    declares = (is_one_of("token", "class", "interface", "enum") & ~is_one_of("prev", ".")) | (is_one_of("token", "record") & is_name("next") & is_one_of("next2", "(", "<"))
    word = F.when(is_one_of("token", "interface") & is_one_of("prev", "@"), "annotation").otherwise(F.col("token"))
    rows = rows.withColumns(
        {
            "declared": F.last(_when(declares, F.struct(word.alias("kind"), F.col("next").alias("named"))), ignorenulls=True).over(so_far),
            "barred": F.coalesce(F.max(F.when(is_one_of("token", "=", "->", "new", "return", "throw", "yield") | declares, 1)).over(so_far), F.lit(0)) == 1,
            "brackets": F.coalesce(F.sum(F.when(is_one_of("token", "(") & ~F.col("anno"), 1)).over(so_far), F.lit(0)),
            "clause": F.last(_when(is_one_of("token", "extends", "implements", "throws", "permits") & (F.col("angle") == 0), "token"), ignorenulls=True).over(so_far),
            "first": F.first("token").over(segment),
        }
    )
    rows = rows.withColumn("params", is_one_of("token", "(") & ~F.col("anno") & ~F.col("barred") & (F.col("brackets") == 0) & is_name("prev") & grouped)
    rows = rows.withColumn("headed", F.coalesce(F.max(F.when(F.col("params"), 1)).over(so_far), F.lit(0)) == 1)
    rows = rows.withColumns({"kind": F.when(is_one_of("token", "{"), F.when(F.col("anonymous"), "anonymous").when(F.col("declared").isNotNull() & ~F.col("expr"), F.col("declared.kind")).otherwise("block")), "named": F.when(is_one_of("token", "{"), F.col("declared.named"))})
    rows = _with_parents(rows, "token", "prev", "kind", "named")
    # Bodies of constants are known by the enum around them, so parents are told once more.
    constants = (F.col("up.kind") == "enum") & (F.col("seg") == 0)
    rows = rows.withColumn("kind", F.when((F.col("kind") == "block") & F.col("constant") & constants, "anonymous").otherwise(F.col("kind")))
    rows = _with_parents(rows, "token", "prev", "kind", "named", "seg")
    in_type = F.coalesce(F.col("up.kind").isin(*TYPES, "anonymous"), F.lit(False)) & ~F.coalesce(constants, F.lit(False))
    rows = rows.withColumn("params", F.col("params") & in_type).withColumn("body", F.coalesce((F.col("kind") == "block") & F.col("headed") & in_type, F.lit(False)))
    return rows.drop("l_at", "l_break", "n_break", "depth", "slope", "run", "brackets", "pair", "bracket", "headed", "chooses", "calls", "declared", "level")


def _type_role() -> Column:
    """Whether a name stands for a type, by what stands beside it."""
    follows = is_name("next2") | F.coalesce(F.col("next2").rlike(r"^[\"'0-9]|^\.[0-9]"), F.lit(False)) | is_one_of("next2", "(", "!", "~", "this", "super", "new", "switch", *LITERALS)
    cast = is_one_of("prev", "(") & is_one_of("next", ")") & follows & (F.col("up.token") == "(") & ~(is_one_of("prev2", ">", "]", ")", "if", "while", "for", "switch", "catch", "synchronized") | is_name("prev2"))
    plain = is_name("next") | is_one_of("next", "...") | (is_one_of("next", "[") & is_one_of("next2", "]")) | (is_one_of("next", "<") & F.col("next_typed"))
    listed = F.col("clause").isNotNull() & (F.col("angle") == 0) & is_one_of("prev", ",", "extends", "implements", "throws", "permits")
    caught = is_one_of("next", "|") & (F.col("up.prev") == "catch")
    return plain | (F.col("angle") > 0) | is_one_of("prev", "new", "instanceof", "extends", "implements", "throws", "permits") | listed | F.coalesce(caught, F.lit(False)) | F.coalesce(cast, F.lit(False))


def variable() -> Column:
    """Whether a row of ``syntax_tree`` is a variable's name: no type, no called name, receiver or field, no declared name but a variable's."""
    constant = (F.col("up.kind") == "enum") & (F.col("up.seg").isNotNull()) & (F.col("seg") == 0) & (F.col("angle") == 0) & ~F.col("anno") & (is_one_of("prev", "{", ",") | (is_one_of("prev", ")") & ~is_one_of("next", ".")))
    beside = is_one_of("next", "(", ".") | is_one_of("prev", ".", "@", "class", "interface", "enum", "record", "package", "import") | (is_one_of("prev", "static") & (F.col("first") == "import"))
    return is_name("token") & ~(beside | F.col("anno") | _type_role() | F.coalesce(constant, F.lit(False))) & ~is_one_of("token", *CONTEXTUAL)


def token_kind(token: Column) -> Column:
    """All that the tree goes by: signs and words of the language as they are, a name as ``x``, a literal as ``0``, space and comments as a blank, others as ``#``."""
    return F.when(token.isin(*SIGNS, *_WORDS), token).when(token.rlike(r"^[\p{L}_$]"), "x").when(token.rlike(SPACE), " ").when(token.rlike(LITERAL), "0").otherwise("#")


def strip_by_syntax(sources: DataFrame, key: str = "path", text: str = "text", crowd: int = 1 << 10) -> DataFrame:
    """(file, stripped): sources with literals and variables as ``_``; types, called names, receivers, fields and keywords stay.

    Kept are names before ``(`` or beside ``.``, names of declared types, methods and constants, annotations, packages and imports,
    and names in the place of a type. Each source is put together again in one row. A source without tokens has no row.

    Sources of one shape (the kinds of their tokens in order, told by SHA-256) have one tree, which is made once. Shapes of more than ``crowd``
    sources are broadcast (they have a ``crowd``-th of all tokens at most), others meet their sources by a shuffle."""
    cut = sources.select(F.col(key).alias("file"), F.col(text).alias("text")).withColumn("tokens", _cut("text"))
    told = cut.withColumn("kinds", F.array_join(F.transform("tokens", token_kind), "\x01"))
    # Never null, and no filter on kinds: one would be moved to where the sources are read, before they are dealt.
    shape = F.coalesce(F.unhex(F.sha2("kinds", 256)), F.lit(b"")).alias("shape")
    shapes = stored(told.groupBy("kinds").agg(F.count("*").alias("n")).select(shape, "n", F.when(F.col("kinds") != "", F.split("kinds", "\x01")).alias("k")))
    tokens = shapes.select(F.col("shape").alias("file"), "n", F.posexplode("k").alias("i", "token"))
    tree = _tree(tokens.select("file", "i", F.col("i").alias("at"), "token"))
    roles = tree.filter(F.col("token").isin("0", *LITERALS) | variable()).select("file", "i", F.lit(True).alias("blank"))
    marked = tokens.join(roles, ["file", "i"], "left").groupBy("file").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", F.coalesce("blank", F.lit(False)).alias("b")))).alias("bs"))  # one shape's tokens
    masks = stored(marked.select(F.col("file").alias("shape"), "n", F.col("bs.b").alias("blank")))
    crowds = masks.agg(F.count_if(F.col("n") > crowd).alias("often"), F.count("*").alias("all")).first()
    often, seldom = F.broadcast(masks.filter(F.col("n") > crowd).drop("n")), masks.filter(F.col("n") <= crowd).drop("n")
    out = lambda tokens: F.array_join(F.transform(tokens, lambda t, i: F.when(F.get("blank", i), "_").otherwise(t)), "").alias("stripped")
    crowded = told.select("file", "tokens", shape).join(often, "shape").select("file", out("tokens"))
    if crowds["often"] and crowds["often"] == crowds["all"]:
        return crowded
    texts = told.select("file", "text", shape)
    rest = (texts.join(often, "shape", "left_anti") if crowds["often"] else texts).join(seldom, "shape").select("file", out(_cut("text")))
    return crowded.unionByName(rest) if crowds["often"] else rest


def type_text(tokens: Column) -> Column:
    """Tokens of a type as one string: blanks only between words, behind ``?`` and around ``&``."""

    def join(have: Column, token: Column) -> Column:
        apart = have.rlike(r"[\p{L}\p{N}_$?]$") & token.rlike(r"^[\p{L}_$]")
        return F.when(token == "&", F.concat(have, F.lit(" & "))).when(apart, F.concat(have, F.lit(" "), token)).otherwise(F.concat(have, token))

    return F.aggregate(tokens, F.lit(""), join)


def _ordered(*columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("pos", *columns)))


def _nested(rows: DataFrame, level: str) -> DataFrame:
    """Rows (file, pos, level, ...) with ``around``: of each level down to its own the last row that stands before, outermost first."""
    own = [c for c in rows.columns if c != "file"]
    listed = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in own if c != "pos")))).alias("all"))  # the types or methods of one source
    one = listed.select("file", "all", F.explode("all").alias("r"))
    around = F.expr(f"transform(sequence(1, r.{level}), j -> element_at(filter(all, x -> x.{level} = j and x.pos <= r.pos), -1))")
    return one.select("file", *(F.col(f"r.{c}").alias(c) for c in own), around.alias("around"))


@cache
def _lexer() -> re.Pattern:
    """``LEXER`` for tasks: Python has no classes of Unicode, ``\\s`` for ASCII alone and ``.`` without all ends of lines, so these are spelled out."""
    numbers = "".join(c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) in ("No", "Nl"))  # no names start with them
    name = rf"[A-Za-z_$][\w$]*+|(?![\x00-\x7F{numbers}])[^\W\d][\w$]*+"
    dot = r"(?:\\[^\n\r\x85\u2028\u2029][^"
    return re.compile(LEXER.replace(r"[\p{L}_$][\p{L}\p{N}_$]*+", name).replace(r"(?:\\.[^", dot).replace(r"\s++", r"[ \t\n\x0B\f\r]++"))


def told_source(text: str) -> tuple[str, list[str], list[int]]:
    """(kinds, names, braces) of a source, as in ``_shaped``."""
    at, kinds, names, braces = 0, [], {}, []
    for t in _lexer().findall(text):
        c = t[0]
        if t in _FIXED:
            kinds.append(t)
            if c in "{}":
                braces.append(at)
        elif c in " \t\n\x0b\f\r" or (c == "/" and len(t) > 1):  # comments: other tokens of two signs are fixed
            pass
        elif c in "_$" or c.isalpha():
            kinds.append(f"{'X' if unicodedata.category(c) == 'Lu' else 'x'}{names.setdefault(t, len(names) + 1)}_")
        else:
            kinds.append(".0" if c == "." else "0" if c in "\"'0123456789" else "#" if c == "\x01" else t)
        at += len(t)
    return "\x01".join(kinds), list(names), braces


def told_tokens(text: str, names: dict[str, int], literals: dict[str, int]) -> str:
    """The tokens of a source but spaces and comments, behind ``\\x01`` each but the first: a name as ``x1_``, a literal as ``01_``, by its place in the dicts
    given, which take in new ones; the sign ``\\x01`` as ``#1``. Texts told with the same dicts have equal tokens where these are equal."""
    kinds = []
    for t in _lexer().findall(text):
        c = t[0]
        if t in _FIXED:
            kinds.append(t)
        elif c in " \t\n\x0b\f\r" or (c == "/" and len(t) > 1):
            pass
        elif c in "_$" or c.isalpha():
            kinds.append(f"x{names.setdefault(t, len(names) + 1)}_")
        elif c in "\"'0123456789" or (c == "." and len(t) > 1):
            kinds.append(f"0{literals.setdefault(t, len(literals) + 1)}_")
        else:
            kinds.append("#1" if c == "\x01" else t)
    return "\x01".join(kinds)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (file, text) with ``told_source`` of their texts, a few rows at a time."""
    kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()))
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            told = [(None, None, None) if x is None else told_source(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, k) for x, k in zip(zip(*told, strict=True), kinds, strict=True))], ["file", "text", "kinds", "names", "braces"])


def _shaped(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(id, file, text, kinds, shape, names, braces), a row each source, kept as Parquet.

    ``names``: its own names in order of first use. ``kinds``: its tokens but spaces and comments, an own name as its place in ``names``
    behind a letter of its case, a literal as ``0``. Sources that differ in names, literals and comments alone have one ``shape``, the
    SHA-256 of ``kinds``. ``braces``: offsets of all braces in code points. A null text has no shape."""
    cut = sources.select(F.col(key).alias("file"), F.make_valid_utf8(text).alias("text"))
    told = cut.mapInArrow(_told, T.StructType([*cut.schema.fields, T.StructField("kinds", T.StringType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("braces", T.ArrayType(T.IntegerType()))]))
    rows = told.select(F.monotonically_increasing_id().alias("id"), "file", "text", "kinds", F.unhex(F.sha2("kinds", 256)).alias("shape"), "names", "braces")
    path = f"{shared_folder(sources.sparkSession)}/sources-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return sources.sparkSession.read.parquet(path)


def _pieces(text: Column) -> Column:
    """A text of a shape cut at its names, once a shape: strings as they stand (``s``), and places in the names of a source (``i``)."""
    found = F.regexp_extract_all(text, F.lit(r"[xX][0-9]+_|(?:[^xX]|[xX](?![0-9]))+"), F.lit(0))
    named = lambda t: t.rlike("^[xX][0-9]")
    return F.transform(found, lambda t: F.struct(F.when(~named(t), t).alias("s"), F.when(named(t), F.substring(t, F.lit(2), F.length(t) - 2)).cast("int").alias("i")))


def _spelled(pieces: Column, names: str = "names") -> Column:
    """``_pieces`` with the names of a source in their places."""
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(p["s"], F.get(names, p["i"] - 1))), "")


def _all_pieces(texts: Column) -> Column:
    return F.transform(texts, lambda t: _pieces(t))


def _each(texts: Column) -> Column:
    return F.transform(texts, lambda t: _spelled(t))


def extract(sources: DataFrame, key: str = "path", text: str = "text", crowd: int = 1 << 10) -> DataFrame:
    """One row per method with a body of the classes, interfaces and enums of Java sources, in the schema of method documents.

    ``invocations`` are in order of visit: a call before its receiver, that before its arguments. An unqualified call (of the
    innermost type around it that has such a method), one on a type, or one on a parameter, local variable or field of a plain type is EXACT where one method of that name and number of
    parameters is declared by that type in the sources; others are UNRESOLVED<name>. Types are written as in the source.
    ``category`` is that of ``dataset.category``; ``with_siblings`` adds the other methods of the type.

    What a source's shape tells (``_shaped``) is found once a shape: up to "Resolution", ``file`` is a shape and names are places in the
    names of a source. Shapes of more than ``crowd`` sources are broadcast (they have a ``crowd``-th of all tokens at most), others meet
    their sources by a shuffle. Calls are resolved across all sources by their names in full."""
    shaped = _shaped(sources, key, text)
    shapes = stored(shaped.filter("kinds <> ''").groupBy("shape", "kinds").agg(F.count("*").alias("n")))
    tokens = shapes.select(F.col("shape").alias("file"), F.posexplode(F.split("kinds", "\x01")).alias("i", "token"))
    brace = is_one_of("token", "{", "}").cast("int")
    tree = stored(_tree(tokens.withColumn("at", F.coalesce(F.sum(brace).over(Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))))
    up = F.col("up.pos").alias("up")

    # Types, with the names around them, package and imports.
    type_open = F.coalesce(F.col("kind").isin("class", "interface", "enum"), F.lit(False))
    any_type = F.coalesce(F.col("kind").isin(*TYPES), F.lit(False))
    marked = tree.withColumn("span", F.when(is_one_of("token", "{") & any_type, F.struct("pos", "close")))
    steps = marked.filter("span is not null").select("file", F.explode(F.array(F.struct(F.col("pos").alias("p"), F.lit(1).alias("d")), F.struct(F.coalesce("close", F.lit(1 << 30)).alias("p"), F.lit(-1).alias("d")))).alias("s")).select("file", "s.*")
    depth = steps.withColumn("level", F.sum("d").over(Window.partitionBy("file").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))).filter("d = 1").select("file", F.col("p").alias("pos"), "level")
    opened = tree.filter(is_one_of("token", "{") & any_type).select("file", "pos", "kind", "named", up, "seg").join(depth, ["file", "pos"])
    types = _nested(opened, "level").withColumn("path", F.array_join("around.named", "."))
    root = tree.filter("up is null and first in ('package', 'import') and token not in ('package', 'import', 'static', ';')").groupBy("file", "seg", "first").agg(_ordered("token").alias("t"))
    named = root.select("file", "seg", "first", F.regexp_replace(F.array_join("t.token", ""), r"\.\*$", "").alias("name"), F.array_join("t.token", "").endswith("*").alias("wild"))
    heads = named.groupBy("file").agg(F.max(F.when(F.col("first") == "package", F.col("name"))).alias("package"), F.transform(F.array_sort(F.collect_list(F.when(F.col("first") == "import", F.struct("seg", "name", "wild")))), lambda x: F.struct(x["name"].alias("name"), x["wild"].alias("wild"))).alias("imported"))
    types = types.join(heads, "file", "left").withColumn("classFqn", F.concat_ws(".", "package", "path")).withColumn("imported", F.coalesce("imported", F.array().cast("array<struct<name:string,wild:boolean>>")))

    # Headers: the tokens of a segment that stand directly in a type or beside its keyword.
    header = tree.filter(F.col("up").isNull() | F.col("up.kind").isin(*TYPES) | F.col("first").isin("class", "interface", "enum", *MODIFIERS)).filter(~F.col("anno"))
    segments = header.groupBy("file", up, "seg").agg(_ordered("token", "angle", "params", "kind", "expr", "clause").alias("t"))
    until = lambda t, p: F.filter(t, lambda x: x["pos"] < p)
    joined = types.alias("y").join(segments.alias("s"), (F.col("y.file") == F.col("s.file")) & F.col("y.up").eqNullSafe(F.col("s.up")) & (F.col("y.seg") == F.col("s.seg")), "left").select("y.*", "s.t")
    supers = F.filter(until(F.col("t"), F.col("pos")), lambda x: x["clause"].isin("extends", "implements") & (x["token"] != "permits"))
    listed = F.filter(F.transform(_split(supers), type_text), lambda x: x != "")
    types = stored(joined.select("file", "pos", "kind", "classFqn", "path", "package", "imported", listed.alias("supertypes")))

    # Methods: braces of bodies whose bracket of parameters stands in the same segment.
    kept = tree.filter("body and up.kind in ('class', 'interface', 'enum')")
    ends = tree.filter("token = '}'").select("file", F.col("pos").alias("close"), F.col("at").alias("closing"))
    bodies = kept.select("file", "pos", up, "seg", "close", F.col("at").alias("opened")).join(ends, ["file", "close"])
    signed = bodies.join(segments, ["file", "up", "seg"])
    head = until(F.col("t"), F.col("pos"))
    place = F.array_position(F.transform(head, lambda x: x["params"]), True).cast("int")
    signed = signed.withColumn("head", head).withColumn("place", place).withColumn("left", F.slice("head", 1, F.col("place") - 2)).withColumn("opening", F.get("head", F.col("place") - 1)["pos"]).withColumn("methodName", F.get("head", F.col("place") - 2)["token"])
    modifiers = F.filter(F.transform("left", lambda x: x["token"]), lambda x: x.isin(*MODIFIERS))
    rest = F.filter("left", lambda x: ~x["token"].isin(*MODIFIERS))
    after = F.coalesce(F.array_position(F.transform(rest, lambda x: (x["token"] == ">") & (x["angle"] == 0)), True).cast("int"), F.lit(0))
    returns = F.when(F.get(rest, F.lit(0))["token"] == "<", F.slice(rest, after + 1, F.greatest(F.size(rest) - after, F.lit(0)))).otherwise(rest)
    thrown = F.filter("head", lambda x: (x["clause"] == "throws") & (x["token"] != "throws"))
    methods = signed.select("file", "pos", "up", "close", "opening", "methodName", "opened", "closing", modifiers.alias("modifiers"), F.when(F.size(returns) > 0, type_text(F.transform(returns, lambda x: x["token"]))).alias("returnType"), F.transform(_split(thrown), type_text).alias("thrownExceptions"))

    # Parameters: what stands between commas of the declaring bracket.
    inside = tree.filter("up.token = '('").select("file", up, "pos", "token", "angle", "anno")
    comma = is_one_of("token", ",") & (F.col("angle") == 0)
    inside = inside.withColumn("nth", F.coalesce(F.sum(comma.cast("int")).over(Window.partitionBy("file", "up").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(~comma)
    arity = inside.groupBy("file", "up").agg(F.count_distinct("nth").cast("int").alias("arity"))
    declared = inside.join(methods.select("file", F.col("opening").alias("up")), ["file", "up"], "left_semi").filter("not anno and token <> 'final'").groupBy("file", "up", "nth").agg(_ordered("token").alias("t"))
    words = F.transform("t", lambda x: x["token"])
    name_at = F.array_max(F.transform(words, lambda x, i: F.when(x.rlike(r"^[\p{L}_$]"), i)))
    cut = F.filter(F.slice(words, 1, name_at), lambda x: x != "...")
    parameter = F.struct("nth", type_text(cut).alias("type"), F.get(words, name_at).alias("name"), F.array_contains(words, "...").alias("more"))
    parameters = declared.select("file", "up", parameter.alias("p")).groupBy("file", F.col("up").alias("opening")).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    none = F.array().cast("array<struct<nth:bigint,type:string,name:string,more:boolean>>")
    methods = methods.join(parameters, ["file", "opening"], "left").withColumn("ps", F.coalesce("ps", none))
    shown = F.transform("ps", lambda p: F.concat(p["type"], F.when(p["more"], "...").otherwise(""), F.lit(" "), p["name"]))
    signature = F.concat(F.array_join(F.transform("modifiers", lambda m: F.concat(m, F.lit(" "))), ""), F.when(F.col("returnType").isNotNull(), F.concat("returnType", F.lit(" "))).otherwise(""), "methodName", F.lit("("), F.array_join(shown, ", "), F.lit(")"))
    # Types and methods are read by all that follows, so they are stored: a row each.
    methods = stored(methods.withColumns({"methodSignature": signature, "parameterTypes": F.transform("ps", lambda p: F.concat(p["type"], F.when(p["more"], "[]").otherwise("")))}))

    # Fields, and statements of bodies.
    plain = segments.filter(~F.exists("t", lambda x: x["params"] | F.coalesce(x["kind"].isin(*TYPES) | ((x["kind"] == "block") & ~x["expr"]), F.lit(False)))).join(types.filter(type_open).select("file", F.col("pos").alias("up"), F.col("kind").alias("of")), ["file", "up"]).filter("of <> 'enum' or seg > 0")
    tokens = F.filter("t", lambda x: ~x["token"].isin(*MODIFIERS, ";", "{", "}"))
    parts = plain.select("file", "up", "seg", _split(tokens).alias("d"))
    before_value = lambda d: F.when(F.array_position(d, "=") > 0, F.slice(d, 1, F.array_position(d, "=").cast("int") - 1)).otherwise(d)
    first = before_value(F.get("d", F.lit(0)))
    at_name = F.array_max(F.transform(first, lambda x, i: F.when(x.rlike(r"^[\p{L}_$]"), i)))
    names = F.concat(F.array(F.get(first, at_name)), F.transform(F.slice("d", 2, F.greatest(F.size("d") - 1, F.lit(0))), lambda d: F.get(d, F.lit(0))))
    fields = parts.filter(F.size("d") > 0).select("file", "up", "seg", type_text(F.slice(first, 1, at_name)).alias("typeFqn"), F.posexplode(names).alias("n", "name")).filter("typeFqn <> '' and name is not null")
    by_type = fields.groupBy("file", F.col("up").alias("owner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "n", "name", "typeFqn"))), lambda x: F.struct(x["name"].alias("name"), x["typeFqn"].alias("typeFqn"))).alias("classFields"))
    goes_on = is_one_of("next", "else", "catch", "finally") | (is_one_of("token", "}") & (F.col("first") == "do")) | (is_one_of("next", "while") & (F.col("first") == "do"))
    stops = tree.filter(F.col("ends") & ~goes_on & F.coalesce(F.col("up.kind") == "block", F.lit(False))).groupBy("file", F.col("up.pos").alias("pos")).agg(F.count("*").cast("int").alias("statementCount"))

    # What the category of a method goes by: annotations, and of a single statement what it is and what it consists of.
    notes = tree.filter(F.col("anno") & ~is_one_of("token", "(", ")") & F.coalesce(F.col("up.kind").isin(*TYPES), F.lit(False))).groupBy("file", up, "seg").agg(F.array_join(_ordered("token")["token"], "").alias("a"))
    notes = notes.select("file", "up", "seg", F.filter(F.split("a", "@"), lambda x: x != "").alias("annotations"))
    direct = tree.select("file", F.col("up.pos").alias("pos"), F.col("pos").alias("at_"), "token", "angle").join(stops.filter("statementCount = 1").select("file", "pos"), ["file", "pos"], "left_semi").join(kept.select("file", "pos"), ["file", "pos"], "left_semi")
    told = direct.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("at_", "token", "angle"))).alias("s"))  # the tokens of one statement
    word = F.transform("s", lambda x: x["token"])
    plain_word = lambda x: x["token"].rlike(r"^[\p{L}_$]")
    rest_ = F.filter("s", lambda x: ~x["token"].isin("return", ";") & (x["angle"] == 0) & (x["token"] != ">"))
    chain = F.forall(rest_, lambda x: x["token"].isin(".", "(", ")", "this", "super") | (plain_word(x) & ~x["token"].isin(*(k for k in KEYWORDS if k not in CONTEXTUAL))))
    # Two words in a row are a declaration and no call.
    spread = F.exists(F.sequence(F.lit(1), F.greatest(F.size(rest_), F.lit(1))), lambda i: F.coalesce(plain_word(F.get(rest_, i)) & plain_word(F.get(rest_, i - 1)), F.lit(False)))
    ends_in = F.element_at(F.filter(word, lambda x: x != ";"), -1)
    assigns = F.exists(word, lambda x: x.isin("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="))
    part = F.when(assigns & ~spread, "assignment").when(chain & ~spread & (ends_in == ")"), "call").otherwise("other")
    control = ("if", "for", "while", "do", "switch", "try", "throw", "synchronized", "assert", "break", "continue", "class", "{", ";", "yield")
    shape = F.when(F.get(word, F.lit(0)) == "return", "return").when(~spread & ~F.get(word, F.lit(0)).isin(*control) & ~(F.get(word, F.lit(0)).isin("this", "super") & (F.get(word, F.lit(1)) == "(")), "expression").otherwise("other")
    told = told.select("file", "pos", shape.alias("statementKind"), part.alias("statementPart"), F.try_element_at(F.filter("s", lambda x: x["token"] == "("), F.lit(-1))["at_"].alias("call_at"))
    told = told.join(arity.withColumnRenamed("up", "call_at"), ["file", "call_at"], "left").select("file", "pos", "statementKind", "statementPart", F.coalesce("arity", F.lit(0)).alias("nArguments"))

    # Calls and types in bodies: each belongs to all methods around it.
    spans = methods.select("file", "pos", "close").select("file", F.explode(F.array(F.struct(F.col("pos").alias("p"), F.lit(1).alias("d")), F.struct(F.col("close").alias("p"), F.lit(-1).alias("d")))).alias("s")).select("file", "s.*")
    turned = tree.join(spans.withColumnRenamed("p", "pos"), ["file", "pos"], "left").withColumn("inside", F.sum(F.coalesce("d", F.lit(0))).over(_file().rowsBetween(Window.unboundedPreceding, 0)))
    owned = turned.withColumn("owner", F.last(_when(F.col("d") == 1, "pos"), ignorenulls=True).over(Window.partitionBy("file", "inside").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).filter("inside > 0")
    levels = owned.filter("d = 1").select("file", "pos", F.col("inside").cast("int").alias("level"))
    ancestors = stored(_nested(levels, "level").select("file", F.col("pos").alias("owner"), F.explode("around.pos").alias("method")))

    head_of_call = (is_name("token") & is_one_of("next", "(")) | (is_one_of("token", "this", "super") & is_one_of("next", "("))
    starts = (is_name("token") | is_one_of("token", "this", "super", "new", *LITERALS) | F.col("token").rlike(r"^[\"'0-9]")) & ~is_one_of("prev", ".", "new", "::") & (F.col("angle") == 0) & ~F.col("prev_typed") | (is_one_of("token", "(") & ~(is_name("prev") | is_one_of("prev", ">", "]", ")", "this", "super")))
    chained = owned.withColumn("chain", F.last(_when(starts, "pos"), ignorenulls=True).over(Window.partitionBy("file", "up.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    following = lambda c: F.lead(c).over(_file())
    chained = chained.withColumns({"of_anno": following("anno"), "of_params": following("params"), "of_made": following("made"), "opens_at": following("pos"), "prev3": F.lag("token", 3).over(_file())})
    named_calls = chained.filter(head_of_call & ~F.col("of_anno") & ~F.col("of_params") & ~F.col("of_made") & ~is_one_of("prev", "record")).select("file", "owner", "pos", F.coalesce("chain", "pos").alias("chain"), F.col("opens_at").alias("up"), F.col("token").alias("name"), F.lit(False).alias("new"), F.when(is_one_of("prev", "."), F.when(is_one_of("prev2", "this") | (is_name("prev2") & ~is_one_of("prev3", ".")), F.col("prev2")).otherwise(".")).alias("on"))
    made_at = chained.filter("made and token = '('").select("file", "owner", F.col("l_new").alias("pos"), F.col("pos").alias("up"))
    made_of = tree.filter("fresh and token <> 'new'").groupBy("file", F.col("l_new").alias("pos")).agg(_ordered("token").alias("t"))
    made = made_at.join(made_of, ["file", "pos"]).select("file", "owner", "pos", F.col("pos").alias("chain"), "up", type_text(F.transform(F.filter("t", lambda x: x["pos"] < F.col("up")), lambda x: x["token"])).alias("name"), F.lit(True).alias("new"), F.lit(None).cast("string").alias("on"))
    calls = named_calls.unionByName(made).join(arity, ["file", "up"], "left").withColumn("arity", F.coalesce("arity", F.lit(0)))
    calls = stored(calls.join(ancestors, ["file", "owner"]))

    # A qualified type is written as a whole, from the first of its dotted names.
    dotted = owned.filter((is_name("token") | is_one_of("token", ".")) & ~F.col("anno") & ~is_one_of("token", "var")).withColumn("from", F.last(_when(is_name("token") & ~is_one_of("prev", "."), "pos"), ignorenulls=True).over(Window.partitionBy("file", "up.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    typed = dotted.withColumn("to", F.when(is_name("token") & _type_role() & ~(is_one_of("next", ".") & ~F.col("next_typed")), F.col("pos"))).groupBy("file", "owner", F.col("from").alias("pos")).agg(F.max("to").alias("to"), _ordered("token").alias("t")).filter("to is not null")
    used = typed.select("file", "owner", "pos", F.array_join(F.transform(F.filter("t", lambda x: x["pos"] <= F.col("to")), lambda x: x["token"]), "").alias("token")).join(ancestors, ["file", "owner"])
    used = used.groupBy("file", F.col("method").alias("pos")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(used["pos"], "token"))), lambda x: x["token"])).alias("usedTypes"))

    # Resolution: the type that a call is on, its name in full, and the one method that fits.
    base = methods.join(types.select("file", F.col("pos").alias("up"), "kind", "classFqn", "path", "package", "imported", "supertypes"), ["file", "up"])
    local = owned.filter(is_name("token") & (F.col("up.kind").isin("block") | (F.col("up.token") == "(")) & is_name("prev") & is_one_of("next", "=", ";", ":", ",", ")")).select("file", "owner", F.col("token").alias("on"), F.col("prev").alias("type")).join(ancestors, ["file", "owner"]).select("file", "method", "on", "type", F.lit(0).alias("rank"))
    given = methods.select("file", F.col("pos").alias("method"), F.explode("ps").alias("p")).select("file", "method", F.col("p.name").alias("on"), F.regexp_replace("p.type", "<.*$", "").alias("type"), F.lit(1).alias("rank"))
    of_class = methods.select("file", F.col("pos").alias("method"), F.col("up").alias("owner")).join(by_type, ["file", "owner"]).select("file", "method", F.explode("classFields").alias("f")).select("file", "method", F.col("f.name").alias("on"), F.regexp_replace("f.typeFqn", "<.*$", "").alias("type"), F.lit(2).alias("rank"))
    scope = local.unionByName(given).unionByName(of_class).groupBy("file", "method", "on").agg(F.min(F.struct("rank", "type"))["type"].alias("type"))
    asked = calls.join(scope, ["file", "method", "on"], "left").join(base.select("file", F.col("pos").alias("method"), "classFqn", "path", "package", "imported"), ["file", "method"])
    wanted = F.when(F.col("new"), F.regexp_replace("name", "<.*$", "")).when(F.col("on").isNull() | (F.col("on") == "this"), F.lit(None)).otherwise(F.coalesce("type", F.when(F.col("on").rlike(r"^\p{Lu}"), F.col("on"))))
    own = ~F.col("new") & (F.col("on").isNull() | (F.col("on") == "this"))
    asked = asked.withColumn("simple", wanted).withColumn("listed", F.get(F.filter("imported", lambda x: ~x["wild"] & (F.substring_index(x["name"], ".", -1) == F.col("simple"))), F.lit(0))["name"])
    in_file = types.select("file", F.element_at(F.split("path", r"\."), -1).alias("simple"), "classFqn").groupBy("file", "simple").agg(F.collect_set("classFqn").alias("here"))
    looked = asked.filter("simple is not null").join(in_file, ["file", "simple"], "left").withColumn("places", F.transform(F.coalesce(F.when(F.col("listed").isNotNull(), F.array("listed")), "here"), lambda t: F.struct(F.lit(0).alias("rank"), t.alias("target")))).drop("here")
    # An unqualified call is of the innermost type around it that has such a method; others go beside the joins, so that they don't meet under one null key.
    outer = F.transform(F.sequence(F.size(F.split("path", r"\.")), F.lit(1), F.lit(-1)), lambda k: F.concat_ws(".", "package", F.array_join(F.slice(F.split("path", r"\."), 1, k), ".")))
    places = F.when(own & (F.col("on") == "this"), F.array("classFqn")).when(own & (F.col("name") == "this"), F.array("classFqn")).when(own & (F.col("name") != "super"), outer)
    asked = stored(looked.unionByName(asked.filter("simple is null").withColumn("places", F.transform(places, lambda t, i: F.struct(i.alias("rank"), t.alias("target"))))))
    constructs = F.col("new") | (F.col("name") == "this")
    called = F.when(constructs, F.substring_index("target", ".", -1)).otherwise(F.col("name")).alias("called")
    exact = F.concat("target", F.lit("::"), F.when(constructs, "<init>").otherwise(F.col("name")), F.lit("("), F.array_join("parameterTypes", ", "), F.lit(") -> "), F.when(constructs, F.col("target")).otherwise(F.coalesce("returnType", F.lit("void"))))
    facts = stored(base.select("file", F.col("classFqn").alias("target"), F.col("methodName").alias("called"), F.size("ps").alias("arity"), "returnType", "parameterTypes"))
    kinds_ = ("fits", F.count("*")), ("returnType", F.first("returnType")), ("parameterTypes", F.first("parameterTypes"))
    fitting = lambda rows, by: rows.groupBy(*by).agg(*(f.alias(n) for n, f in kinds_))
    tried = asked.select("file", "method", "pos", "new", "name", "arity", F.explode("places").alias("p")).select("file", "method", "pos", "new", "name", "arity", "p.*").withColumn("called", called)
    tried = tried.join(fitting(facts, ["file", "target", "called", "arity"]), ["file", "target", "called", "arity"], "left")
    own_fit = F.when(F.col("fits").isNotNull(), F.struct("rank", _pieces(F.when(F.col("fits") == 1, exact)).alias("exact")))
    tried = stored(tried.select(F.col("file").alias("shape"), "method", "pos", "new", _pieces(F.col("name")).alias("name"), "arity", "rank", _pieces(F.col("target")).alias("target"), own_fit.alias("own")))
    near = stored(asked.filter("simple is not null and places is null").select(F.col("file").alias("shape"), "method", "pos", "new", _pieces(F.col("name")).alias("name"), "arity", _pieces(F.coalesce("package", F.lit(""))).alias("p"), _pieces(F.col("simple")).alias("simple")))

    strings, invocations = F.array().cast("array<string>"), F.array().cast("array<struct<signature:string,resolutionMode:string,orderIndex:int>>")
    made_calls = asked.groupBy("file", F.col("method").alias("pos")).agg(F.collect_list(F.struct("chain", asked["pos"].alias("pos"), "new", "name")).alias("calls"))
    whole = base.join(bodies.select("file", "pos", "seg"), ["file", "pos"]).join(notes, ["file", "up", "seg"], "left").join(told, ["file", "pos"], "left").join(stops, ["file", "pos"], "left").join(made_calls, ["file", "pos"], "left").join(used, ["file", "pos"], "left").join(by_type.withColumnRenamed("owner", "up"), ["file", "up"], "left")
    cut_up = {c: _pieces(F.col(c)) for c in ("methodName", "classFqn", "methodSignature", "returnType")} | {c: _all_pieces(F.col(c)) for c in ("annotations", "supertypes", "parameterTypes", "thrownExceptions", "usedTypes")}
    cut_up["calls"] = F.transform("calls", lambda c: F.struct(c["chain"].alias("chain"), c["pos"].alias("pos"), c["new"].alias("new"), _pieces(c["name"]).alias("name")))
    cut_up |= {"imported": F.transform("imported", lambda x: _pieces(x["name"])), "classFields": F.transform("classFields", lambda f: F.struct(_pieces(f["name"]).alias("name"), _pieces(f["typeFqn"]).alias("typeFqn")))}
    whole = whole.select(F.col("file").alias("shape"), *(c for c in whole.columns if c not in ("file", "modifiers", "kind", "path", "package")))
    whole = stored(whole.withColumns(cut_up))

    # From here on rows are those of sources.
    found = shapes.agg(F.count_if(F.col("n") > crowd).alias("often"), F.count("*").alias("all")).first()
    crowds = F.broadcast(shapes.filter(F.col("n") > crowd).select("shape"))

    def of_sources(rows: DataFrame, facts: DataFrame) -> DataFrame:
        """Rows of sources with what their shapes have."""
        if not found["often"]:
            return rows.join(facts, "shape")
        crowded = rows.join(F.broadcast(facts.join(crowds, "shape", "left_semi")), "shape")
        return crowded if found["often"] == found["all"] else crowded.unionByName(rows.join(crowds, "shape", "left_anti").join(facts, "shape"))

    lean = shaped.select("id", "shape", "names")
    declares = facts.select(F.col("file").alias("shape"), _pieces(F.col("target")).alias("target"), _pieces(F.col("called")).alias("called"), "arity", _pieces(F.col("returnType")).alias("returnType"), _all_pieces(F.col("parameterTypes")).alias("parameterTypes"))
    offered = of_sources(lean, declares).select(_spelled(F.col("target")).alias("target"), _spelled(F.col("called")).alias("called"), "arity", _spelled(F.col("returnType")).alias("returnType"), _each(F.col("parameterTypes")).alias("parameterTypes"))
    offered = fitting(offered, ["target", "called", "arity"])
    asking = of_sources(lean, tried).select("id", "method", "pos", "new", _spelled(F.col("name")).alias("name"), "arity", "rank", _spelled(F.col("target")).alias("target"), F.struct("own.rank", _spelled(F.col("own.exact")).alias("exact")).alias("fit"), F.col("own").isNotNull().alias("fitted"))
    # Of several types of that name in a source the first by its full name is meant.
    asking = asking.withColumn("fit", F.when(F.col("fitted"), F.col("fit"))).drop("fitted")
    least = Window.partitionBy("id", "method", "pos", "rank")
    several = tried.groupBy("shape", "method", "pos", "rank").agg(F.count("*").alias("c")).filter("c > 1").limit(1).count()
    if several:
        asking = asking.withColumn("least", F.min("target").over(least)).filter("target = least").drop("least")
    if near.limit(1).count():
        tops = types.filter(F.instr("path", F.lit(".")) == 0).select(F.col("file").alias("shape"), F.coalesce("package", F.lit("")).alias("p"), F.col("path").alias("simple"), F.col("classFqn").alias("near")).distinct()
        tops = tops.select("shape", *(_pieces(F.col(c)).alias(c) for c in ("p", "simple", "near")))
        in_package = of_sources(lean, tops).select(_spelled(F.col("p")).alias("p"), _spelled(F.col("simple")).alias("simple"), _spelled(F.col("near")).alias("target")).distinct()
        unlisted = of_sources(lean, near).select("id", "method", "pos", "new", _spelled(F.col("name")).alias("name"), "arity", F.lit(0).alias("rank"), _spelled(F.col("p")).alias("p"), _spelled(F.col("simple")).alias("simple")).join(in_package, ["p", "simple"])
        asking = asking.unionByName(unlisted.drop("p", "simple").withColumn("fit", F.lit(None).cast(asking.schema["fit"].dataType)))
    hit = asking.withColumn("called", called).join(offered, ["target", "called", "arity"]).select("id", "method", "pos", "rank", F.when(F.col("fits") == 1, exact).alias("exact"), "fit").repartition("id")
    # A type that several sources declare is that of the call's own source.
    hit = hit.groupBy("id", "method", "pos").agg(F.coalesce(F.min(F.struct("rank", "exact"))["exact"], F.min("fit")["exact"]).alias("exact")).filter("exact is not null")
    hits = hit.groupBy("id", "method").agg(F.collect_list(F.struct("pos", "exact")).alias("h")).groupBy("id").agg(F.collect_list(F.struct("method", "h")).alias("hits"))  # those of one source
    rows = of_sources(shaped.drop("kinds").join(hits, "id", "left"), whole)

    known = F.get(F.filter("hits", lambda m: m["method"] == F.col("pos")), F.lit(0))["h"]
    open_ = lambda c: F.concat(F.lit("UNRESOLVED<"), F.when(c["new"], F.concat(F.lit("<init>("), _spelled(c["name"]), F.lit(")"))).otherwise(_spelled(c["name"])), F.lit(">"))
    rows = rows.withColumn("known", known).drop("hits")
    told_calls = F.transform("calls", lambda c: F.struct(c["chain"].alias("chain"), (-c["pos"]).alias("later"), F.get(F.filter("known", lambda h: h["pos"] == c["pos"]), F.lit(0))["exact"].alias("exact"), open_(c).alias("open")))
    signed_calls = F.transform(told_calls, lambda c: F.struct(c["chain"].alias("chain"), c["later"].alias("later"), F.coalesce(c["exact"], c["open"]).alias("signature"), F.when(c["exact"].isNotNull(), "EXACT").otherwise("UNRESOLVED").alias("mode")))
    invoked = F.transform(F.array_sort(signed_calls), lambda c, i: F.struct(c["signature"].alias("signature"), c["mode"].alias("resolutionMode"), i.alias("orderIndex")))
    start, end = F.get("braces", F.col("opened")), F.get("braces", F.col("closing")) + 1
    rows = rows.withColumns({"methodName": _spelled(F.col("methodName")), "annotations": F.coalesce(_each(F.col("annotations")), strings), "start": start, "end": end})
    rows = rows.withColumns({"inTestSource": F.contains(F.translate(F.col("file").cast("string"), "\\", "/"), F.lit("/test/")), "nParameters": F.size("ps"), "hasBody": F.lit(True), "nStatements": F.coalesce("statementCount", F.lit(0))})
    return rows.select(
        F.col("file").alias("filePath"), F.col("text").alias("fileContent"), _spelled(F.col("classFqn")).alias("classFqn"), _spelled(F.col("methodSignature")).alias("methodSignature"), "methodName", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("methodBody"), F.col("start").alias("bodyStartOffset"), F.col("end").alias("bodyEndOffset"),
        F.coalesce("statementCount", F.lit(0)).alias("statementCount"), category().alias("category"), F.coalesce(invoked, invocations).alias("invocations"), _each(F.col("imported")).alias("imports"),
        F.coalesce(F.transform("classFields", lambda f: F.struct(_spelled(f["name"]).alias("name"), _spelled(f["typeFqn"]).alias("typeFqn"))), F.array().cast("array<struct<name:string,typeFqn:string>>")).alias("classFields"), _each(F.col("supertypes")).alias("supertypes"), _spelled(F.col("returnType")).alias("returnType"), _each(F.col("parameterTypes")).alias("parameterTypes"), _each(F.col("thrownExceptions")).alias("thrownExceptions"), F.coalesce(_each(F.col("usedTypes")), strings).alias("usedTypes"),
    )


def calls_in_place(bodies: DataFrame) -> DataFrame:
    """(index, invocations, error) of generated bodies, read where they belong: calls are resolved as in ``extract``.

    ``bodies``: index, fileContent, bodyStartOffset (of the opening brace), bodyEndOffset (of the closing brace, or behind it),
    generatedBody (what stands between). Each file is put together with its body and extracted; the calls are those of the method whose brace stands at
    the offset, in order of visit. An entry that cannot be put together has no calls and says why; so does one without a method there."""
    c, start, end = F.col("fileContent"), F.col("bodyStartOffset"), F.col("bodyEndOffset")
    error = F.when(c.isNull(), "no file content").when(F.col("generatedBody").isNull(), "no generated body").when(start.isNull() | end.isNull() | (start < 0) | (end <= start) | (end > F.length(c)), "offsets outside the file")
    closing = F.when((F.substring(c, end + 1, F.lit(1)) != "}") & (F.substring(c, end, F.lit(1)) == "}"), end - 1).otherwise(end)
    made = F.concat(F.substring(c, F.lit(1), start + 1), F.col("generatedBody"), F.substring(c, closing + 1, F.length(c)))
    judged = bodies.withColumns({"error": error, "text": F.when(error.isNull(), made)})
    # Entries with an error have no text, so no methods; a filter would be moved to where files are read, before they are dealt.
    found = extract(judged.select("index", "text"), "index", "text").select(F.col("filePath").alias("index"), F.col("bodyStartOffset"), "invocations")
    joined = judged.select("index", "bodyStartOffset", "error").join(found, ["index", "bodyStartOffset"], "left")
    none = F.array().cast("array<struct<signature:string,resolutionMode:string,orderIndex:int>>")
    return joined.select("index", F.coalesce("invocations", none).alias("invocations"), F.coalesce("error", F.when(F.col("invocations").isNull(), "no method at the offset")).alias("error"))


def with_siblings(methods: DataFrame) -> DataFrame:
    """Methods of ``extract`` with ``siblingMethods``: the others of their type in the source's order, those a filter drops later included."""
    typed = methods.withColumn("__type", F.struct("filePath", "classFqn"))
    fields = ("methodSignature", "methodName", "parameterTypes", "returnType", "invocations", "usedTypes")
    joined = siblings(typed, "__type", "bodyStartOffset", fields)
    named = F.transform("siblings", lambda s: F.struct(s["methodSignature"].alias("signature"), *(s[f].alias(f) for f in fields[1:])))
    return joined.withColumn("siblingMethods", named).drop("siblings", "__type")


def _split(tokens: Column) -> Column:
    """Rows (token, angle) cut at commas outside type arguments, and at ``implements``: arrays of tokens."""
    empty = F.array().cast("array<string>")
    start = F.array(empty)

    def add(have: Column, x: Column) -> Column:
        last = F.element_at(have, -1)
        front = F.slice(have, 1, F.size(have) - 1)
        return F.when(x["token"].isin(",", "implements") & (x["angle"] == 0), F.concat(have, F.array(empty))).otherwise(F.concat(front, F.array(F.concat(last, F.array(x["token"])))))

    return F.filter(F.aggregate(tokens, start, add), lambda p: F.size(p) > 0)
