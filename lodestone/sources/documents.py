"""JSON documents that are one object with a long array, read by as many tasks as the file has splits.

A file is cut at closing braces, which are single bytes, so that any split begins at a piece's start. Whether that lies
inside a string, and how deep, depends on all that comes before. A split is therefore summarised as a function of the
state in which it may begin: by how many string ends it passes, and how far it goes down or up if it begins outside or
inside a string. A prefix scan over these rows, one per split, gives each split the state in which it does
begin. With it, a second pass notes which array each split ends in and how many elements it has begun, and a third one
reads the elements. Only an element that lies across splits is put together by a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import stored

ESCAPED = re.compile(r"\\.", re.DOTALL)
TOKEN = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)("?)|[{}\[\]]', re.DOTALL)
REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*("?)', re.DOTALL)
COLON = re.compile(r"\s*:")
#: Rows, one per split, up to which the splits' states are broadcast.
FEW = 1 << 17


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, value): what stands before each closing brace, by file, start of the split and place in it."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def _flow(batches, names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _steps(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _summaries(batches):
    """(file, block, ends, outside, inside): string ends passed, and steps down if the split begins outside or inside a string."""
    rows, place, ends, steps = [], None, 0, [0, 0]
    for file, block, value in _flow(batches, ("file", "block", "value")):
        if (file, block) != place:
            if place:
                rows.append((*place, ends, *steps))
            place, ends, steps = (file, block), 0, [0, 0]
        parts = ESCAPED.sub("", value + "}").split('"')
        even, odd = _steps("".join(parts[0::2])), _steps("".join(parts[1::2]))
        steps[ends % 2] += even
        steps[1 - ends % 2] += odd
        ends += len(parts) - 1
    if place:
        rows.append((*place, ends, *steps))
    yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "ends", "outside", "inside"), r, strict=True)) for r in rows], pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64())]))


class Split:
    """What a pass has seen of one split. ``key``: the top-level array that it is in; "" in another value, None if that began before the split."""

    def __init__(self, target: str, inside: bool, depth: int):
        self.target, self.inside, self.depth = target, inside, depth
        self.key: str | None = None
        self.begun = {False: 0, True: 0}  # elements begun before and after a key was seen
        self.opened = False
        self.parts: list[str] | None = [] if depth > 2 else None  # of the element that is open
        self.at, self.whole = (False, -1), False

    def feed(self, value: str) -> Iterator[tuple[bool, int, bool, str]]:
        """Elements that end in a piece: (whether its key is known, place among such, whether it began here, text)."""
        text, pos, start = value + "}", 0, 0
        if self.inside:
            m = REST.match(text)
            pos, self.inside = m.end(), not m[1]
        for m in TOKEN.finditer(text, pos) if not self.inside else ():
            c = text[m.start()]
            if c == '"':
                if not m[2]:
                    self.inside = True
                elif self.depth == 1 and COLON.match(text, m.end()):
                    self.name = json.loads(m[0])
            elif c in "{[":
                if self.depth == 1:
                    self.key = self.name if c == "[" else ""
                    self.opened |= self.key == self.target
                self.depth += 1
                if c == "{" and self.depth == 3 and self.key in (None, self.target):
                    known = self.key is not None
                    self.parts, start, self.at, self.whole = [], m.start(), (known, self.begun[known]), True
                    self.begun[known] += 1
            else:
                self.depth -= 1
                if self.depth == 2 and self.parts is not None:
                    yield (*self.at, self.whole, "".join([*self.parts, text[start : m.end()]]))
                    self.parts = None
        if self.parts is not None:
            self.parts.append(text[start:])

    name = ""


def _splits(batches, target: str) -> Iterator[tuple[tuple, Split, str | None]]:
    """Each piece with its split's state; a split's last row has no piece."""
    place, split = None, None
    for file, block, value, inside, depth in _flow(batches, ("file", "block", "value", "within", "depth")):
        if (file, block) != place:
            if split is not None:
                yield place, split, None
            place, split = (file, block), Split(target, inside, depth)
        yield place, split, value
    if split is not None:
        yield place, split, None


def _counted(target: str):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("key", pa.string()), ("before", pa.int64()), ("after", pa.int64()), ("opened", pa.bool_())])

    def run(batches):
        for place, split, value in _splits(batches, target):
            if value is not None:
                for _ in split.feed(value):
                    pass
            else:
                row = (*place, split.key, split.begun[False], split.begun[True], split.opened)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

    return run


def _elements(target: str, at_once: int = 256):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("known", pa.bool_()), ("i", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])

    def run(batches):
        out: list[tuple] = []
        for place, split, value in _splits(batches, target):
            if value is not None:
                out += [(*place, *found) for found in split.feed(value)]
            elif split.parts is not None:
                out.append((*place, *split.at, False, "".join(split.parts)))
            if len(out) >= at_once:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    return run


def read_elements(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """(file, ord, element): the objects of the array ``key`` of JSON objects, in their order, other keys skipped.

    Each file must be an object with such an array; one that isn't is an error, and so is an element that doesn't fit the
    schema. Any number of tasks reads one file, three times; a row per split is kept between. Elements that are no objects
    are skipped. An empty array gives no rows."""
    pieces = _pieces(spark, path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    passed = pieces.mapInArrow(_summaries, "file string, block long, ends long, outside long, inside long")
    within = F.coalesce(F.sum("ends").over(before), F.lit(0)) % 2 == 1
    stated = passed.withColumn("within", within).withColumn("step", F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside")))
    states = stored(stated.select("file", "block", "within", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth")))

    def started(states: DataFrame) -> DataFrame:
        if states.count() <= FEW:
            return pieces.join(F.broadcast(states), ["file", "block"])
        return pieces.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "id")

    rows = started(states)
    counted = rows.mapInArrow(_counted(key), "file string, block long, key string, before long, after long, opened boolean")
    held = F.coalesce(F.last("key", ignorenulls=True).over(before), F.lit("")) == key
    begun = counted.withColumn("held", held).withColumn("skipped", F.when(F.col("held"), F.col("before")).otherwise(0))
    splits = stored(begun.withColumn("base", F.coalesce(F.sum(F.col("skipped") + F.col("after")).over(before), F.lit(0))).select("file", "block", "held", "skipped", "base", "opened"))
    bad = splits.groupBy("file").agg(F.max("opened").alias("opened")).filter(~F.col("opened")).select("file").take(1)
    if bad:
        raise ValueError(f"no array of {key} in {bad[0]['file']}")

    found = rows.mapInArrow(_elements(key), "file string, block long, known boolean, i long, whole boolean, text string")
    placed = found.join(F.broadcast(splits) if splits.count() <= FEW else splits, ["file", "block"]).filter(F.col("known") | F.col("held"))
    ordered = placed.select("file", (F.col("base") + F.when(F.col("known"), F.col("skipped")).otherwise(0) + F.col("i")).alias("ord"), "block", "whole", "text")
    across = ordered.filter(~F.col("whole")).groupBy("file", "ord").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))  # the parts of one element
    texts = ordered.filter("whole").select("file", "ord", "text").unionByName(across.select("file", "ord", F.array_join("parts.text", "").alias("text")))
    return texts.select("file", "ord", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("element"))


def write_elements(rows: DataFrame, path: str, key: str, head: dict | None = None) -> None:
    """Rows as the array ``key`` of one JSON object, after the entries of ``head``; written by one task, a row at a time, as a file is."""
    spark = rows.sparkSession
    start = json.dumps(head or {})[:-1] + (", " if head else "") + json.dumps(key) + ": ["
    ends = spark.createDataFrame([(0, start), (2, "]}")], "part int, row string")
    listed = rows.select(F.lit(1).alias("part"), F.to_json(F.struct("*")).alias("row")).unionByName(ends).repartition(1).sortWithinPartitions("part")
    numbered = listed.withColumn("n", F.monotonically_increasing_id())  # in one partition the numbers are places
    line = F.when((F.col("part") == 1) & (F.col("n") > 1), F.concat(F.lit(","), "row")).otherwise(F.col("row"))
    numbered.select(line.alias("value")).write.mode("overwrite").option("lineSep", " ").text(path)
