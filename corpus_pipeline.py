"""The corpus pipeline: five stages over ``documents``, each reading what the one before has kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import discard, fresh, places, settle, small_batches, stash
from lodestone.llm.jaccard_join import near_duplicates
from lodestone.llm.language_id import fit, predict
from lodestone.llm.packing import pack
from lodestone.llm.quality_rules import features, judge
from lodestone.llm.queries import vocabulary
from lodestone.llm.substring_dedup import substring_dedup


def _carried(docs: DataFrame, *read: str) -> tuple[DataFrame, str]:
    """The columns read, and all others as one struct under a name of its own, so that none meets a name that an operator uses."""
    row = fresh(docs, "carried")
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in read]
    return docs.select(*read, F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias(row)), row


def _released(rows: DataFrame, docs: DataFrame, row: str, *read: str) -> DataFrame:
    """The columns of ``docs`` again."""
    return rows.select(*(F.col(c) if c in read else F.col(row)[c].alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text has fewer than 50 words and goes; repeated rows are judged alike; an empty table stays empty.
    Columns of any other name stay as they are."""
    rows, row = _carried(docs, "text")
    return _released(judge(stash(features(rows), "features")).filter("kept"), docs, row, "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, from three quarters of them by the key's checksum.

    A document goes if it has no letter, or if its score is below the bar: a quarter of the way from chance (one over
    the number of languages) to the score that 99 of 100 rightly predicted documents of the last quarter reach. Where
    nothing was learned, or no such document was held out, all documents with a letter stay; so they do where there is
    one language only, as every score is 1 then. Columns of any other name stay as they are."""
    learn = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2, F.lit(True))
    with small_batches(spark):
        model = fit(docs.filter(learn).select(F.col("doc_id").alias("key"), "text", "lang"))
        if not model.languages:
            return docs.filter(F.col("text").rlike(r"\p{L}"))
        held_out = predict(docs.filter(~learn & F.col("lang").isNotNull()).select("text", "lang"), model)
        reached = held_out.filter("lang_pred = lang").agg(F.percentile_approx("score", 0.01, 10_000).alias("s")).first()["s"]
    chance = 1 / len(model.languages)
    bar = 0.0 if reached is None else chance + max(0.0, reached - chance) / 4
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    kept = predict(docs, model, pred=pred, score=score).filter((F.col(pred) != "und") & (F.col(score) >= bar))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest key (of equal keys, that of the least hash).

    Documents without a shingle have no group and all stay, unless they repeat a row's key and text. Columns of any other
    name stay as they are."""
    groups = near_duplicates(docs)
    named = groups.filter("group is not null")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place", "place2")).alias("one"))
    alone = groups.filter("group is null").select("place", "place2")
    keep = first.select("one.place", "one.place2").unionByName(alone).distinct()
    one, two, nth = fresh(docs, "place"), fresh(docs, "place2"), fresh(docs, "nth")
    place, place2 = places("doc_id", "text")
    kept = docs.withColumns({one: place, two: place2}).join(keep.select(F.col("place").alias(one), F.col("place2").alias(two)), [one, two], "left_semi")
    repeats = Window.partitionBy(one, two).orderBy("source", "lang")
    return kept.withColumn(nth, F.row_number().over(repeats)).filter(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; those of which nothing is left go, and so do null texts.

    ``n_chars`` is that of what is left. Rows equal in key and text are copies of each other; an empty table stays empty.
    Columns of any other name stay as they are."""
    rows, row = _carried(docs.drop("n_chars"), "doc_id", "text")
    left = substring_dedup(rows).filter("kept_text <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    whole = _released(left.withColumn("text", text), docs.drop("n_chars"), row, "doc_id", "text")
    return whole.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences. A null text counts as empty, so each document has a piece; an empty table gives none."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("language id", language), ("near copies", near_copies), ("repeated passages", passages), ("packing", packed)]

#: Language identification and packing cannot be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"stage-{i}")
            if before is not None:
                discard(before)
            before = docs
            settle(spark)
    return docs
