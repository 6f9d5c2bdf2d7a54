"""From raw documents to token ids: five stages, each over all that the one before kept.

Columns beyond those that a stage changes are carried, whatever their names; empty
tables give empty tables; rows that repeat are rows of their own, except among
near-duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covspark.llm import bpe, decontam, langid, neardup, substrings
from covspark.llm.store import Store, narrow, prepare, sweep, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, null and empty ones too; lang becomes the language found, and stays where none could be learned."""
    prepare(spark)
    sweep(spark)
    found = langid.identify(docs, carry=True).where("lettered")
    lang = F.when(F.col("lang_pred") == "und", F.col("row.lang")).otherwise(F.col("lang_pred"))
    return found.select(*(lang.alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest doc_id.

    Each text is judged by itself: unlike texts under one doc_id both stay, and so do
    rows without a doc_id, which come after those with one, unless their text has a
    near-duplicate. Of rows alike in doc_id and text any one stays; texts without words stay.
    """
    prepare(spark)
    sweep(spark)
    store = Store(spark, "stage")
    one, two = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")  # a row by 128 bits
    keyed = docs.withColumn("row__", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), one.alias("one"), two.alias("two")))
    found = store.keep(neardup.near_duplicates(keyed, key="row__").select("row__.one", "row__.two", "kept"), "found")
    gone = store.keep(found.where(~F.col("kept")).select("one", "two").distinct(), "gone")
    again = store.keep(found.where("kept").groupBy("one", "two").count().where("count > 1").select("one", "two"), "again")
    rows = docs.withColumns({"one__": one, "two__": two})
    same = lambda ids: (F.col("one__") == ids["one"]) & (F.col("two__") == ids["two"])
    kept = rows.join(narrow(gone), same(gone), "left_anti")
    if again.limit(1).count():
        first = kept.join(narrow(again), same(again), "left_semi").dropDuplicates(["one__", "two__"])
        kept = kept.join(narrow(again), same(again), "left_anti").unionByName(first)
    return kept.drop("one__", "two__")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go from texts, whose other words one space then parts; every row stays, null texts as they are."""
    prepare(spark)
    sweep(spark)
    found = substrings.remove_repeats(docs, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a window of a benchmark item go, those without a doc_id too; null texts stay."""
    prepare(spark)
    sweep(spark)
    keyed = docs.withColumn("row__", F.struct(F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two")))
    store = Store(spark, "stage")
    found = decontam.decontaminate(keyed, table(spark, sf_dir, "benchmark"), key="row__", store=store)
    gone = store.keep(found.where(F.col("n_hit") > 0).select("row__.one", "row__.two").distinct(), "gone")
    return keyed.join(narrow(gone), (F.col("row__.one") == gone["one"]) & (F.col("row__.two") == gone["two"]), "left_anti").drop("row__")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, and digests of the ids and of the bytes decoded from them."""
    prepare(spark)
    sweep(spark)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: SQL can express none of the last four stages at this size; tests hold each against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = table(spark, sf_dir, "documents"), Store(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), name)
        if before:
            store.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
