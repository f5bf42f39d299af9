"""Documents made ready for training: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm.decontaminate import without_leaks
from moodtide.llm.exact_dedup import dedup_exact, own_key
from moodtide.llm.frames import numbered, stored, table, text_key, text_of, without
from moodtide.llm.language import in_known_language
from moodtide.llm.minhash import near_duplicates
from moodtide.llm.queries import packed


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and those without any likely language."""
    return in_known_language(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the most code points and then the smallest id stays, null last.

    A row is decided by its own id, digest and length, so different texts under one id, or without
    an id, all stay. Of rows that share all three the first by the hashes of its text stays.
    """
    rows = numbered(docs)
    own = rows.select("row.doc_id", "row.text", "number")
    decided = dedup_exact(own)
    kept = decided.where("kept").select(F.struct("doc_id", "chars", "digest").alias("row_key")).distinct()
    keys = stored(own.select("number", F.struct(*own_key()).alias("row_key"), *text_key(text_of("text"))), "row_keys")
    first = F.min(F.struct("k1", "k2", "number")).alias("first")
    stay = keys.groupBy("row_key").agg(first).join(kept, "row_key", "left_semi").select("first.number")
    return without(rows, stored(keys.select("number").join(stay, "number", "left_anti"), "gone"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id stays, null last.

    Every row is a document under a number of its own, and classes are made of the numbers. So texts
    that share an id, or have none, are each compared and decided by themselves; of rows with the
    same id in a class the first by the hashes of its text stays.
    """
    rows = numbered(docs)
    found = near_duplicates(rows.select("number", "row.text"), id_col="number")
    of_class = found.select(F.col("doc_id").alias("number"), "class_id")
    keys = rows.select("number", F.col("row.doc_id").alias("doc_id"), *text_key(text_of("row.text")))
    placed = stored(keys.join(of_class, "number"), "row_classes")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "number")
    stay = placed.groupBy("class_id").agg(F.min(order).alias("first")).select("first.number")
    return without(rows, stored(placed.select("number").join(stay, "number", "left_anti"), "gone"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover an item of the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("pack", pack_sequences),
]

#: Language scores, signatures and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
