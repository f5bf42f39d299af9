"""The one-way post state machine: raw, cleaned, scored.

Each stage has its own append-only table keyed by post id. What a stage still has to do is
the previous table without the ids it already holds, so a rerun after a lost job picks up
exactly the missing rows and a row moves at most once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.fixed_values import STATUS_CLEANED, STATUS_RAW, STATUS_SCORED
from moodtide.functions.text import clean_text
from moodtide.functions.times import ntz


def pending_posts(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Posts not cleaned yet: (id, content), null content as empty text."""
    return raw.join(clean.select("id"), "id", "left_anti").select(
        "id", F.coalesce("content", F.lit("")).alias("content")
    )


def pending_by_status(posts: DataFrame) -> DataFrame:
    """The same queue from a table that carries its state as a column."""
    return posts.where(F.col("process_status") == STATUS_RAW).select(
        "id", F.coalesce("content", F.lit("")).alias("content")
    )


def scorable_posts(raw: DataFrame, clean: DataFrame, scored: DataFrame) -> DataFrame:
    """Cleaned, non-empty, unscored posts. Rows cleaned to nothing stay behind for good."""
    ready = clean.where(F.col("clean_content").isNotNull() & (F.col("clean_content") != ""))
    return (
        ready.select("id", "clean_content")
        .join(scored.select("id"), "id", "left_anti")
        .join(raw.select("id", "user_id"), "id")
        .select("id", "user_id", "clean_content")
    )


def scorable_by_status(posts: DataFrame) -> DataFrame:
    return posts.where(
        (F.col("process_status") == STATUS_CLEANED)
        & F.col("clean_content").isNotNull()
        & (F.col("clean_content") != "")
    ).select("id", "user_id", "clean_content")


def clean_batch(
    pending: DataFrame, as_of: dt.datetime, max_chars: int | None = None
) -> DataFrame:
    """Rows to append to the cleaned table, stamped with one time per batch.

    Posts keep their whole clean text, or its first ``max_chars`` characters where the caller says so.
    """
    clean = clean_text(F.col("content"), max_chars)
    return pending.select("id", clean.alias("clean_content"), ntz(as_of).alias("update_time"))


def scored_batch(sentiment: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows to append to the scored table from (id, sentiment_score, sentiment_label, ...)."""
    return sentiment.select(
        "id", "sentiment_score", "sentiment_label", ntz(as_of).alias("update_time")
    )


def sentiment_rows(sentiment: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The same results in the shape of ``user_sentiment``; its id follows the post's."""
    return sentiment.select(
        "id",
        F.col("id").alias("raw_data_id"),
        "user_id",
        "clean_content",
        "sentiment_score",
        "sentiment_label",
        ntz(as_of).alias("analyze_time"),
    )


def posts_with_status(raw: DataFrame, clean: DataFrame, scored: DataFrame) -> DataFrame:
    """``raw_data`` as one table: stage columns filled in, state derived."""
    c = clean.select(
        "id", F.lit(True).alias("_cleaned"), "clean_content", F.col("update_time").alias("_t1")
    )
    s = scored.select(
        "id",
        F.lit(True).alias("_scored"),
        "sentiment_score",
        "sentiment_label",
        F.col("update_time").alias("_t2"),
    )
    landed = raw.drop("clean_content", "sentiment_score", "sentiment_label", "process_status")
    return (
        landed.join(c, "id", "left")
        .join(s, "id", "left")
        .withColumn(
            "process_status",
            F.when(F.col("_scored"), STATUS_SCORED)
            .when(F.col("_cleaned"), STATUS_CLEANED)
            .otherwise(STATUS_RAW),
        )
        .withColumn("update_time", F.greatest("update_time", "_t1", "_t2"))
        .drop("_cleaned", "_scored", "_t1", "_t2")
    )


def status_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("process_status").agg(F.count(F.lit(1)).alias("posts"))
