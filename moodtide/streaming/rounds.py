"""Posts cleaned, scored and folded as they land, by chained streams.

Each stream reads the files that the one before has finished since the last round: its checkpoint
knows them, so nothing is joined to find out what is new. Rows carry the user and the text on.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.functions.text import clean_text
from moodtide.functions.times import floor_hour, ntz
from moodtide.operators import status
from moodtide.sources.tables import Tables
from moodtide.streaming.jobs import dedup_stream, file_stream, run_batches, run_to_files

CLEANED = "id long, user_id string, clean_content string, update_time timestamp_ntz"


def clean_stream(posts: DataFrame, as_of: dt.datetime, max_chars: int | None = None) -> DataFrame:
    """Each post once, with its clean text: (id, user_id, clean_content, update_time).

    Null content is empty text; posts that clean to nothing are kept here and go no further. A post
    that lands again within the time of ``dedup_stream`` is not cleaned again.
    """
    first = dedup_stream(posts.select("id", "source_post_id", "user_id", "content"))
    text = clean_text(F.coalesce("content", F.lit("")), max_chars)
    return first.select("id", "user_id", text.alias("clean_content"), ntz(as_of).alias("update_time"))


def score_stream(
    cleaned: DataFrame, scorer: Callable[[DataFrame], DataFrame], as_of: dt.datetime
) -> DataFrame:
    """The rows of ``user_sentiment`` for cleaned posts with any text left."""
    ready = cleaned.where(F.col("clean_content") != "").select("id", "user_id", "clean_content")
    return status.sentiment_rows(scorer(ready), as_of)


def clean_landed(
    spark: SparkSession, posts: DataFrame, out: str, as_of: dt.datetime, max_chars: int | None = None
) -> DataFrame:
    """Clean what has landed since the last call into ``out``, and give all of it."""
    run_to_files(clean_stream(posts, as_of, max_chars), out)
    return spark.read.schema(CLEANED).parquet(out)


def score_cleaned(
    spark: SparkSession, cleaned: str, out: str, scorer: Callable[[DataFrame], DataFrame], as_of: dt.datetime
) -> DataFrame:
    """Score what ``cleaned`` has gained since the last call into ``out``, and give all of it."""
    schema = spark.createDataFrame([], CLEANED).schema
    stream = score_stream(file_stream(spark, cleaned, schema), scorer, as_of)
    run_to_files(stream, out)
    return spark.read.schema(stream.schema).parquet(out)


def hourly_sums_stream(scored: DataFrame, tables: Tables, checkpoint: str) -> None:
    """Append each micro-batch's sums and counts per hour; no hour is ever closed.

    Sums of different batches add up, so a post of any age counts, nothing is rewritten, and a
    replayed batch writes its own sums again.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        sums = (
            batch.where(F.col("sentiment_score").isNotNull() & F.col("post_time").isNotNull())
            .groupBy(floor_hour(F.col("post_time")).alias("hour"))
            .agg(F.sum("sentiment_score").alias("total"), F.count(F.lit(1)).alias("posts"))
        )
        tables.append("hourly_sums", sums, batch_id)

    run_batches(scored, land, checkpoint)


def hourly_from_sums(sums: DataFrame) -> DataFrame:
    """Mean score and posts per hour, from the sums of all batches."""
    return (
        sums.groupBy("hour")
        .agg(F.sum("total").alias("total"), F.sum("posts").alias("posts"))
        .select("hour", (F.col("total") / F.col("posts")).alias("avg_score"), "posts")
    )


def user_stats_stream(scored: DataFrame, tables: Tables, checkpoint: str) -> None:
    """Keep count, mean and squared deviation per user in the state store, and append what changes.

    A micro-batch writes the users it has posts of, with their statistics so far; the files of
    all others stay as they are.
    """
    stats = (
        scored.where(F.col("sentiment_score").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("sentiment_score").alias("mean"),
            (F.var_pop("sentiment_score") * F.count(F.lit(1))).alias("m2"),
        )
    )
    run_batches(
        stats, lambda batch, batch_id: tables.append("user_stats_changed", batch, batch_id), checkpoint, "update"
    )


def latest_stats(changed: DataFrame) -> DataFrame:
    """The newest statistics per user: those of the most posts, as counts only grow."""
    newest = F.max_by(F.struct("n", "mean", "m2"), F.col("n")).alias("newest")
    return changed.groupBy("user_id").agg(newest).select("user_id", "newest.*")
