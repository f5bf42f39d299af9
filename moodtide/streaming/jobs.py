"""Structured Streaming forms of ingest, hourly means, de-duplication and profiles.

Watermarks need zoned timestamps, so times are zoned inside a stream and zone-free outside
(session time zone UTC).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodtide.fixed_values import MIN_POSTS
from moodtide.functions.risk import risk_level
from moodtide.functions.times import floor_hour
from moodtide.operators import pages as page_ops
from moodtide.operators.trend import hourly_sentiment
from moodtide.operators.upsert import upsert
from moodtide.sources.tables import Tables

BROADCAST_HOURS = 200_000

STATS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("m2", T.DoubleType()),
    ]
)


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, only: str | None = None, per_batch: int = 0
) -> DataFrame:
    """A stream of landed parquet files, optionally of one name and a few per batch."""
    reader = spark.readStream.schema(schema)
    if only:
        reader = reader.option("pathGlobFilter", only)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def run_to_files(stream: DataFrame, out: str) -> None:
    """Drain what has landed into a parquet table; the checkpoint lies next to it."""
    (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def zoned(df: DataFrame, column: str = "post_time") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def hourly_stream(posts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Mean score per hour, emitted once the watermark has closed the hour."""
    return (
        zoned(posts.where(F.col("sentiment_score").isNotNull()))
        .withWatermark("post_time", delay)
        .groupBy(F.window("post_time", "1 hour"))
        .agg(F.avg("sentiment_score").alias("avg_score"), F.count(F.lit(1)).alias("posts"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("hour"), "avg_score", "posts"
        )
    )


def dedup_stream(
    posts: DataFrame, key: str = "source_post_id", delay: str = "15 days"
) -> DataFrame:
    """Each post once, as long as its repeats land within ``delay``; state ends with it.

    The watermark is on the time of the micro-batch, so posts of any age are let in.
    """
    return (
        posts.withColumn("_landed", F.current_timestamp())
        .withWatermark("_landed", delay)
        .dropDuplicatesWithinWatermark([key])
        .drop("_landed")
    )


def ingest_stream(pages: DataFrame, tables: Tables, as_of: dt.datetime, checkpoint: str) -> None:
    """Upsert the posts of every micro-batch of pages; the batch id makes replays harmless.

    The counters of a micro-batch are written after its parsed rows; a replay that finds them merges
    those rows and counts nothing again. Pages are counted by themselves, without a column read: a
    plan in which no page can hold a post is emptied by Spark, and so is what it would observe. They are
    dealt anew before they are parsed, since a micro-batch may be one large file.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        if not tables.has_batch("ingest_counters", batch_id):
            pages_read = batch.count()
            dealt = page_ops.dealt(batch, pages_read)
            posts = page_ops.landed_rows(page_ops.page_posts(dealt, as_of), as_of)
            tables.append("raw_data-landed", posts, batch_id)
            counted = landed(batch_id).agg(
                F.lit(pages_read).cast("long").alias("pages"),
                F.count_distinct("seq.page_id").alias("pages_with_posts"),
                F.count(F.lit(1)).alias("upsert_rows"),
            )
            tables.append("ingest_counters", counted, batch_id)
        tables.merge(
            "raw_data", landed(batch_id), "source_post_id", ["post_time", "update_time"], "seq", batch_id
        )

    def landed(batch_id: int) -> DataFrame:
        return tables.spark.read.parquet(f"{tables.path('raw_data-landed')}/batch={batch_id}")

    run_batches(pages, land, checkpoint)


def stream_counters(tables: Tables) -> DataFrame:
    """The counters of all micro-batches, which add up since a page lands once, and the distinct posts."""
    landed = tables.spark.read.parquet(tables.path("raw_data-landed"))
    posts = landed.agg(F.count_distinct("source_post_id")).scalar()
    return tables.appended("ingest_counters").agg(
        *[F.sum(c).alias(c) for c in ("pages", "pages_with_posts", "upsert_rows")],
        posts.alias("distinct_posts"),
    )


def score_stats(scored: DataFrame) -> DataFrame:
    """Count, mean and sum of squared deviations per user."""
    return (
        scored.where(F.col("sentiment_score").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("sentiment_score").alias("mean"),
            (F.var_pop("sentiment_score") * F.count(F.lit(1))).alias("m2"),
        )
    )


def merge_stats(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Statistics of both sides together, user by user."""
    a = stored.select("user_id", *[F.col(c).alias(f"a_{c}") for c in ("n", "mean", "m2")])
    b = new.select("user_id", *[F.col(c).alias(f"b_{c}") for c in ("n", "mean", "m2")])
    both = a.join(b, "user_id", "full_outer").na.fill(
        0, [f"{s}_{c}" for s in "ab" for c in ("n", "mean", "m2")]
    )
    n = F.col("a_n") + F.col("b_n")
    gap = F.col("b_mean") - F.col("a_mean")
    return both.select(
        "user_id",
        n.alias("n"),
        (F.col("a_mean") + gap * F.col("b_n") / n).alias("mean"),
        (F.col("a_m2") + F.col("b_m2") + gap * gap * F.col("a_n") * F.col("b_n") / n).alias("m2"),
    )


def profiles_from_stats(stats: DataFrame, min_posts: int = MIN_POSTS) -> DataFrame:
    volatility = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0)
    return (
        stats.where(F.col("n") >= min_posts)
        .select(
            "user_id",
            F.col("mean").alias("avg_sentiment"),
            volatility.alias("volatility"),
            F.col("n").alias("post_count"),
        )
        .withColumn("risk_level", risk_level(F.col("avg_sentiment"), F.col("volatility")))
    )


def profile_stream(scored: DataFrame, tables: Tables, checkpoint: str) -> None:
    """Fold every micro-batch into the per-user statistics.

    Batch ``i`` reads the newest statistics older than its own and writes version ``i + 1``,
    so a replayed batch gives the same version again.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        stored = tables.read("user_stats", before=version, schema=STATS)
        tables.replace("user_stats", merge_stats(stored, score_stats(batch)), version)

    run_batches(scored, fold, checkpoint)


def touched_hours(stored: DataFrame, incoming: DataFrame, key: str = "source_post_id") -> DataFrame:
    """Hours a correction of post times takes posts from or gives posts to."""
    left = stored.join(incoming.select(key).distinct(), key, "left_semi").select(
        floor_hour(F.col("post_time")).alias("hour")
    )
    gained = incoming.select(floor_hour(F.col("post_time")).alias("hour"))
    return left.unionByName(gained).distinct()


def corrected_hours(hourly: DataFrame, posts: DataFrame, hours: DataFrame) -> DataFrame:
    """Hourly means with the given hours computed anew from the corrected posts.

    ``hours`` is a stored table of distinct hours. It is counted before it is broadcast.
    """
    if hours.count() <= BROADCAST_HOURS:
        hours = F.broadcast(hours)
    anew = posts.withColumn("hour", floor_hour(F.col("post_time"))).join(
        hours, "hour", "left_semi"
    )
    fresh = hourly_sentiment(anew.drop("hour"), digits=None)
    return hourly.join(hours, "hour", "left_anti").unionByName(fresh)


def correction_stream(corrections: DataFrame, tables: Tables, checkpoint: str) -> None:
    """Apply late corrections of post times and refresh the hours they touch.

    Versions follow the batch id: version 0 of ``posts`` and ``hourly`` is the start.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        stored = tables.read("posts", before=version)
        tables.replace("touched_hours", touched_hours(stored, batch), version)
        hours = tables.read("touched_hours", before=version + 1)
        hourly = tables.read("hourly", before=version)
        tables.replace(
            "posts",
            upsert(stored, batch, "source_post_id", ["post_time", "update_time"], "seq"),
            version,
        )
        posts = tables.read("posts", before=version + 1)
        tables.replace("hourly", corrected_hours(hourly, posts, hours), version)

    run_batches(corrections, apply, checkpoint)
