"""The newest rows of every user, oldest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.fixed_values import HISTORY_ROWS, TREND_DIGITS
from moodtide.functions.times import history_label


def newest_per_user(
    rows: DataFrame, time: str, tie: str, limit: int = HISTORY_ROWS
) -> DataFrame:
    """Up to ``limit`` newest rows per user with ``seq`` counting up in time.

    The filter on the row number is planned as a group limit before the shuffle, so a user
    with any number of posts sends at most ``limit`` rows per task.
    """
    newest_first = W.partitionBy("user_id").orderBy(F.col(time).desc(), F.col(tie).desc())
    limited = rows.withColumn("_back", F.row_number().over(newest_first)).where(
        F.col("_back") <= limit
    )
    return limited.withColumn(
        "seq", F.count(F.lit(1)).over(W.partitionBy("user_id")) - F.col("_back") + 1
    ).drop("_back")


def user_history(posts: DataFrame, limit: int = HISTORY_ROWS) -> DataFrame:
    """Last scored posts per user by post time."""
    scored = posts.where(F.col("sentiment_score").isNotNull()).select(
        "user_id", "id", "post_time", "sentiment_score"
    )
    return newest_per_user(scored, "post_time", "id", limit).select(
        "user_id",
        "seq",
        history_label(F.col("post_time")).alias("time"),
        F.round("sentiment_score", TREND_DIGITS).alias("score"),
    )


def user_trend(sentiment: DataFrame, limit: int = HISTORY_ROWS) -> DataFrame:
    """Last sentiment rows per user by analysis time; ties inside a batch go by id."""
    rows = sentiment.select("user_id", "id", "analyze_time", "sentiment_score", "sentiment_label")
    return newest_per_user(rows, "analyze_time", "id", limit).select(
        "user_id", "seq", "analyze_time", "sentiment_score", "sentiment_label"
    )


def user_series(posts: DataFrame, sentiment: DataFrame, limit: int = HISTORY_ROWS) -> DataFrame:
    """Post history where a user has any, else the sentiment rows.

    Both sides are cut to ``limit`` rows per user before they meet.
    """
    history = user_history(posts, limit).select(
        "user_id", "seq", "time", "score", F.lit(True).alias("_history")
    )
    points = user_trend(sentiment, limit).select(
        "user_id",
        "seq",
        history_label(F.col("analyze_time")).alias("time"),
        F.col("sentiment_score").alias("score"),
        F.lit(False).alias("_history"),
    )
    has_history = F.max("_history").over(W.partitionBy("user_id"))
    return (
        history.unionByName(points)
        .withColumn("_preferred", has_history)
        .where(F.col("_history") == F.col("_preferred"))
        .select(
            "user_id",
            "seq",
            "time",
            "score",
            F.when(F.col("_history"), F.lit("history")).otherwise(F.lit("points")).alias("origin"),
        )
    )
