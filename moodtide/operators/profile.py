"""Per-user risk profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.fixed_values import MIN_POSTS
from moodtide.functions.risk import risk_level


def score_details(scored: DataFrame) -> DataFrame:
    """The two columns a profile needs, so the scan reads nothing else."""
    return scored.where(F.col("sentiment_score").isNotNull()).select(
        "user_id", "sentiment_score"
    )


def risk_profiles(scored: DataFrame, min_posts: int = MIN_POSTS) -> DataFrame:
    """Mean, sample deviation and level per user with at least ``min_posts`` posts.

    Count, mean and squared deviation combine on the map side, so a user holding a large
    share of all posts costs one partial row per task.
    """
    return (
        score_details(scored)
        .groupBy("user_id")
        .agg(
            F.avg("sentiment_score").alias("avg_sentiment"),
            F.coalesce(F.stddev_samp("sentiment_score"), F.lit(0.0)).alias("volatility"),
            F.count(F.lit(1)).alias("post_count"),
        )
        .where(F.col("post_count") >= min_posts)
        .withColumn("risk_level", risk_level(F.col("avg_sentiment"), F.col("volatility")))
    )


def missing_profiles(requested: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requested users without a profile, each once.

    Ids are made distinct before the join, which then finds them partitioned already; an id
    requested very often is folded on the map side.
    """
    asked = requested.select("user_id").distinct()
    return asked.join(profiles.select("user_id"), "user_id", "left_anti")


def known_profiles(requested: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles of the requested users."""
    asked = requested.select("user_id").distinct()
    return profiles.join(asked, "user_id", "left_semi")
