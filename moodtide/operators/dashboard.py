"""Market dashboard: one global row and one row per risk level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.functions.risk import market_band


def risk_distribution(profiles: DataFrame) -> DataFrame:
    """Users and share per level, from one pass over the profiles.

    The total is taken over the counts: a row per level is all that reaches that one task.
    """
    counts = profiles.groupBy("risk_level").agg(F.count(F.lit(1)).alias("user_count"))
    total = F.sum("user_count").over(W.partitionBy())
    return counts.select(
        "risk_level", "user_count", (F.col("user_count") / total).alias("user_share")
    ).orderBy("risk_level")


def global_sentiment(profiles: DataFrame) -> DataFrame:
    """Mean over users, not posts; 0.0 when there is no profile."""
    return profiles.agg(
        F.coalesce(F.avg("avg_sentiment"), F.lit(0.0)).alias("global_avg_sentiment"),
        F.count(F.lit(1)).alias("total_users"),
    ).withColumn("market_band", market_band(F.col("global_avg_sentiment")))
