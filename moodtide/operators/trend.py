"""Hourly means and the gap-filled 24-hour trend, for one series or many at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.fixed_values import (
    EMPTY_GLOBAL_SCORE,
    FILL_STRATEGY,
    POINT_ANCHOR,
    POINT_INTERPOLATED,
    POINT_REAL,
    TREND_DIGITS,
    TREND_HOURS,
)
from moodtide.functions.times import floor_hour, hour_label, ntz


def trend_bounds(as_of: dt.datetime, hours: int = TREND_HOURS) -> tuple[dt.datetime, dt.datetime]:
    """Half-open range of the last ``hours`` whole hours, the current one included."""
    current = as_of.replace(minute=0, second=0, microsecond=0)
    return current - dt.timedelta(hours=hours - 1), current + dt.timedelta(hours=1)


def posts_between(posts: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Plain comparisons with literals, so the range reaches the parquet scan."""
    return posts.where((F.col("post_time") >= ntz(start)) & (F.col("post_time") < ntz(end)))


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def global_score(posts: DataFrame, digits: int | None = TREND_DIGITS) -> DataFrame:
    """Mean over all scored posts; missing or exactly zero becomes 0.5."""
    return posts.agg(
        _rounded(
            F.coalesce(
                F.nullif(F.avg("sentiment_score"), F.lit(0.0)), F.lit(EMPTY_GLOBAL_SCORE)
            ),
            digits,
        ).alias("global_score")
    )


def hourly_sentiment(
    posts: DataFrame, keys: list[str] | None = None, digits: int | None = TREND_DIGITS
) -> DataFrame:
    """Mean score per (series and) hour of the post time."""
    return (
        posts.where(F.col("sentiment_score").isNotNull())
        .groupBy(*(keys or []), floor_hour(F.col("post_time")).alias("hour"))
        .agg(
            _rounded(F.avg("sentiment_score"), digits).alias("avg_score"),
            F.count(F.lit(1)).alias("posts"),
        )
    )


def fill_gaps(
    points: DataFrame,
    edge: Column,
    keys: list[str],
    size: int = TREND_HOURS,
    digits: int | None = TREND_DIGITS,
) -> DataFrame:
    """Fill the unknown ``value`` of every (keys, idx) with idx in 0..size-1.

    Between two known points the line between them is followed. Before the first and after
    the last, a line starting from or heading for ``edge`` is, and a series without any
    known point is ``edge`` throughout. The window holds ``size`` rows of one series.
    """
    before = (
        W.partitionBy(*keys).orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    after = (
        W.partitionBy(*keys).orderBy("idx").rowsBetween(W.currentRow, W.unboundedFollowing)
    )
    known = F.when(F.col("value").isNotNull(), F.struct("idx", "value"))
    sided = points.select(
        "*",
        F.last(known, ignorenulls=True).over(before).alias("_left"),
        F.first(known, ignorenulls=True).over(after).alias("_right"),
        edge.alias("_edge"),
    )
    idx, g = F.col("idx"), F.col("_edge")
    l_idx, l_val = F.col("_left.idx"), F.col("_left.value")
    r_idx, r_val = F.col("_right.idx"), F.col("_right.value")
    head = g + (r_val - g) / (r_idx + 1) * (idx + 1)
    inner = l_val + (r_val - l_val) / F.nullif(r_idx - l_idx, F.lit(0)) * (idx - l_idx)
    tail = l_val + (g - l_val) / (F.lit(size) - l_idx) * (idx - l_idx)
    filled = (
        F.when(F.col("value").isNotNull(), F.col("value"))
        .when(l_idx.isNotNull() & r_idx.isNotNull(), inner)
        .when(r_idx.isNotNull(), head)
        .when(l_idx.isNotNull(), tail)
        .otherwise(g)
    )
    kind = (
        F.when(F.col("value").isNotNull(), F.lit(POINT_REAL))
        .when(l_idx.isNotNull() & r_idx.isNotNull(), F.lit(POINT_INTERPOLATED))
        .otherwise(F.lit(POINT_ANCHOR))
    )
    return sided.select(
        *keys, "idx", _rounded(filled, digits).alias("value"), kind.alias("point_type")
    )


def trend_by_series(
    posts: DataFrame,
    series: DataFrame,
    as_of: dt.datetime,
    digits_in: int | None = TREND_DIGITS,
    digits_out: int | None = TREND_DIGITS,
    hours: int = TREND_HOURS,
) -> DataFrame:
    """The last ``hours`` hours of every series, gaps filled.

    ``series`` holds the distinct keys to report, also those without a recent post. The
    range filter is pushed into the scan of ``posts``; after the hourly means a series is at
    most ``hours`` numbers, so they travel as one small map and no join is needed.
    """
    keys = series.columns
    start, end = trend_bounds(as_of, hours)
    offset = F.timestamp_diff("HOUR", ntz(start), F.col("hour")).cast("int")
    hourly = hourly_sentiment(posts_between(posts, start, end), keys, digits_in).select(
        *keys, F.struct(offset.alias("key"), F.col("avg_score").alias("value")).alias("point")
    )
    empty = series.select(*keys, F.lit(None).cast(hourly.schema["point"].dataType).alias("point"))
    known = hourly.unionByName(empty).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list("point")).alias("known")
    )
    dense = known.select(
        *keys,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(hours - 1)),
                lambda i: F.try_element_at(F.col("known"), i),
            )
        ).alias("idx", "value"),
    )
    edge = global_score(posts, digits_in).scalar()
    hour = ntz(start) + F.make_dt_interval(F.lit(0), F.col("idx"))
    return fill_gaps(dense, edge, keys, hours, digits_out).select(
        *keys,
        "idx",
        hour.alias("hour"),
        hour_label(hour).alias("label"),
        "value",
        "point_type",
    )


def trend_global(posts: DataFrame, as_of: dt.datetime, **options) -> DataFrame:
    """The trend over all posts: one series, 24 rows."""
    one = posts.sparkSession.range(1).select(F.lit("all").alias("series"))
    return trend_by_series(
        posts.withColumn("series", F.lit("all")), one, as_of, **options
    ).drop("series")


def with_deviation(
    trend: DataFrame, profiles: DataFrame, digits: int | None = TREND_DIGITS
) -> DataFrame:
    """Distance of each point from the mean of the user means, and the two point sets."""
    base = profiles.agg(F.coalesce(F.avg("avg_sentiment"), F.lit(0.0)).alias("m")).scalar()
    real = F.col("point_type") == POINT_REAL
    return trend.select(
        "*",
        (_rounded(F.col("value") - base, digits) + 0.0).alias("deviation"),
        F.when(real, F.col("value")).alias("real_value"),
        F.when(~real, F.col("value")).alias("filled_value"),
    )


def trend_summary(trend: DataFrame) -> DataFrame:
    """One row about a trend: its mean over all points, real or filled, and its extent."""
    real = F.col("point_type") == POINT_REAL
    return trend.agg(
        F.avg("value").alias("mean_value"),
        F.count_if(real).alias("real_points"),
        F.count_if(~real).alias("filled_points"),
        F.min("hour").alias("start_time"),
        F.max("hour").alias("end_time"),
    ).withColumn("fill_strategy", F.lit(FILL_STRATEGY))
