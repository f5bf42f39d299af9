"""Retention and the purge of posts with unusable ids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.fixed_values import RETENTION_DAYS
from moodtide.functions.ids import is_dirty_post_id
from moodtide.functions.times import ntz


def cutoff(as_of: dt.datetime, days: int = RETENTION_DAYS) -> dt.datetime:
    return as_of - dt.timedelta(days=days)


def prune_posts(posts: DataFrame, as_of: dt.datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Posts that stay: created at the cutoff or later. Prunes partitions by create time."""
    return posts.where(F.col("create_time") >= ntz(cutoff(as_of, days)))


def prune_summary(posts: DataFrame, as_of: dt.datetime, days: int = RETENTION_DAYS) -> DataFrame:
    old = F.col("create_time") < ntz(cutoff(as_of, days))
    return posts.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))


def purge_dirty_ids(posts: DataFrame) -> DataFrame:
    return posts.where(~is_dirty_post_id(F.col("source_post_id")))


def dirty_summary(posts: DataFrame) -> DataFrame:
    """Dirty and remaining counts in one pass."""
    dirty = is_dirty_post_id(F.col("source_post_id"))
    return posts.agg(F.count_if(dirty).alias("dirty"), F.count_if(~dirty).alias("remaining"))


def dirty_sample(posts: DataFrame, size: int = 10) -> DataFrame:
    """A small report of dirty rows: id, its length in bytes, start of the content."""
    return (
        posts.where(is_dirty_post_id(F.col("source_post_id")))
        .orderBy("id")
        .limit(size)
        .select(
            "source_post_id",
            F.octet_length("source_post_id").alias("id_len"),
            F.substring("content", 1, 30).alias("content_start"),
        )
    )
