"""Landed list pages to posts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodtide.fixed_values import (
    OLD_ROW_CLASS,
    POST_ID_ATTRIBUTE,
    SOURCE_PLATFORM,
    TIME_FROM_SCRIPT,
    TIME_FROM_TAG,
    TIME_FROM_TEXT,
    TIME_NOT_FOUND,
    TOPIC,
    UNKNOWN_AUTHOR,
)
from moodtide.functions import page_outline
from moodtide.functions.ids import is_valid_post_id, post_id_from_href
from moodtide.functions.times import ntz, parse_post_time
from moodtide.operators.constraints import post_defaults

PAGES_AT_ONCE = 64
#: Pages a task parses where they are dealt anew; a few seconds of Python.
PAGES_PER_TASK = 250
#: What holds no links though it may look so.
NOT_SHOWN = r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)"
_VALUE = r"""(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))"""
#: An attribute's value where it is not asked for, without alternatives: Java repeats such groups in
#: a loop and not on its stack, so a tag may have any number of attributes.
_ANY_VALUE = r"""(?:\s*+=\s*+(?:"[^"]*+")?+(?:'[^']*+')?+(?:(?<!["'])[^\s>"'][^\s>]*+)?+)?+"""
#: A link: target in double quotes, single quotes or none, then what stands inside, to the next <a or </a.
ANCHOR = (
    rf"(?is)<a(?=[\s/])(?:[\s/]*+(?!href\s*=)[^\s>=/]*+{_ANY_VALUE})*+[\s/]*+href\s*=\s*{_VALUE}"
    rf"(?:[\s/]*+[^\s>=/]*+{_ANY_VALUE})*+[\s/]*+>(.*?)(?=<a[\s/>]|</a[\s>]|\z)"
)
POST_LINK_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        *[
            T.StructField(name, T.StringType())
            for name in (
                "attr_id href title author tag_time text_time script_id script_time".split()
            )
        ],
    ]
)


def _per_page(pages: DataFrame, read: Callable[[str], list[dict]], schema: T.StructType) -> DataFrame:
    """Apply ``read`` to every page; Arrow batches in, Arrow batches out."""
    arrow_types = {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()
    }
    arrow_schema = pa.schema([(f.name, arrow_types[f.dataType]) for f in schema.fields])

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few pages at a time, whatever the batch holds
            for begin in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(begin, PAGES_AT_ONCE)
                rows = [
                    {"page_id": page_id.as_py(), **found}
                    for page_id, html in zip(part.column("page_id"), part.column("html"))
                    for found in read(html.as_py())
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    return pages.select("page_id", "html").mapInArrow(read_batches, schema)


def page_range(pages: DataFrame, first: int, last: int, column: str = "page_id") -> DataFrame:
    """Backfill range, both ends included."""
    return pages.where(F.col(column).between(first, last))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, text) of all hyperlinks, the first of each target per page.

    Comments and scripts hold none. Targets may be in quotes of both kinds or without, and a link
    that is not closed ends where the next begins. Targets and texts stand as the page has them:
    character references are not resolved.
    """
    anchors = F.regexp_extract_all(F.regexp_replace("html", NOT_SHOWN, ""), F.lit(ANCHOR), F.lit(0))
    found = pages.select("page_id", F.posexplode(anchors).alias("pos", "link")).select(
        "page_id",
        "pos",
        F.concat(*[F.regexp_extract("link", ANCHOR, i) for i in (1, 2, 3)]).alias("href"),
        F.trim(F.regexp_replace(F.regexp_extract("link", ANCHOR, 4), "<[^>]*>", "")).alias("text"),
    )
    seen = W.partitionBy("page_id", "href").orderBy("pos")
    return found.withColumn("_n", F.row_number().over(seen)).where(F.col("_n") == 1).drop("_n")


def dealt(pages: DataFrame, count: int) -> DataFrame:
    """``count`` pages over tasks of about PAGES_PER_TASK each, however few files they lie in.

    Parsing costs far more than moving a page, and a file of pages is read by one task.
    """
    tasks = max(1, -(-count // PAGES_PER_TASK))
    return pages.select("page_id", "html").repartition(tasks, "page_id", F.xxhash64("html"))


def page_posts(pages: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Posts of each page, first mention of an id only.

    Pages that cannot hold a post link never reach Python. A link whose title is empty still
    hides later links of the same id on that page.
    """
    listing = pages.where(F.col("html").rlike(f"(?i){POST_ID_ATTRIBUTE}|{OLD_ROW_CLASS}"))
    found = _per_page(listing, page_outline.post_links, POST_LINK_SCHEMA)
    attr_id = F.regexp_replace("attr_id", "^\\s+|\\s+\\z", "")
    own_id = F.coalesce(F.nullif(attr_id, F.lit("")), post_id_from_href(F.col("href")))
    script_time, tag_time, text_time = (
        F.nullif(F.col(c), F.lit("")) for c in ("script_time", "tag_time", "text_time")
    )
    # Times are parsed where the page was read, before rows of one post meet.
    read = found.select(
        "page_id",
        "pos",
        F.coalesce("script_id", own_id).alias("source_post_id"),
        F.coalesce(F.nullif("author", F.lit("")), F.lit(UNKNOWN_AUTHOR)).alias("user_id"),
        F.col("title").alias("content"),
        F.col("script_id").isNull().alias("_link"),
        parse_post_time(
            F.coalesce(script_time, tag_time, text_time, F.lit("")), ntz(as_of)
        ).alias("_time"),
        F.when(script_time.isNotNull(), TIME_FROM_SCRIPT)
        .when(tag_time.isNotNull(), TIME_FROM_TAG)
        .when(text_time.isNotNull(), TIME_FROM_TEXT)
        .otherwise(TIME_NOT_FOUND)
        .alias("_source"),
    ).where(is_valid_post_id(F.col("source_post_id")))
    first_seen = W.partitionBy("page_id", "source_post_id").orderBy(F.col("pos").asc_nulls_last())
    all_of_post = first_seen.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_script = F.when(F.col("_source") == TIME_FROM_SCRIPT, F.col("_time"))
    return (
        read.withColumn("_n", F.row_number().over(first_seen))
        .withColumn("_script", F.max(by_script).over(all_of_post))
        .where(F.col("_link") & (F.col("_n") == 1) & (F.col("content") != ""))
        .select(
            "page_id",
            "pos",
            "source_post_id",
            "user_id",
            "content",
            F.coalesce("_script", "_time").alias("post_time"),
            F.when(F.col("_script").isNotNull(), TIME_FROM_SCRIPT)
            .otherwise(F.col("_source"))
            .alias("time_source"),
        )
    )


def landed_rows(
    posts: DataFrame,
    as_of: dt.datetime,
    platform: str = SOURCE_PLATFORM,
    topic: str = TOPIC,
) -> DataFrame:
    """Parsed posts in the shape of ``raw_data``, with ``seq`` for the upsert.

    The row id is the numeric post id: it comes from the data, so a rerun gives it again.
    """
    defaults = post_defaults(as_of)
    return posts.select(
        F.col("source_post_id").cast("long").alias("id"),
        F.lit(platform).alias("source_platform"),
        "source_post_id",
        "user_id",
        F.lit(topic).alias("topic"),
        "content",
        F.lit(None).cast("string").alias("clean_content"),
        F.lit(None).cast("double").alias("sentiment_score"),
        F.lit(None).cast("string").alias("sentiment_label"),
        "post_time",
        *[defaults[c].alias(c) for c in ("create_time", "update_time", "process_status")],
        F.struct("page_id", "pos").alias("seq"),
    )


def ingest_counters(pages: DataFrame, posts: DataFrame) -> DataFrame:
    """Pages read, pages with posts, rows handed to the upsert, distinct posts among them."""
    read = pages.agg(F.count(F.lit(1)).alias("n")).scalar()
    return posts.agg(
        F.count_distinct("page_id").alias("pages_with_posts"),
        F.count(F.lit(1)).alias("upsert_rows"),
        F.count_distinct("source_post_id").alias("distinct_posts"),
    ).select(read.alias("pages"), "pages_with_posts", "upsert_rows", "distinct_posts")
