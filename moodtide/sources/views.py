"""The engine's inputs as views over the given parquet tables.

Everything here is a projection or grouping by Spark of a given table, so its size follows
that table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.fixed_values import (
    LABEL_NEGATIVE,
    LABEL_NEUTRAL,
    LABEL_POSITIVE,
    LEVEL_HIGH,
    LEVEL_LOW,
    LEVEL_MID,
)

AS_OF = dt.datetime(2024, 1, 30, 23, 0, 0)
ID_FACTOR = 7919
POSTS_PER_PAGE = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_k():
    return F.get_json_object("props", "$.k").cast("int")


def post_id():
    number = (F.col("event_id") * ID_FACTOR).cast("string")
    return (
        F.when(F.col("event_id") % 13 == 0, F.concat(number, F.lit("x")))
        .when(F.col("event_id") % 17 == 0, F.concat(F.lit("12345678"), number))
        .otherwise(number)
    )


def posts(spark: SparkSession, sf_dir: str, by_day: bool = True) -> DataFrame:
    """POST: events as posts. ``by_day`` makes one user per user and day."""
    return posts_from(table(spark, sf_dir, "events"), by_day)


def posts_from(events: DataFrame, by_day: bool = True) -> DataFrame:
    events = events.withColumn("k", number_k())
    k = F.col("k")
    user = F.col("user_id").cast("string")
    if by_day:
        user = F.concat(user, F.lit("-"), F.date_format("ts", "MMdd"))
    status = (
        F.when(F.col("event_type") != "error", 2).when(k % 2 == 1, 1).otherwise(0).cast("int")
    )
    return events.select(
        F.col("event_id").alias("id"),
        post_id().alias("source_post_id"),
        user.alias("user_id"),
        F.col("event_type").alias("topic"),
        F.concat(
            F.lit("<b>"),
            "event_type",
            F.lit("</b> https://x.example/"),
            F.col("event_id").cast("string"),
            F.lit(" $"),
            "props",
            F.lit("$  end"),
        ).alias("content"),
        F.when(status == 1, F.when(k % 3 == 0, "").otherwise(F.col("event_type")))
        .when(status == 2, F.col("event_type"))
        .alias("clean_content"),
        F.when(status == 2, k.cast("double") / 100.0).alias("sentiment_score"),
        F.when(
            status == 2,
            F.when(k < 40, LABEL_NEGATIVE).when(k < 60, LABEL_NEUTRAL).otherwise(LABEL_POSITIVE),
        ).alias("sentiment_label"),
        F.col("ts").alias("post_time"),
        F.col("ts").alias("create_time"),
        F.col("ts").alias("update_time"),
        status.alias("process_status"),
    )


def stage_tables(post_table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw, clean, scored) as the stages would have left them."""
    raw = post_table.select(
        "id", "source_post_id", "user_id", "topic", "content", "post_time", "create_time",
        "update_time",
    )
    clean = post_table.where("process_status >= 1").select("id", "clean_content", "update_time")
    scored = post_table.where("process_status = 2").select(
        "id", "sentiment_score", "sentiment_label", "update_time"
    )
    return raw, clean, scored


def sentiment(post_table: DataFrame) -> DataFrame:
    """USER_SENTIMENT: the scored posts."""
    return post_table.where("process_status = 2").select(
        "id",
        F.col("id").alias("raw_data_id"),
        "user_id",
        "clean_content",
        "sentiment_score",
        "sentiment_label",
        F.col("post_time").alias("analyze_time"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CATALOG: parts as products."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("product_id"),
        F.concat("p_name", F.lit(" "), key.cast("string")).alias("product_name"),
        F.col("p_type").alias("product_type"),
        F.when(F.col("p_size") % 3 == 0, LEVEL_LOW)
        .when(F.col("p_size") % 3 == 1, LEVEL_MID)
        .otherwise(LEVEL_HIGH)
        .alias("risk_rating"),
        (F.col("p_size").cast("double") * 0.5).alias("annual_yield"),
        ((F.col("p_retailprice") - 900.0) / 5.0).alias("max_drawdown"),
        ((key % 50).cast("double") / 20.0).alias("sharpe_ratio"),
        F.when(key % 3 == 0, '["a","b"]')
        .when(key % 3 == 1, '{"x":"a","y":"b"}')
        .otherwise('"plain"')
        .alias("tags"),
        F.when(
            key % 7 != 0, F.concat(F.lit("https://shop.example/"), key.cast("string"))
        ).alias("purchase_url"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB: the first three vector elements as (negative, neutral, positive) logits."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        *[F.col("embedding")[i].cast("double").alias(f"z{i}") for i in range(3)],
    )


LABEL_WORDINGS = [
    "LABEL_0",
    " Very-Positive ",
    "neutral",
    "NEG",
    "bull_ish",
    "积极",
    "中性",
    "消极",
    None,
    "Pessimistic",
    "non-neutral negative",
]


def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output labels of models: every part stands for a model of one to four outputs."""
    key = F.col("p_partkey")
    wordings = F.array(*[F.lit(w) for w in LABEL_WORDINGS])
    numbered = table(spark, sf_dir, "part").select(
        key.alias("model_id"),
        (F.floor(key / 4) % 4 + 1).cast("int").alias("num_labels"),
        F.col("p_size"),
    )
    return numbered.select(
        "model_id",
        "num_labels",
        "p_size",
        F.explode(F.sequence(F.lit(0), F.col("num_labels") - 1)).alias("label_index"),
    ).select(
        "model_id",
        "num_labels",
        "label_index",
        F.get(
            wordings,
            (
                (F.col("model_id") + F.col("label_index") * F.col("p_size"))
                % len(LABEL_WORDINGS)
            ).cast("int"),
        ).alias("raw_label"),
    )


TIME_TEXTS = [
    "date_format(ts, 'yyyy-MM-dd HH:mm')",
    "date_format(ts, 'yyyy/MM/dd HH:mm')",
    "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "date_format(ts, 'MM-dd HH:mm')",
    "date_format(ts, 'MM/dd HH:mm')",
    "date_format(ts, 'yyyy/MM/dd HH:mm:ss')",
    "concat('  ', date_format(ts, 'yyyy-M-d H:m'), '  ')",
    "concat('02-29 ', date_format(ts, 'HH:mm'))",
    "concat('posted ', date_format(ts, 'yyyy-MM-dd HH:mm'))",
    "concat(date_format(ts, 'yyyy-MM'), '-31 24:00')",
    "''",
    "CAST(NULL AS STRING)",
]


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post times as pages would spell them, good and bad."""
    shapes = F.array(*[F.expr(text) for text in TIME_TEXTS])
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.get(shapes, (F.col("event_id") % len(TIME_TEXTS)).cast("int")).alias("time_text"),
    )


def real_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forum list pages written from events, 40 posts a page.

    Three of four pages mark posts with an id attribute, the fourth has the older rows. Times
    come from the script block, a tag, the running text, or not at all.
    """
    return list_pages_from(table(spark, sf_dir, "events"))


def list_pages_from(events: DataFrame) -> DataFrame:
    n = F.col("event_id")
    page_id = F.floor(n / POSTS_PER_PAGE).cast("long")
    variant = n % 5
    pid = post_id()
    title = F.concat(F.lit("post <i>"), "event_type", F.lit("</i> &amp; "), n.cast("string"))
    target = F.concat(F.lit('href="/news,zssh000001,'), pid, F.lit('.html"'))
    marked = F.concat(F.lit('<a data-postid=" '), pid, F.lit(' " '), target, F.lit(">"))
    plain = F.concat(F.lit("<a "), target, F.lit(">"))
    anchor = F.when(page_id % 4 == 3, plain).otherwise(marked)
    hidden = F.when((n % 11 == 0) & (page_id % 4 != 3), F.concat(marked, F.lit(" </a>")))
    again = F.when(
        (n % POSTS_PER_PAGE == 7) & (page_id % 4 != 3),
        F.concat(F.lit("<div>"), marked, F.lit("said again</a></div>")),
    )
    author = F.when(
        ~((number_k() % 10 == 0) & variant.isin(1, 2)),
        F.concat(
            F.lit('<span class="x l4"><b>u</b>'), F.col("user_id").cast("string"), F.lit("</span>")
        ),
    )
    time = (
        F.when(
            variant == 1,
            F.concat(F.lit('<span class="l5">'), F.date_format("ts", "MM-dd HH:mm"), F.lit("</span>")),
        )
        .when(
            variant == 2,
            F.concat(
                F.lit('<em class="posttime">'),
                F.date_format("ts", "yyyy-MM-dd HH:mm"),
                F.lit("</em>"),
            ),
        )
        .when(
            variant == 3,
            F.concat(F.lit("<p>on "), F.date_format("ts", "yyyy/MM/dd HH:mm"), F.lit(" here<br></p>")),
        )
    )
    empty = F.lit("")
    row = F.concat(
        F.lit('<div class="articleh normal"><span>'),
        F.coalesce(hidden, empty),
        anchor,
        title,
        F.lit("</a></span>"),
        F.coalesce(author, empty),
        F.coalesce(time, empty),
        F.lit("</div>"),
        F.coalesce(again, empty),
    )
    note = F.when(
        variant == 0,
        F.concat(
            F.lit('{"user":{"nick":"}a{"},"post_id":'),
            F.when(n % 2 == 0, pid).otherwise(F.concat(F.lit('"'), pid, F.lit('"'))),
            F.lit(',"post_publish_time":"'),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.lit('"}'),
        ),
    )
    rows = events.select(
        page_id.alias("page_id"), F.struct("event_id", row.alias("row"), note.alias("note")).alias("r")
    )
    # a page is a fixed number of rows
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return pages.select(
        "page_id",
        F.concat(F.lit("https://forum.example/list,"), F.col("page_id").cast("string")).alias("url"),
        F.concat(
            F.lit("<!DOCTYPE html><html><body><div><div><div><div><div><div>"),
            F.concat_ws("", F.col("rows.row")),
            F.lit("</div></div></div></div></div></div><script>var list={\"re\":["),
            F.concat_ws(",", F.col("rows.note")),
            F.lit("]};</script></body></html>"),
        ).alias("html"),
    )
