"""Declared table schemas. Nothing is inferred."""

from pyspark.sql import types as T

RAW_DATA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("source_platform", T.StringType(), False),
        T.StructField("source_post_id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("topic", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("clean_content", T.StringType(), True),
        T.StructField("sentiment_score", T.DoubleType(), True),
        T.StructField("sentiment_label", T.StringType(), True),
        T.StructField("post_time", T.TimestampNTZType(), False),
        T.StructField("create_time", T.TimestampNTZType(), False),
        T.StructField("update_time", T.TimestampNTZType(), False),
        T.StructField("process_status", T.IntegerType(), False),
    ]
)

USER_SENTIMENT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("raw_data_id", T.LongType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("clean_content", T.StringType(), False),
        T.StructField("sentiment_score", T.DoubleType(), False),
        T.StructField("sentiment_label", T.StringType(), False),
        T.StructField("analyze_time", T.TimestampNTZType(), False),
    ]
)

RISK_PROFILE = T.StructType(
    [
        T.StructField("user_id", T.StringType(), False),
        T.StructField("avg_sentiment", T.DoubleType(), False),
        T.StructField("volatility", T.DoubleType(), False),
        T.StructField("post_count", T.LongType(), False),
        T.StructField("risk_level", T.StringType(), False),
        T.StructField("update_time", T.TimestampNTZType(), False),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType(), False),
        T.StructField("product_name", T.StringType(), False),
        T.StructField("product_type", T.StringType(), False),
        T.StructField("risk_rating", T.StringType(), False),
        T.StructField("annual_yield", T.DoubleType(), False),
        T.StructField("max_drawdown", T.DoubleType(), False),
        T.StructField("sharpe_ratio", T.DoubleType(), False),
        T.StructField("tags", T.StringType(), False),
        T.StructField("purchase_url", T.StringType(), True),
    ]
)

# Working tables behind the process states: one append-only table per stage.
POSTS_CLEAN = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("clean_content", T.StringType(), True),
        T.StructField("update_time", T.TimestampNTZType(), False),
    ]
)

POSTS_SCORED = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("sentiment_score", T.DoubleType(), False),
        T.StructField("sentiment_label", T.StringType(), False),
        T.StructField("update_time", T.TimestampNTZType(), False),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType(), False),
        T.StructField("url", T.StringType(), True),
        T.StructField("html", T.StringType(), True),
    ]
)

HOURLY_SUMS = T.StructType(
    [
        T.StructField("hour", T.TimestampNTZType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("posts", T.LongType()),
    ]
)

USER_STATS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("m2", T.DoubleType()),
    ]
)

INGEST_COUNTERS = T.StructType(
    [
        T.StructField("pages", T.LongType()),
        T.StructField("pages_with_posts", T.LongType()),
        T.StructField("upsert_rows", T.LongType()),
    ]
)


TABLES = {
    "raw_data": RAW_DATA,
    "user_sentiment": USER_SENTIMENT,
    "risk_profile": RISK_PROFILE,
    "products": PRODUCTS,
    "posts_clean": POSTS_CLEAN,
    "posts_scored": POSTS_SCORED,
    "hourly_sums": HOURLY_SUMS,
    "user_stats_changed": USER_STATS,
    "ingest_counters": INGEST_COUNTERS,
    "pages": PAGES,
}
