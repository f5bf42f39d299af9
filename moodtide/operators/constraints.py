"""Column defaults, and reports on broken key constraints."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.fixed_values import STATUS_RAW
from moodtide.functions.times import ntz


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Fill missing values, and add the columns that are not there at all."""
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), default) if name in df.columns else default
            for name, default in defaults.items()
        }
    )


def post_defaults(as_of: dt.datetime) -> dict[str, Column]:
    return {
        "process_status": F.lit(STATUS_RAW),
        "create_time": ntz(as_of),
        "update_time": ntz(as_of),
    }


PRODUCT_DEFAULTS = {"max_drawdown": 0.0, "sharpe_ratio": 0.0}


def product_defaults() -> dict[str, Column]:
    return {name: F.lit(value) for name, value in PRODUCT_DEFAULTS.items()}


def restamped(df: DataFrame, changed: Column, as_of: dt.datetime) -> DataFrame:
    """``update_time`` set to ``as_of`` where ``changed`` holds."""
    return df.withColumn(
        "update_time", F.when(changed, ntz(as_of)).otherwise(F.col("update_time"))
    )


def unique_violations(df: DataFrame, key: str, name: str) -> DataFrame:
    """How many key values occur more than once; counted with map-side combine."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .count()
        .where(F.col("count") > 1)
        .agg(F.count(F.lit(1)).alias("violations"))
        .select(F.lit(name).alias("constraint_name"), "violations")
    )


def orphan_violations(
    child: DataFrame, foreign_key: str, parent: DataFrame, parent_key: str, name: str
) -> DataFrame:
    """How many child rows point nowhere.

    Children are counted per key value before they meet the parent, so no key is hot.
    """
    keys = child.where(F.col(foreign_key).isNotNull()).groupBy(foreign_key).count()
    lost = keys.join(
        parent.select(F.col(parent_key).alias(foreign_key)), foreign_key, "left_anti"
    )
    return lost.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("constraint_name"), "violations"
    )


def null_violations(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """How many nulls each required column holds; one pass for all of them."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{prefix}.{c}").alias("constraint_name"),
                        F.col(c).alias("violations"),
                    )
                    for c in columns
                ]
            )
        ).alias("r")
    ).select("r.*")


#: The unique key of each table, and the columns that hold a value in every row.
UNIQUE_KEYS = {
    "raw_data": "source_post_id", "user_sentiment": "raw_data_id", "risk_profile": "user_id", "products": "product_name",
}
REQUIRED = {
    "raw_data": ["source_post_id", "user_id", "topic", "content", "post_time", "create_time", "update_time", "process_status"],
    "user_sentiment": ["raw_data_id", "user_id", "clean_content", "sentiment_score", "sentiment_label", "analyze_time"],
    "risk_profile": ["user_id", "avg_sentiment", "volatility", "post_count", "risk_level"],
    "products": [
        "product_name", "product_type", "risk_rating", "annual_yield", "max_drawdown", "sharpe_ratio", "tags",
    ],
}


def key_violations(keys: dict[str, DataFrame]) -> DataFrame:
    """How many values occur more than once under each name; a frame has its keys in one column.

    All keys are stacked as (constraint, key) rows and counted by one aggregation, so no
    constraint is a task of its own and a value that fills half a table costs a row per task. A name
    without any key has no row.
    """
    stacked = [
        df.select(F.lit(name).alias("constraint_name"), F.col(df.columns[0]).cast("string").alias("key"))
        for name, df in keys.items()
    ]
    counted = reduce(DataFrame.unionByName, stacked).where("key IS NOT NULL").groupBy("constraint_name", "key").count()
    return counted.groupBy("constraint_name").agg(F.count_if(F.col("count") > 1).alias("violations"))


def table_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Repeated unique keys and missing required values of the tables that are given, by their names."""
    keys = {f"{t}.{UNIQUE_KEYS[t]} unique": df.select(UNIQUE_KEYS[t]) for t, df in tables.items()}
    missing = [null_violations(df, REQUIRED[t], t) for t, df in tables.items()]
    return violation_report(key_violations(keys), *missing)


def violation_report(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
