"""Product catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.fixed_values import RISK_LEVELS
from moodtide.functions.tags import tags_array, tags_array_lenient


def catalog_listing(products: DataFrame) -> DataFrame:
    """By level from low to high, then yield. Unknown levels come first (order 0)."""
    order = F.array_position(F.array(*[F.lit(level) for level in RISK_LEVELS]), F.col("risk_rating"))
    return products.select(
        order.alias("level_order"),
        "product_id",
        "product_name",
        "risk_rating",
        "annual_yield",
        "max_drawdown",
        "sharpe_ratio",
    ).orderBy("level_order", "annual_yield", "product_id")


def catalog_tags(products: DataFrame) -> DataFrame:
    """Tags as stored lists, read strictly and leniently."""
    return products.select(
        "product_id",
        tags_array(F.col("tags")).alias("tags"),
        tags_array_lenient(F.col("tags")).alias("shown_tags"),
    )
