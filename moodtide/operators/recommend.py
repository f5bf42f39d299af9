"""Best products for every user at once.

A product's score is a straight line in the user's volatility. Per risk level the range of
volatilities is divided, and divided again, until only a few lines can be among the best anywhere in
a part. Those parts and their products are a table that depends on the catalogue alone. A user looks up
the one part its volatility lies in and ranks the few products there, without any shuffle of users.

The lookup goes by w = v / (1 + v), which maps every volatility v >= 0 into [0, 1). Scaled by
(1 - w), a score a - b*v becomes a - (a + b)*w: still a line, with the same order among the
products of one user. Lines are compared at both ends of a part, which is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.fixed_values import (
    DRAWDOWN_WEIGHT,
    RISK_LEVELS,
    SHARPE_SCALE,
    SHARPE_WEIGHT,
    TOP_PRODUCTS,
    YIELD_WEIGHT,
)
from moodtide.functions import risk
from moodtide.functions.tags import tags_array
from moodtide.session import fresh_dir

NUMBERS = ["annual_yield", "sharpe_ratio", "max_drawdown"]
SHOWN = ["product_name", "product_type", "tags", "purchase_url"]

FIRST_BUCKETS = 8
SPLIT = 8
LINES_AT_ONCE = 1_000_000
FEW = 8
NARROWEST = 2.0**-40
LOOKUP = 256
BAR_GROUPS = 16
ROUNDING = 1e-9


def _base(annual_yield: Column, sharpe: Column) -> Column:
    """The part of a score that does not depend on the user."""
    return annual_yield * YIELD_WEIGHT + sharpe * SHARPE_SCALE * SHARPE_WEIGHT


def _refine(candidates: DataFrame, buckets: int, split: int, k: int) -> DataFrame:
    """Split each bucket and drop, per part, what ``k`` others beat at both of its ends."""
    a = _base(F.col("annual_yield"), F.col("sharpe_ratio"))
    b = F.col("max_drawdown") * DRAWDOWN_WEIGHT
    parts = candidates.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
    parts = parts.withColumn("bucket", F.col("bucket") * split + F.col("_part")).drop("_part")
    width = 1.0 / (buckets * split)
    left = a - (a + b) * (F.col("bucket") * width)
    right = a - (a + b) * ((F.col("bucket") + 1) * width)
    slack = (F.abs(a) + F.abs(b)) * ROUNDING
    ranged = parts.withColumn("_low", F.least(left, right) - slack).withColumn(
        "_high", F.greatest(left, right) + slack
    )
    # The k-th best of the bests of some groups of products: k products reach it, and it
    # takes hash aggregation only. One row per level and bucket, whatever the catalogue holds.
    group = F.pmod(F.xxhash64("product_id"), F.lit(BAR_GROUPS))
    bars = (
        ranged.groupBy("risk_rating", "bucket", group.alias("_group"))
        .agg(F.max("_low").alias("_best"))
        .groupBy("risk_rating", "bucket")
        .agg(F.get(F.sort_array(F.collect_list("_best"), asc=False), F.lit(k - 1)).alias("_bar"))
    )
    if buckets * split * len(RISK_LEVELS) <= 10_000:
        bars = F.broadcast(bars)
    return (
        ranged.join(bars, ["risk_rating", "bucket"], "left")
        .where(F.col("_bar").isNull() | (F.col("_high") >= F.col("_bar")))
        .drop("_low", "_high", "_bar")
    )


def divided(a: np.ndarray, b: np.ndarray, low: float, high: float, k: int, few: int = FEW) -> list:
    """(low, high, line numbers) of the parts of a range: all lines that can be among the ``k`` best there.

    A part with more than ``few`` such lines is halved, unless the halves would hold nearly all of
    them again: then they lie too close for any division.
    """
    slack = (np.abs(a) + np.abs(b)) * ROUNDING

    def best(lines: np.ndarray, low: float, high: float) -> np.ndarray:
        if len(lines) <= k:
            return lines
        ends = np.stack([a[lines] - (a[lines] + b[lines]) * w for w in (low, high)])
        bar = np.partition(ends.min(0) - slack[lines], len(lines) - k)[len(lines) - k]
        return lines[ends.max(0) + slack[lines] >= bar]

    done, open_parts = [], [(low, high, best(np.arange(len(a)), low, high))]
    while open_parts:
        low, high, lines = open_parts.pop()
        middle = (low + high) / 2
        left, right = best(lines, low, middle), best(lines, middle, high)
        if len(lines) <= few or high - low <= NARROWEST or len(left) + len(right) > 1.75 * len(lines):
            done.append((low, high, lines))
        else:
            open_parts += [(middle, high, right), (low, middle, left)]
    return done


def build_cells(
    products: DataFrame,
    k: int = TOP_PRODUCTS,
    first_buckets: int = FIRST_BUCKETS,
    path: str | None = None,
    lines_at_once: int = LINES_AT_ONCE,
) -> DataFrame:
    """(risk_level, _bucket, low, high, _options): the products to rank for a volatility, stored in ``path``.

    The first cut needs no shuffle of the catalogue: the bars are a hash aggregate, and what
    falls below them is dropped where it was read. Products on the very same line tie for
    every user, so the ``k`` lowest ids of them stand for all. What is left of a level in one of the
    first buckets is divided by one task; buckets of over ``lines_at_once`` lines are split before.
    ``first_buckets`` is a power of two. A part lies under each of the ``LOOKUP`` buckets it reaches into.
    """
    spark = products.sparkSession
    line = (_base(F.col("annual_yield"), F.col("sharpe_ratio")), "max_drawdown")
    alike = W.partitionBy("risk_rating", "bucket", *line).orderBy("product_id")
    table = (
        products.where(F.col("risk_rating").isin(*RISK_LEVELS))
        .select("risk_rating", "product_id", *NUMBERS)
        .withColumn("bucket", F.lit(0))
    )
    buckets, split, before = 1, first_buckets, None
    while True:
        kept = _refine(table, buckets, split, k)
        kept = kept.withColumn("_copy", F.row_number().over(alike)).where(F.col("_copy") <= k).drop("_copy")
        aside = fresh_dir(spark, "lines")
        kept.write.parquet(aside)
        table, buckets, split = spark.read.parquet(aside), buckets * split, SPLIT
        largest = table.groupBy("risk_rating", "bucket").count().agg(F.max("count")).first()[0] or 0
        if largest <= lines_at_once or (before is not None and largest > 0.75 * before):
            break
        before = largest

    def divide(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
        level, bucket = key
        lines = lines.sort_values("product_id")
        parts = divided(
            lines["_a"].to_numpy(), lines["_b"].to_numpy(), bucket / buckets, (bucket + 1) / buckets, k
        )
        ids = lines["product_id"].to_numpy()
        found = [pd.DataFrame({"low": low, "high": high, "product_id": ids[chosen]}) for low, high, chosen in parts]
        return pd.concat(found).assign(risk_level=level)

    cells = (
        table.select(
            "risk_rating",
            "bucket",
            "product_id",
            line[0].alias("_a"),
            (F.col("max_drawdown") * DRAWDOWN_WEIGHT).alias("_b"),
        )
        .groupBy("risk_rating", "bucket")
        .applyInPandas(divide, "low double, high double, product_id long, risk_level string")
    )
    first, end = F.floor(F.col("low") * LOOKUP), F.ceil(F.col("high") * LOOKUP)
    reached = F.sequence(first.cast("int"), (end - 1).cast("int"))
    path = path or fresh_dir(spark, "cells")
    (
        cells.join(products.select("product_id", *NUMBERS, *SHOWN), "product_id")
        .groupBy("risk_level", "low", "high")
        .agg(F.collect_list(F.struct("product_id", *NUMBERS, *SHOWN)).alias("_options"))
        .select("risk_level", F.explode(reached).alias("_bucket"), "low", "high", "_options")
        # as large on disk as in memory, so that Spark broadcasts it by its true size or not at all
        .write.option("compression", "uncompressed")
        .option("parquet.enable.dictionary", "false")
        .mode("overwrite")
        .parquet(path)
    )
    return spark.read.parquet(path)


def best_products(profiles: DataFrame, cells: DataFrame, k: int = TOP_PRODUCTS) -> DataFrame:
    """(user, rank) rows with the raw score; ties go to the lower product id."""
    w = F.col("volatility") / (F.col("volatility") + 1)
    users = profiles.withColumn("_w", F.greatest(F.lit(0.0), F.least(w, F.lit(1 - 2.0**-53)))).withColumn(
        "_bucket", F.floor(F.col("_w") * LOOKUP).cast("int")
    )
    inside = (F.col("_w") >= F.col("low")) & (F.col("_w") < F.col("high"))
    met = users.join(
        cells.withColumnsRenamed({"risk_level": "_level", "_bucket": "_place"}),
        (F.col("risk_level") == F.col("_level")) & (F.col("_bucket") == F.col("_place")) & inside,
    )

    def scored(option: Column) -> Column:
        score = risk.product_score(
            option["annual_yield"],
            option["sharpe_ratio"],
            option["max_drawdown"],
            F.col("volatility"),
        )
        return F.struct(
            (-score).alias("_order"),
            option["product_id"].alias("product_id"),
            *[option[c].alias(c) for c in [*NUMBERS, *SHOWN]],
        )

    best = F.slice(F.sort_array(F.transform("_options", scored)), 1, k)
    ranked = met.select(*profiles.columns, F.posexplode(best).alias("_pos", "_best"))
    return ranked.select(
        *profiles.columns,
        (F.col("_pos") + 1).alias("rank"),
        *[F.col(f"_best.{c}").alias(c) for c in ["product_id", *NUMBERS, *SHOWN]],
        (-F.col("_best._order") + 0.0).alias("score"),
    )


def recommendations(best: DataFrame) -> DataFrame:
    """The answer as shown: rounded score, reason, tags."""
    code = risk.reason_code(F.col("avg_sentiment"), F.col("volatility"), F.col("annual_yield"))
    return best.withColumn("reason_code", code).select(
        "user_id",
        "rank",
        "product_id",
        "product_name",
        "product_type",
        F.col("risk_level").alias("risk_rating"),
        *NUMBERS,
        F.round("score", 2).alias("recommendation_score"),
        "reason_code",
        risk.reason_text(
            F.col("reason_code"),
            F.col("annual_yield"),
            F.col("max_drawdown"),
            F.col("sharpe_ratio"),
            F.col("score"),
        ).alias("recommend_reason"),
        tags_array(F.col("tags")).alias("tags"),
        "purchase_url",
    )


def recommendation_bands(best: DataFrame) -> DataFrame:
    return best.select(
        "user_id",
        "rank",
        "product_id",
        risk.score_band(F.col("score")).alias("score_band"),
        risk.drawdown_band(F.col("max_drawdown")).alias("drawdown_band"),
        risk.sentiment_band(F.col("avg_sentiment")).alias("sentiment_band"),
        risk.volatility_band(F.col("volatility")).alias("volatility_band"),
    )
