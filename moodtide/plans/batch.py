"""The batch chain: pages, posts, clean text, sentiment, profiles, answers.

Every stage reads tables, appends or replaces one, and can be run again: it takes up what is
missing. Nothing passes through the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.functions.times import ntz
from moodtide.operators import pages as page_ops
from moodtide.operators import profile, status
from moodtide.operators.constraints import product_defaults, with_defaults
from moodtide.operators.recommend import build_cells
from moodtide.operators.retention import cutoff
from moodtide.operators.upsert import upsert_profiles
from moodtide.sources.tables import Tables

Scorer = Callable[[DataFrame], DataFrame]


def ingest(tables: Tables, pages: DataFrame, as_of: dt.datetime, batch: int) -> dict:
    """Parse landed pages and upsert their posts. Returns the run's counters.

    The parsed rows stay with the batch, so a repeated round counts and merges the same ones.
    """
    landed = tables.landed(
        "raw_data", batch, lambda: page_ops.landed_rows(page_ops.page_posts(pages, as_of), as_of)
    )
    tables.merge(
        "raw_data",
        landed,
        "source_post_id",
        ["post_time", "update_time"],
        "seq",
        batch,
    )
    return {"upsert_rows": landed.count()}


def clean(tables: Tables, as_of: dt.datetime, batch: int, max_chars: int | None = None) -> None:
    pending = status.pending_posts(tables.posts(), tables.appended("posts_clean", batch))
    tables.append("posts_clean", status.clean_batch(pending, as_of, max_chars), batch)


def score(tables: Tables, scorer: Scorer, as_of: dt.datetime, batch: int) -> None:
    """Score what is cleaned, then carry it over into ``user_sentiment``.

    The scored rows are read back, so the model runs once per post. What is carried over is
    this round's rows and whatever ``user_sentiment`` lacks of earlier ones, so a round cut short
    between the two is made good, and a post that came back replaces its old score.
    """
    ready = status.scorable_posts(
        tables.posts(), tables.appended("posts_clean"), tables.appended("posts_scored", batch)
    )
    tables.append("posts_scored", status.scored_batch(scorer(ready), as_of), batch)
    known = tables.stored("user_sentiment").select(F.col("raw_data_id").alias("id"))
    missed = tables.appended("posts_scored", batch).join(known, "id", "left_anti")
    rows = (
        tables.batch("posts_scored", batch)
        .unionByName(missed)
        .join(tables.appended("posts_clean").select("id", "clean_content"), "id")
        .join(tables.posts().select("id", "user_id"), "id")
    )
    new = status.sentiment_rows(rows, as_of).withColumn("seq", F.lit(0))
    refresh = [c for c in new.columns if c not in ("id", "raw_data_id", "seq")]
    tables.merge("user_sentiment", new, "raw_data_id", refresh, "seq", batch)


def profiles(tables: Tables, as_of: dt.datetime) -> None:
    fresh = profile.risk_profiles(tables.stored("user_sentiment")).withColumn(
        "update_time", ntz(as_of)
    )
    tables.replace("risk_profile", upsert_profiles(tables.read("risk_profile"), fresh))


def prune(tables: Tables, as_of: dt.datetime) -> int:
    """Delete posts past retention, to the second, and what the stages made of them.

    Returns the number of posts deleted. One that is crawled again starts over as a new post.
    """
    return tables.drop_posts(cutoff(as_of), ("posts_clean", "posts_scored"))


def reload_catalog(tables: Tables, products: DataFrame) -> int:
    """Replace the catalogue, missing numbers at their defaults, and report its size.

    What is looked up per volatility is made of it here, once, under the catalogue's version.
    """
    version = tables.replace("products", with_defaults(products, product_defaults()))
    build_cells(tables.read("products"), path=f"{tables.path('product_cells')}/v={version}")
    return tables.read("products").count()


def run(
    tables: Tables, pages: DataFrame, scorer: Scorer, as_of: dt.datetime, batch: int, max_chars: int | None = None
) -> dict:
    """One round, retention at its end. A stage that fails ends it; the next one resumes from the tables."""
    counters = ingest(tables, pages, as_of, batch)
    clean(tables, as_of, batch, max_chars)
    score(tables, scorer, as_of, batch)
    profiles(tables, as_of)
    return {**counters, "deleted": prune(tables, as_of)}
