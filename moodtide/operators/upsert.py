"""Keyed upserts: one full outer join on the key.

The incoming side is first cut to one row per key, so the join is one to one however often a
key repeats in a batch. The stored side is never aggregated: when it is bucketed by the key,
only the incoming rows move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(incoming: DataFrame, key: str, seq: str, refresh: list[str]) -> DataFrame:
    """First row per key by ``seq``, with the ``refresh`` columns of the last one.

    That is what a row-by-row upsert of the batch would leave behind for a new key.
    """
    kept = [c for c in incoming.columns if c not in (key, seq) and c not in refresh]
    aggregates = []
    if kept:
        aggregates.append(F.min_by(F.struct(*kept), seq).alias("_first"))
    aggregates.append(F.max_by(F.struct(*refresh), seq).alias("_last"))
    merged = incoming.groupBy(key).agg(*aggregates)
    return merged.select(
        key,
        *[F.col(f"_first.{c}").alias(c) for c in kept],
        *[F.col(f"_last.{c}").alias(c) for c in refresh],
    )


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    key: str,
    refresh: list[str],
    seq: str | None = None,
) -> DataFrame:
    """Insert unknown keys whole; on known keys overwrite only the ``refresh`` columns.

    ``seq`` orders repeated keys inside ``incoming``; leave it out when keys are unique.
    Stored rows without an incoming partner stay as they are.
    """
    new = incoming if seq is None else one_per_key(incoming, key, seq, refresh)
    columns = [c for c in stored.columns if c != key]
    old = stored.select(key, F.struct(*columns).alias("_old"))
    new = new.select(key, F.struct(*columns).alias("_new"))
    joined = old.join(new, key, "full_outer")

    def pick(name: str):
        first, second = ("_new", "_old") if name in refresh else ("_old", "_new")
        return (
            F.when(F.col(first).isNotNull(), F.col(f"{first}.{name}"))
            .otherwise(F.col(f"{second}.{name}"))
            .alias(name)
        )

    return joined.select(*[key if c == key else pick(c) for c in stored.columns])


def upsert_posts(stored: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """A post seen again only corrects its post time and update time."""
    return upsert(stored, incoming, "source_post_id", ["post_time", "update_time"], seq)


def upsert_sentiment(stored: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """A post scored again replaces everything but the row id."""
    refresh = [c for c in stored.columns if c not in ("id", "raw_data_id")]
    return upsert(stored, incoming, "raw_data_id", refresh, seq)


def upsert_profiles(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A recomputed profile replaces the old one; users not recomputed keep theirs."""
    refresh = [c for c in stored.columns if c != "user_id"]
    return upsert(stored, incoming, "user_id", refresh)
