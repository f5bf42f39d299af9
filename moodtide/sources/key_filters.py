"""Which partitions of a table may hold a key, without a scan of the stored keys.

Each partition has its least and greatest key and a Bloom filter, cut into blocks of
``KEYS_PER_BLOCK`` keys with one bitmap of 4 KB per hash. A filter grows with its partition and takes
two bytes per key; about one key in 400 is found where it is not. Keys that went since only make a
filter say yes too often, so a partition it rules out never holds the key.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768  # what bitmap_construct_agg fills
KEYS_PER_BLOCK = 8_192
HASHES = 4
BITMAPS = [f"_bits{i}" for i in range(HASHES)]


def _order(key: str) -> Column:
    """Numbers in text compare like numbers when the shorter one comes first."""
    text = F.col(key).cast("string")
    return F.struct(F.length(text).alias("length"), text.alias("text"))


def _position(key: str, number: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(number)), F.lit(BLOCK_BITS))


def _block(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), blocks)


def _is_set(bitmap: str, position: Column) -> Column:
    byte = F.conv(F.hex(F.col(bitmap).substr((position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1


def key_filters(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(column, low, high, blocks, block, a bitmap per hash) of every partition in ``rows``."""
    known = rows.where(F.col(key).isNotNull()).select(key, column)
    # a row per partition
    sizes = known.groupBy(column).agg(
        F.min(_order(key)).alias("low"),
        F.max(_order(key)).alias("high"),
        F.ceil(F.count(F.lit(1)) / KEYS_PER_BLOCK).alias("blocks"),
    )
    return (
        known.join(F.broadcast(sizes), column)
        .groupBy(column, "low", "high", "blocks", _block(key, F.col("blocks")).alias("block"))
        .agg(*[F.bitmap_construct_agg(_position(key, i)).alias(name) for i, name in enumerate(BITMAPS)])
    )


def may_hold(filters: DataFrame, keys: DataFrame, key: str, column: str) -> DataFrame:
    """The partitions that may hold any of ``keys``, once each.

    A key meets the partitions whose range it falls in, and of each of them one block.
    """
    ranges = filters.select(column, "low", "high", "blocks").distinct()
    pairs = keys.select(key).join(F.broadcast(ranges), _order(key).between(F.col("low"), F.col("high")))
    placed = pairs.select(key, column, _block(key, F.col("blocks")).alias("block"))
    met = placed.join(filters.select(column, "block", *BITMAPS), [column, "block"])
    found = reduce(and_, [_is_set(name, _position(key, i)) for i, name in enumerate(BITMAPS)])
    return met.where(found).select(column).distinct()
