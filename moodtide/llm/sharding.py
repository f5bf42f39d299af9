"""Balanced shards of indivisible groups by largest differencing."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from moodtide.llm.frames import groups_for, stored, text_key, text_of

PER_CHUNK = 20_000
FAN_IN = 256
PER_NUMBERED = 20_000


def differencing(sums: list[list[int]]) -> list[list[int]]:
    """Karmarkar-Karp for partial partitions of k subsets each.

    The two partial partitions of the largest spread are combined, the largest subset of one with
    the smallest of the other, until one is left. Returns, for each input and each of its subsets,
    the subset of the result it went to. Equal spreads go by the order of arrival.
    """
    if not sums:
        return []
    k = len(sums[0])
    # nodes of a forest: leaves are (input, subset), inner nodes two children
    left, right, heap = [], [], []
    for i, own in enumerate(sums):
        order = sorted(range(k), key=lambda j: (-own[j], j))
        nodes = []
        for j in order:
            nodes.append(len(left))
            left.append(-1 - i)
            right.append(j)
        low = own[order[-1]]
        heap.append((low - own[order[0]], i, [own[j] - low for j in order], nodes))
    heapq.heapify(heap)
    serial = len(sums)
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        made = []
        for j in range(k):
            left.append(a_nodes[j])
            right.append(b_nodes[k - 1 - j])
            made.append((-(a[j] + b[k - 1 - j]), len(left) - 1))
        made.sort()
        low = -made[-1][0]
        total = [-s - low for s, _ in made]
        heapq.heappush(heap, (-total[0], serial, total, [node for _, node in made]))
        serial += 1
    placed = [[0] * k for _ in sums]
    for shard, root in enumerate(heap[0][3]):
        stack = [root]
        while stack:
            node = stack.pop()
            if left[node] < 0:
                placed[-1 - left[node]][right[node]] = shard
            else:
                stack += (left[node], right[node])
    return placed


def place_items(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Assign the groups of one chunk to the chunk's own k subsets."""

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k1", "k2"])
        placed = differencing([[int(s)] + [0] * (k - 1) for s in rows["bytes"]])
        return rows.assign(subset=np.array([p[0] for p in placed], dtype=np.int32))

    return place


def place_chunks(rows: pd.DataFrame) -> pd.DataFrame:
    """Combine the partial partitions of some chunks into their parent's."""
    rows = rows.sort_values("chunk")
    return rows.assign(places=differencing([[int(s) for s in x] for x in rows["sums"]]))[["chunk", "parent", "places"]]


def sums_of(rows: DataFrame, key: str, k: int) -> DataFrame:
    """One row per chunk with its k sums; rows: key, subset, bytes."""
    at = [F.sum(F.when(F.col("subset") == j, F.col("bytes")).otherwise(0)).cast("long") for j in range(k)]
    return rows.groupBy(F.col(key).alias("chunk")).agg(F.array(*at).alias("sums"))


def balance(groups: DataFrame, k: int, per_chunk: int = PER_CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """k1, k2, bytes of indivisible groups -> k1, k2, shard from 0 to k - 1.

    Chunks of about ``per_chunk`` groups are differenced each in a task of its own; what is left
    of a chunk is one partial partition of k sums. Up to ``fan_in`` of those are combined by the
    same rule per task, level by level, so no task and not the driver sees more than that.
    """
    groups = stored(groups, "groups")
    chunks = groups_for(groups.count(), per_chunk)
    items = stored(
        groups.withColumn("chunk", F.pmod(F.col("k1"), F.lit(chunks)))
        .groupBy("chunk")
        .applyInPandas(place_items(k), "k1 long, k2 long, bytes long, chunk long, subset int"),
        "items",
    )
    levels, sums, left = [], sums_of(items, "chunk", k), chunks
    while left > 1:
        left = groups_for(left, fan_in)
        placed = stored(
            sums.withColumn("parent", F.col("chunk") % left)
            .groupBy("parent")
            .applyInPandas(place_chunks, "chunk long, parent long, places array<int>"),
            "places",
        )
        parts = sums.join(placed, "chunk").select(
            "parent", F.explode(F.arrays_zip("places", "sums")).alias("part")
        ).select("parent", F.col("part.places").alias("subset"), F.col("part.sums").alias("bytes"))
        levels.append(placed)
        sums = sums_of(parts, "parent", k)
    # the way down: where each subset of a chunk ends in the whole
    way = None
    for placed in reversed(levels):
        if way is None:
            way = placed.select("chunk", "places")
        else:
            above = way.select(F.col("chunk").alias("parent"), F.col("places").alias("above"))
            way = placed.join(above, "parent").select(
                "chunk", F.transform("places", lambda p: F.get(F.col("above"), p)).alias("places")
            )
    if way is None:
        return items.select("k1", "k2", F.col("subset").alias("shard"))
    return items.join(way, "chunk").select("k1", "k2", F.get("places", F.col("subset")).alias("shard"))


def numbered(rows: DataFrame, by: str, order: list[str], per_group: int = PER_NUMBERED) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each value of ``by``, without one task per value."""
    rows = stored(rows, "numbered")
    parts = max(64, groups_for(rows.count(), per_group))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(by, "part").agg(F.count(F.lit(1)).alias("n")).select(
        by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    within = F.row_number().over(Window.partitionBy(by, "part").orderBy(*order)) - 1
    return (
        rows.withColumn("within", within)
        .join(starts, [by, "part"])
        .withColumn("slot", (F.col("start") + F.col("within")).cast("long"))
        .drop("part", "within", "start")
    )


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, by the law ``bytes``.

    A document's size is its UTF-8 bytes (null: none) plus 1. Documents of equal text, null and
    empty alike, form a group that stays together; groups are dealt so that the sizes of the
    shards come out near equal, as far as the largest group allows. Slots number the documents of
    a shard without gaps from 0, in the order of hashed parts and of ids within them; rows that
    are repeated whole count each for itself. grown_shard is null under this law.
    """
    text = text_of(text_col)
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            *text_key(text),
        ),
        "sizes",
    )
    groups = rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"))
    placed = rows.join(balance(groups, shards), ["k1", "k2"]).select("doc_id", "size", "text_crc32", "shard")
    return numbered(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
