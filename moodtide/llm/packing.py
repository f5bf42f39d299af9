"""Documents packed into sequences of several permitted lengths by best fit."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.llm.frames import groups_for, stored

CAPACITIES = (512, 1024, 2048, 4096, 8192)
PER_GROUP = 20_000
#: Numbers of bins that a group has for itself; it cannot have more bins than pieces.
GROUP_BINS = 1 << 24
PACKED_NAMES = ["doc_id", "piece", "begin", "length", "bin", "capacity", "at"]
PACKED_SCHEMA = "doc_id long, piece int, begin long, length int, bin long, capacity int, at int"


def sequence_cost(capacity: int, attention: float = 16384.0) -> float:
    """Work of one sequence: in proportion to its length, and attention that grows with its square."""
    return capacity * (1 + capacity / attention)


class Remaining:
    """The lengths still to be packed, largest first within reach."""

    def __init__(self, lengths: Sequence[int]) -> None:
        self.counts = Counter(lengths)
        self.present = sum(1 << n for n in self.counts)  # bit n is set where a length n is left

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            self.present ^= 1 << length

    def filling(self, room: int) -> int:
        """Tokens that come into ``room`` when the largest length that still fits goes first."""
        free, fitting = room, self.present
        while fitting := fitting & ((1 << (free + 1)) - 1):
            n = fitting.bit_length() - 1
            free -= n * min(self.counts[n], free // n)
            fitting ^= 1 << n
        return room - free


def pack_once(
    lengths: Sequence[int], capacities: Sequence[int], costs: Sequence[float], by_filling: bool
) -> tuple[list[int], list[int], list[int]]:
    """``pack`` with one way to rate the size of a new bin: by its expected filling, or as if full."""
    largest = capacities[-1]
    by_room: list[list[int]] = [[] for _ in range(largest + 1)]
    rooms = 0  # bit r is set where a bin with r tokens of room exists
    remaining, left = Remaining(lengths), sum(lengths)
    used: list[int] = []
    room: list[int] = []
    bins, places = [], []

    def per_token(i: int, length: int) -> float:
        if not by_filling:
            return costs[i] / min(capacities[i], left)
        filled = length + remaining.filling(capacities[i] - length)
        return costs[bisect_left(capacities, filled)] / filled

    for length in lengths:
        remaining.take(length)
        fitting = rooms >> length
        if fitting:
            r = length + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            able = range(bisect_left(capacities, length), len(capacities))
            size = min(able, key=lambda i: (per_token(i, length), i))
            b = len(used)
            used.append(0)
            room.append(capacities[size])
        bins.append(b)
        places.append(used[b])
        used[b] += length
        room[b] -= length
        left -= length
        if room[b]:
            by_room[room[b]].append(b)
            rooms |= 1 << room[b]
    return bins, places, [capacities[bisect_left(capacities, n)] for n in used]


def pack(lengths: Sequence[int], capacities: Sequence[int], costs: Sequence[float]) -> tuple[list[int], list[int], list[int]]:
    """The bin and the place of each length (in decreasing order), and the final size of each bin.

    A length goes into the bin with the least room that is enough. If none is, a bin is opened of
    the size with the least cost per token it is expected to hold: what the remaining lengths bring
    into it, the largest that fits first; the smaller one if equal. In the end each bin becomes the
    smallest permitted size that holds its contents. Other open bins may get some of the expected
    lengths first, so all is packed a second time with sizes rated as if full, and the cheaper
    packing is taken, the first if equal.
    """
    ways = [pack_once(lengths, capacities, costs, by_filling) for by_filling in (True, False)]
    of_size = dict(zip(capacities, costs))
    return min(ways, key=lambda way: sum(of_size[c] for c in way[2]))


def packer(capacities: Sequence[int], costs: Sequence[float]) -> Callable:
    def pack_group(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("begin", "ascending"), ("number", "ascending")])
        bins, places, sizes = pack(rows["length"].to_pylist(), capacities, costs)
        columns = [rows[c] for c in ("doc_id", "piece", "begin", "length")]
        columns.append(pc.add(pa.array(bins, pa.int64()), pa.scalar(key[0].as_py() * GROUP_BINS, pa.int64())))
        columns += [pa.array(np.array(sizes, np.int32)[bins]), pa.array(places, pa.int32())]
        return pa.table(columns, PACKED_NAMES)

    return pack_group


def best_fit(
    lengths: DataFrame,
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost,
    per_group: int = PER_GROUP,
    id_col: str = "doc_id",
    length_col: str = "n_tokens",
) -> DataFrame:
    """Every document's pieces with their bins: doc_id, piece, begin, length, bin, capacity, at.

    Documents longer than the largest capacity are cut into pieces of that capacity and a rest;
    all others stay whole. ``at`` is where the piece begins in its bin, ``capacity`` the bin's final
    size, the smallest permitted one that holds its contents. Documents without tokens (null,
    0) have one row with length 0 and no bin. Repeated rows are packed each for itself.

    Pieces are dealt by a hash to groups of about ``per_group``, each packed on its own: only the
    last few bins of a group are less full than those of one long packing. The hash is of a number
    of the row, not of its id, so rows that share an id, or have none, are dealt like all others.
    Equal lengths go by id, null last, then by that number.
    """
    if not 0 < per_group <= GROUP_BINS // 4:
        raise ValueError(f"per_group is {per_group}; 1 to {GROUP_BINS // 4} are possible")
    sizes = sorted(set(capacities))
    largest = sizes[-1]
    costs = [cost(c) for c in sizes]
    rows = stored(
        lengths.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("n")).withColumn(
            "number", F.monotonically_increasing_id()
        ),
        "lengths",
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / largest).cast("int") - 1)
    pieces = rows.select("doc_id", "number", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id", "number", "piece", (F.col("piece").cast("long") * largest).alias("begin"), "n"
    ).withColumn("length", F.least(F.lit(largest), F.col("n") - F.col("begin")).cast("int"))
    total = rows.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / largest))), F.lit(0)).alias("n")).first()["n"]
    groups = groups_for(int(total), per_group)
    packed = (
        pieces.where("length > 0")
        .withColumn("pack_group", F.pmod(F.xxhash64("number", "piece"), F.lit(groups)))
        .groupBy("pack_group")
        .applyInArrow(packer(sizes, costs), PACKED_SCHEMA)
    )
    none = pieces.where("length = 0").select(
        "doc_id", "piece", "begin", "length", F.lit(None).cast("long").alias("bin"),
        F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("at"),
    )
    return packed.unionByName(none)
