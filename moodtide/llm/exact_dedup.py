"""Repeated texts found through a minimal perfect hash over the digests seen so far."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.llm.frames import SPACES, groups_for, stored, text_of

DIGEST_BYTES = 32
PER_BUCKET = 20_000
FIRST_SEED = 0x9E3779B97F4A7C15
GAMMA = 2.0

INDEX_SCHEMA = "bucket long, sizes array<int>, marks binary, digests binary, ids array<long>, chars array<long>, counts array<long>"
FOUND_SCHEMA = "digest binary, member boolean, old_id long, old_chars long, old_n long"


def normalised(text: Column) -> Column:
    """The text without any of ``[\\x20\\x09-\\x0D]``."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def own_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """What a row is decided by: its id, its length and its digest."""
    text = text_of(text_col)
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("chars"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
    ]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chars (code points of the text as it is) and the SHA-256 of the normalised text."""
    return docs.select(*own_key(id_col, text_col))


def winners(rows: DataFrame) -> DataFrame:
    """Per digest its number of rows and the row that stays: most chars, then smallest id."""
    best = F.min(F.struct((-F.col("chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).select(
        "digest", "n", F.col("best.doc_id").alias("win_id"), (-F.col("best.neg")).alias("win_chars")
    )


def words(digest_bytes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digest_bytes).view("<u8").reshape(len(digest_bytes), 4)


def slot_hash(parts: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = np.uint64((FIRST_SEED * (level + 1)) & (2**64 - 1))
        h = (parts[:, 0] ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29)) ^ parts[:, 1]) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(32)) ^ parts[:, 2 + level % 2]
    return (h % np.uint64(size)).astype(np.int64)


def build_hash(digest_bytes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and the marked places of all levels in a row.

    On each level the digests that fall on a place alone mark it; the others go to the next level.
    A digest's slot is the number of marks before its own, so n digests get the slots 0 to n - 1.
    """
    left, sizes, marks, level = words(digest_bytes), [], [], 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        place = slot_hash(left, level, size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        marks.append(alone)
        left = left[~alone[place]]
        level += 1
    return sizes, np.concatenate(marks) if marks else np.zeros(0, bool)


def find_slots(digest_bytes: np.ndarray, sizes: list[int], marks: np.ndarray) -> np.ndarray:
    """The slot of each digest; -1 where no level has a mark for it. Strangers may get a slot."""
    slots = np.full(len(digest_bytes), -1, np.int64)
    parts, open_, before, ranks = words(digest_bytes), np.arange(len(digest_bytes)), 0, np.cumsum(marks) - 1
    for level, size in enumerate(sizes):
        if not len(open_):
            break
        at = before + slot_hash(parts[open_], level, size)
        hit = marks[at]
        slots[open_[hit]] = ranks[at[hit]]
        open_, before = open_[~hit], before + size
    return slots


def as_rows(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, DIGEST_BYTES)


def one_list(values: pa.ChunkedArray, order: np.ndarray) -> pa.Array:
    """The values in this order, as one list; ids stay whole numbers also beside a null."""
    values = values.combine_chunks().take(pa.array(order))
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def build_bucket(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
    """One bucket of the index; rows: distinct digests with their winners."""
    known = as_rows(rows["digest"])
    sizes, marks = build_hash(known)
    order = np.argsort(find_slots(known, sizes, marks))
    return pa.table(
        {
            "bucket": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "marks": pa.array([np.packbits(marks).tobytes()]), "digests": pa.array([known[order].tobytes()]),
            "ids": one_list(rows["win_id"], order), "chars": one_list(rows["win_chars"], order),
            "counts": one_list(rows["n"], order),
        }
    )


def look_up(key: tuple[pa.Scalar], asked: pa.Table, index: pa.Table) -> pa.Table:
    """Distinct digests of one bucket against its index; a slot counts only if its bytes agree."""
    n = len(asked)
    member, at = np.zeros(n, bool), np.zeros(n, np.int64)
    old = [pa.nulls(n, pa.int64())] * 3
    if n and len(index):
        sizes = index["sizes"][0].as_py()
        marks = np.unpackbits(np.frombuffer(index["marks"][0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
        held = np.frombuffer(index["digests"][0].as_py(), np.uint8).reshape(-1, DIGEST_BYTES)
        wanted = as_rows(asked["digest"])
        at = find_slots(wanted, sizes, marks)
        member = (at >= 0) & (held[np.maximum(at, 0)] == wanted).all(axis=1)
        slot = pa.array(at, mask=~member)
        old = [index[c].combine_chunks().flatten().take(slot) for c in ("ids", "chars", "counts")]
    return pa.table([asked["digest"], pa.array(member), *old], ["digest", "member", "old_id", "old_chars", "old_n"])


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def build_index(distinct: DataFrame, buckets: int) -> DataFrame:
    """The index as rows, one per bucket; ``distinct`` has digest, win_id, win_chars and n."""
    return (
        distinct.withColumn("bucket", bucket_of(buckets))
        .groupBy("bucket")
        .applyInArrow(build_bucket, INDEX_SCHEMA)
    )


def dedup_exact(
    docs: DataFrame,
    history: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, member, chars.

    Texts are equal when they are identical without white space; a null text counts as empty. The
    distinct digests of ``history`` (a table like ``docs``, or the documents themselves if none is
    given) lie in buckets, each with a minimal perfect hash whose slots hold the whole digest and
    the winner: most code points of the text as it is, then the smallest id, null ids last. Every
    digest of ``docs`` is looked up there and compared byte by byte. Members belong to the
    historical winner, and none of them stays unless it is that winner; others are grouped among
    themselves. group_size counts rows of history for members and rows of ``docs`` otherwise, so
    rows that are repeated whole count each time and are kept or dropped alike.

    Rows are folded to one per digest before anything meets in a bucket, so buckets stay near
    ``per_bucket`` digests; only the last join sees all copies, and Spark splits its partitions.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    own = stored(winners(rows), "winners")
    seen = own if history is None else stored(winners(digests(history, id_col, text_col)), "history")
    buckets = groups_for(seen.count(), per_bucket)
    index = build_index(seen, buckets)
    asked = own.select("digest").withColumn("bucket", bucket_of(buckets))
    found = asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look_up, FOUND_SCHEMA)
    decided = (
        own.join(found, "digest")
        .select(
            "digest", "member",
            F.when(F.col("member"), F.col("old_id")).otherwise(F.col("win_id")).alias("keep_id"),
            F.when(F.col("member"), F.col("old_n")).otherwise(F.col("n")).alias("group_size"),
            F.when(F.col("member"), F.col("old_chars")).otherwise(F.col("win_chars")).alias("keep_chars"),
        )
    )
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return rows.join(decided, "digest").select(
        "doc_id", "keep_id", "group_size", stays.alias("kept"), "digest", "member", "chars"
    )
