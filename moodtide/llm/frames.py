"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.session import fresh_dir

#: The white space that keys are stripped of: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again: survives lost executors."""
    path = fresh_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of single bytes take the short way."""
    single = F.octet_length(text) == F.char_length(text)
    return F.when(single, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def groups_for(rows: int, per_group: int) -> int:
    """How many hash groups hold about ``per_group`` rows each."""
    return max(1, -(-rows // per_group))


def text_key(text: Column, *names: str) -> list[Column]:
    """Two hashes of 64 bits each, which together stand for the text."""
    first, second = names or ("k1", "k2")
    return [F.xxhash64(F.lit(1), text).alias(first), F.xxhash64(F.lit(2), text).alias(second)]


#: Bits of the bitmap (1 MB) that keeps rows out of a shuffle.
MARK_BITS = 1 << 23


def marked(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` and, without a shuffle of them, ``marked``: true where the key is in ``wanted``, and for some others.

    The keys set hashed places of a bitmap of MARK_BITS bits, which is all that is broadcast.
    """
    place = F.pmod(F.xxhash64(key), F.lit(MARK_BITS))
    marks = (
        wanted.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("mark_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("marks"))
    )
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("marks", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    near = rows.withColumn("mark_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "mark_bucket", "left")
    hit = F.coalesce(F.call_function("bit_get", byte, (at % 8).cast("int")) == 1, F.lit(False))
    return near.withColumn("marked", hit).drop("mark_bucket", "marks")


def numbered(rows: DataFrame) -> DataFrame:
    """The rows, written, each as ``row`` with a ``number`` of its own."""
    return stored(rows.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The numbered rows whose number is not in ``gone``; only marked rows are shuffled."""
    flagged = marked(rows, gone, "number")
    open_ = flagged.where("marked").join(gone.select("number"), "number", "left_anti")
    return flagged.where("NOT marked").unionByName(open_.select(flagged.columns)).select("row.*")
