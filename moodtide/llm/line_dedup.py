"""Lines that many documents share are dropped (column functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.llm.frames import SPACES, ascii_lower, text_of


def line_keys(text: Column, min_chars: int) -> Column:
    """Per line its key as two hashes; null where the key is shorter than ``min_chars``."""

    def key(line: Column) -> Column:
        shown = F.btrim(line, F.lit(SPACES))
        hashes = F.struct(
            F.xxhash64(F.lit(1), shown).alias("h1"), F.xxhash64(F.lit(2), shown).alias("h2")
        )
        return F.when(F.char_length(shown) >= min_chars, hashes)

    return F.transform(F.split(ascii_lower(text), "\n"), key)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents.

    Lines end at ``\\n``; a null or empty text is one empty line. A key is the line without white
    space at both ends, A-Z in lower case; keys under ``min_chars`` code points always stay.
    Documents are told apart by their id: rows that share one count once for each key. Rows without
    an id are told apart by their text, so those of equal texts count once. Every row loses its lines. One row per input row: doc_id, n_lines, n_dropped, kept_text. An empty table gives no rows.

    Only hashes of lines move. They are dealt by document and key first, so a line that all documents
    share is spread, and counts combine before they are dealt by key. The join that finds the
    places of shared lines is a plain sort-merge join, whose large partitions Spark splits. Texts meet
    the places of their lines in a hash join: only the places, numbers of lines, are held, and texts
    pass by without being sorted.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    keyed = rows.select(
        "doc_id", F.xxhash64("text").alias("t"), line_keys(F.col("text"), min_chars).alias("keys")
    )
    unnamed = F.when(F.col("doc_id").isNull(), F.col("t")).alias("unnamed")
    shared = (
        keyed.select("doc_id", unnamed, F.explode(F.array_distinct("keys")).alias("key"))
        .where("key IS NOT NULL")
        .distinct()
        .groupBy("key.h1", "key.h2")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2")
    )
    places = (
        keyed.select("doc_id", "t", F.posexplode("keys").alias("pos", "key"))
        .where("key IS NOT NULL")
        .select("doc_id", "t", "pos", "key.h1", "key.h2")
        .join(shared, ["h1", "h2"], "left_semi")
        .groupBy(F.col("doc_id").alias("hit_id"), F.col("t").alias("hit_t"))
        .agg(F.collect_set("pos").alias("dropped"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_t"))
    lines = F.split("text", "\n")
    # positions that stay, in order: by hashing, and the text is split once, so long texts with many
    # lines stay linear
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    once = F.array(F.struct(lines.alias("lines"), kept.alias("kept")))
    joined = F.transform(once, lambda t: F.array_join(F.transform(t["kept"], lambda i: F.get(t["lines"], i)), "\n"))
    return (
        rows.join(places.hint("shuffle_hash"), same, "left")
        .select(
            "doc_id",
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.col("text"))
            .otherwise(F.get(joined, F.lit(0)))
            .alias("kept_text"),
        )
    )
