"""Phrases whose words keep company, from Rabin-Karp fingerprints of all runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodtide.llm.fingerprints import lowered, run_hashes, runs, same_bytes
from moodtide.llm.frames import groups_for, stored, text_of
from moodtide.llm.words import FACTORS, MULTIPLIER, U, flat_bytes, mix, powers, slices

LONGEST = 4
SLICE = 4 << 20
#: Bits of a sieve, 8 MB: all that is broadcast, whatever the number of frequent runs.
SIEVE_BITS = 26
#: Bits of one chunk of Spark's bitmap aggregate.
CHUNK_BITS = 32768
PER_RANKING = 100_000
UNKNOWN = "und"

BREAK, SPACE, WORD = 0, 1, 2
KIND = np.full(256, WORD, np.uint8)
KIND[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
KIND[list(b" \t")] = SPACE

WORD_BASE = int(FACTORS[11])
WORD_INVERSE = pow(WORD_BASE, -1, 2**64)


class Words:
    """The words of a slice of texts, each with its text's language and its piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        self.data, offsets = lowered(texts)
        kinds = KIND[self.data]
        self.starts, self.ends = runs(kinds == WORD, offsets)
        owner = np.searchsorted(offsets, self.starts, "right") - 1
        self.piece = np.cumsum(kinds == BREAK)[self.starts] + owner if len(self.starts) else owner
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
        data, offsets = flat_bytes(coded.dictionary)
        self.salt = run_hashes(data, offsets[:-1], offsets[1:])
        hashes = run_hashes(self.data, self.starts, self.ends)
        self.sums = np.zeros(len(hashes) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * powers(WORD_BASE, len(hashes)), out=self.sums[1:])
        self.back = powers(WORD_INVERSE, len(hashes))

    def places(self, size: int) -> np.ndarray:
        """The words at which a run of ``size`` words of one piece begins."""
        n = max(0, len(self.starts) - size + 1)
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1 : size - 1 + n])

    def keys(self, places: np.ndarray, size: int) -> np.ndarray:
        """The fingerprint of the run at each place, with its length and language mixed in."""
        with np.errstate(over="ignore"):
            runs_there = (self.sums[places + size] - self.sums[places]) * self.back[places]
            return mix(mix(runs_there + U(size * MULTIPLIER & 2**64 - 1)) ^ self.salt[self.lang[places]])

    def texts(self, places: np.ndarray, size: int) -> list[bytes]:
        """The runs themselves, their words joined by one space."""
        data = self.data.tobytes()
        return [
            b" ".join(data[self.starts[p + i] : self.ends[p + i]] for i in range(size)) for p in places.tolist()
        ]

    def word_numbers(self, places: np.ndarray) -> np.ndarray:
        """Equal numbers for equal words of one language: by hash, and made sure of by the bytes."""
        _, first, number = np.unique(self.keys(places, 1), return_index=True, return_inverse=True)
        like = places[first][number]
        sizes = self.ends[places] - self.starts[places]
        equal = (sizes == self.ends[like] - self.starts[like]) & (self.lang[places] == self.lang[like])
        if equal.all() and same_bytes(self.data, self.starts[places], self.data, self.starts[like], sizes).all():
            return number
        known: dict[tuple, int] = {}  # hashes that meet: count by the words themselves
        named = zip(self.lang[places].tolist(), self.texts(places, 1))
        return np.array([known.setdefault(name, len(known)) for name in named], np.int64)


class Sieve:
    """The fingerprints of one length that are frequent, and some others."""

    def __init__(self, bits: Broadcast) -> None:
        self.bits = np.frombuffer(bits.value, np.uint8)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> U(64 - SIEVE_BITS)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def make_sieve(keys: DataFrame) -> Broadcast:
    """The bitmap of ``key``, made by Spark in chunks; 2 ** SIEVE_BITS bits come to the driver."""
    place = F.shiftrightunsigned("key", 64 - SIEVE_BITS) + 1  # buckets are numbered from 1
    chunks = (
        keys.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("chunk"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )
    bits = np.zeros(1 << SIEVE_BITS - 3, np.uint8)
    for row in chunks.toLocalIterator():
        begin = (row["chunk"] - 1) * CHUNK_BITS // 8
        bits[begin : begin + CHUNK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits.tobytes())


def word_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        for begin, end in slices(texts, SLICE):
            yield Words(langs.slice(begin, end - begin), texts.slice(begin, end - begin))


def run_counts(rows: DataFrame, size: int, shorter: Broadcast | None) -> DataFrame:
    """key, seen: per slice, fingerprints of runs of ``size`` words whose shorter parts are frequent."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(shorter) if shorter else None
        for words in word_slices(batches):
            places = words.places(size)
            if sieve:
                # at the words where runs of one word less begin: whether that run is frequent
                part = np.zeros(len(words.starts) + 1, bool)
                parts = words.places(size - 1)
                part[parts] = sieve.passes(words.keys(parts, size - 1))
                places = places[part[places] & part[places + 1]]
            keys, seen = np.unique(words.keys(places, size), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(seen)], ["key", "seen"])

    return rows.mapInArrow(counted, "key long, seen long")


def phrase_counts(rows: DataFrame, sieves: list[Broadcast]) -> DataFrame:
    """lang, size, phrase, seen: the runs that pass the sieves, by their text; size 0 counts all words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [Sieve(bits) for bits in sieves]
        for words in word_slices(batches):
            total = np.bincount(words.lang, minlength=len(words.langs))
            langs, sizes, phrases, seen = list(words.langs), [0] * len(total), [b""] * len(total), [total]
            number = np.full(len(words.starts) + 1, -1, np.int64)  # of the run that begins at each word
            single = number
            for size, sieve in enumerate(levels, 1):
                places = words.places(size)
                places = places[sieve.passes(words.keys(places, size))]
                if size == 1:
                    same = words.word_numbers(places)
                else:
                    places = places[(number[places] >= 0) & (single[places + size - 1] >= 0)]
                    same = number[places] * (len(words.starts) + 1) + single[places + size - 1]
                _, first, same, count = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
                number = np.full(len(words.starts) + 1, -1, np.int64)
                number[places] = same
                single = number if size == 1 else single
                at = places[first]
                langs += [words.langs[i] for i in words.lang[at].tolist()]
                sizes += [size] * len(at)
                phrases += words.texts(at, size)
                seen.append(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()),
                 pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.concatenate(seen).astype(np.int64))],
                ["lang", "size", "phrase", "seen"],
            )

    return rows.mapInArrow(counted, "lang string, size int, phrase string, seen long")


def frequent_phrases(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, size, phrase, f for all runs of up to ``longest`` words found ``least`` times; size 0: all words.

    Length by length, fingerprints are counted per slice, added up by the shuffle, and those found
    often enough become the next length's sieve: a run can be frequent only if both its parts of one
    word less are. A fingerprint's count is at least that of each of its texts, so nothing frequent
    is lost. In the end the runs that pass are cut out of the texts and counted by text.
    """
    sieves: list[Broadcast] = []
    for size in range(1, longest + 1):
        counts = run_counts(rows, size, sieves[-1] if sieves else None).groupBy("key").agg(F.sum("seen").alias("f"))
        sieves.append(make_sieve(stored(counts.where(F.col("f") >= least).select("key"), f"runs{size}")))
    counts = phrase_counts(rows, sieves).groupBy("lang", "size", "phrase").agg(F.sum("seen").alias("f"))
    found = stored(counts.where((F.col("f") >= least) | (F.col("size") == 0)), "phrases")
    for bits in sieves:
        bits.destroy()
    return found


def words_from(phrase: Column, first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, size, phrase, a, l, r, score of all runs of two or more words, by their lowest-scoring cut."""
    cuts = phrases.where("size > 1").select(
        "lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).withColumn("first", words_from(F.col("phrase"), 1, F.col("k"))).withColumn(
        "rest", words_from(F.col("phrase"), F.col("k") + 1, F.col("size"))
    )
    known = phrases.where("size > 0")
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    by_cut = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("twice", exact).withColumn(
        "score", F.expr("twice div cast(l + r AS decimal(20,0))")
    )
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return by_cut.groupBy("lang", "size", "phrase", "a").agg(lowest).select(
        "lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def without_parts(candidates: DataFrame, share: int) -> DataFrame:
    """The candidates that do not lie in a longer one found at least ``share`` % as often."""
    longer = candidates.where("size > 2")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: words_from(F.col("phrase"), i, n)),
        )
    )
    holders = longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("held")).groupBy(
        "lang", "phrase"
    ).agg(F.max("held").alias("held"))
    held = F.coalesce(100 * F.col("held") >= share * F.col("a"), F.lit(False))
    return candidates.join(holders, ["lang", "phrase"], "left").where(~held).drop("held")


def collocations(
    docs: DataFrame,
    least: int = 30,
    longest: int = LONGEST,
    share: int = 80,
    first: int = 2000,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The strongest phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts with A-Z in lower case are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words
    ``[^\\x20\\x09]+``. All counts are per language, a null one being ``und``: n of all words, a of
    the phrase, l and r of its two parts where it is cut. A phrase of 2 to ``longest`` words found
    ``least`` times or more scores floor(2000000 a / (l + r)) at its lowest-scoring cut, the first
    one if equal. It goes when a longer one that has it inside is found at least ``share`` % as
    often. The ``first`` of each language stay, by score and a (greatest first) and phrase (bytes).

    A null or empty text has no words, every row counts (repeated rows each time), and a table
    without a frequent phrase gives no rows. Only fingerprints and counts are shuffled, those of a
    slice of texts at once; every step is written, and sieves of a fixed size are broadcast. One
    text must fit into a task's memory several times.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of(text_col).alias("text"))
    phrases = frequent_phrases(rows, least, longest)
    candidates = stored(scored(phrases), "candidates")
    left = stored(without_parts(candidates, share), "collocations")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # ranked in hashed parts first, so that a language with most of the phrases is not one task
    parts = groups_for(left.count(), PER_RANKING)
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts)).alias("part")
    best = left.select("*", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = best.where(F.col("place") <= first).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    totals = phrases.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= first).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
