"""Benchmark passages in documents, found by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.llm.words import BASE, INVERSE, U, powers, slices, windows, within, words_of
from moodtide.session import bounded_batches

SEED_WORDS = 5
COVERAGE = 0.6
BLOCK_WORDS = 1_000_000
FILTER_BITS = 22
FOUND = "array<struct<item_id:long,covered:int,n_words:int,tiles:int,coverage:double>>"
FOUND_TYPE = pa.list_(
    pa.struct(
        [("item_id", pa.int64()), ("covered", pa.int32()), ("n_words", pa.int32()), ("tiles", pa.int32()),
         ("coverage", pa.float64())]
    )
)


class Free:
    """Words of a text, or of an item, that no tile has marked, and hashes of runs of them."""

    def __init__(self, words: np.ndarray, places: np.ndarray) -> None:
        self.places = places  # the words that can be part of a tile at all, in order
        self.last = np.ones(len(places), bool)  # whether the next of them does not follow at once
        self.last[:-1] = np.diff(places) != 1
        self.marked = np.zeros(len(places), bool)
        self.sums = np.zeros(len(places) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(words[places] * powers(BASE, len(places)), out=self.sums[1:])
        self.back = powers(INVERSE, len(places))
        self.measure()

    def measure(self) -> None:
        """How many free words in a row there are from each word on."""
        n = len(self.places)
        ends = self.last | self.marked
        ends[:-1] |= self.marked[1:]
        end = np.minimum.accumulate(np.where(ends, np.arange(n), n)[::-1])[::-1]
        self.run = np.where(self.marked, 0, end + 1 - np.arange(n))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of ``length`` free words begin, and the hash of each, rolled on from sums."""
        at = np.flatnonzero(self.run >= length)
        with np.errstate(over="ignore"):
            return at, (self.sums[at + length] - self.sums[at]) * self.back[at]


def longest_match(text: Free, item: Free, size: int, most: int) -> int:
    """The length of the longest free match of ``size`` to ``most`` words, 0 if there is none."""

    def matches(length: int) -> bool:
        return bool(np.isin(item.windows(length)[1], text.windows(length)[1]).any())

    most = min(most, int(text.run.max(initial=0)), int(item.run.max(initial=0)))
    if most < size or not matches(size):
        return 0
    if matches(most):
        return most
    while most - size > 1:  # a match of ``size`` words exists, none of ``most``
        middle = (size + most) // 2
        size, most = (middle, most) if matches(middle) else (size, middle)
    return size


def tile(text: np.ndarray, item: np.ndarray, size: int, seeds: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the text, place in the item, words) of at least ``size`` words.

    The longest matches free of marked words are marked first, equal ones in the order of their
    places; then what is left is searched again, until nothing of ``size`` words is free. The length
    is found by halving, with hashes of all free runs of one length at a time, so the work is that
    of the words times the number of different lengths, however often words repeat. ``seeds`` are the
    places of the text where a run of ``size`` words of the item begins; all, if not given.
    """
    places = np.arange(len(text))
    if seeds is not None:
        places = np.unique((seeds[:, None] + np.arange(size)).ravel())
    here, there = Free(text, places), Free(item, np.arange(len(item)))
    tiles: list[tuple[int, int, int]] = []
    length = len(item)
    while length := longest_match(here, there, size, length):
        at, hashes = here.windows(length)
        found, known = there.windows(length)
        order = np.argsort(known, kind="stable")
        known, found = known[order], found[order]
        low, high = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
        hit = high > low
        next_: dict[int, int] = {}  # per hash, the first place of the item that may still be free
        for p, begin, end in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
            # what is marked meanwhile has this length, so it shows at one of the ends
            if here.marked[p] or here.marked[p + length - 1]:
                continue
            k = next_.get(begin, begin)
            while k < end and (there.marked[found[k]] or there.marked[found[k] + length - 1]):
                k += 1
            next_[begin] = k
            if k < end:
                q = int(found[k])
                tiles.append((int(here.places[p]), q, length))
                here.marked[p : p + length] = there.marked[q : q + length] = True
        here.measure()
        there.measure()
        length -= 1
    return tiles


class Items:
    """A block of benchmark items: their seeds, sorted, each with its item and place."""

    def __init__(self, ids: list[int], texts: list[str], size: int) -> None:
        words, offsets = words_of(pa.array(texts, pa.string()))
        self.size, self.ids, self.lengths = size, ids, np.diff(offsets)
        self.words, self.offsets = words, offsets
        places = np.flatnonzero(within(offsets, size))[: max(0, len(words) - size + 1)]
        seeds = windows(words, size)[places]
        owner = np.repeat(np.arange(len(ids)), self.lengths)[places]
        order = np.lexsort((owner, seeds))
        seeds, owner = seeds[order], owner[order]
        first = np.ones(len(seeds), bool)  # a seed that an item repeats finds it once
        first[1:] = (seeds[1:] != seeds[:-1]) | (owner[1:] != owner[:-1])
        self.seeds, self.owner = seeds[first], owner[first]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.seeds >> U(64 - FILTER_BITS)).astype(np.int64)] = True
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []  # words, sorted seeds, item of each
        for n in range(1, size):
            of_size = np.flatnonzero(self.lengths == n)
            if len(of_size):
                whole = windows(words, n)[offsets[of_size]]
                order = np.argsort(whole, kind="stable")
                self.short.append((n, whole[order], of_size[order]))

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, places of the text) for every text that shares seeds with an item."""
        hashes = windows(words, self.size)
        maybe = np.flatnonzero(self.filter[(hashes >> U(64 - FILTER_BITS)).astype(np.int64)])
        maybe = maybe[within(offsets, self.size)[maybe]]
        low = np.searchsorted(self.seeds, hashes[maybe], "left")
        n = np.searchsorted(self.seeds, hashes[maybe], "right") - low
        place = np.repeat(maybe, n)
        item = self.owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        text = np.searchsorted(offsets, place, "right") - 1
        order = np.lexsort((place, item, text))
        place, item, text = place[order], item[order], text[order]
        bounds = np.flatnonzero(np.concatenate([[True], (np.diff(item) != 0) | (np.diff(text) != 0), [True]])) if len(place) else []
        for begin, end in zip(bounds[:-1], bounds[1:]):
            yield int(text[begin]), int(item[begin]), place[begin:end] - offsets[text[begin]]

    def short_hits(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) for every item of fewer words than a seed that a text holds as a whole."""
        found: set[tuple[int, int]] = set()
        for n, seeds, item in self.short:
            hashes = windows(words, n)
            at = np.flatnonzero(within(offsets, n)[: len(hashes)] & np.isin(hashes, seeds))
            low, high = np.searchsorted(seeds, hashes[at], "left"), np.searchsorted(seeds, hashes[at], "right")
            for t, i, j in zip(np.searchsorted(offsets, at, "right") - 1, low, high):
                found.update((int(t), int(item[s])) for s in range(i, j))
        yield from sorted(found)

    def find(self, texts: pa.Array, coverage: float) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for begin, end in slices(texts):
            words_in = words_of(texts.slice(begin, end - begin))
            for t, item in self.short_hits(*words_in):
                words = int(self.lengths[item])
                out[begin + t].append(
                    {"item_id": self.ids[item], "covered": words, "n_words": words, "tiles": 1, "coverage": 1.0}
                )
            hashes, offsets = words_in
            for t, item, seeds in self.hits(*words_in):
                own = self.words[self.offsets[item] : self.offsets[item + 1]]
                tiles = tile(hashes[offsets[t] : offsets[t + 1]], own, self.size, seeds)
                covered, words = sum(n for _, _, n in tiles), int(self.lengths[item])
                if covered >= coverage * words:
                    out[begin + t].append(
                        {"item_id": self.ids[item], "covered": covered, "n_words": words,
                         "tiles": len(tiles), "coverage": covered / words}
                    )
        return out


def blocks(benchmark: DataFrame, block_words: int, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks of about ``block_words`` words, read a partition at a time."""
    ids, texts, held = [], [], 0
    known = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    for row in known.where("i IS NOT NULL AND t IS NOT NULL").distinct().toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        # beyond ASCII a character may be a word
        held += row["t"].count(" ") + 1 + len(row["t"].encode()) - len(row["t"])
        if held >= block_words:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def searcher(block: Broadcast, coverage: float, size: int):
    """A function of texts for one block of the benchmark."""

    @F.arrow_udf(FOUND)
    def search(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(*block.value, size)
        for part in parts:
            yield pa.array(items.find(part, coverage), FOUND_TYPE)

    return search


def leaks(
    text: Column,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    size: int = SEED_WORDS,
    block_words: int = BLOCK_WORDS,
    item_id: str = "item_id",
    item_text: str = "text",
) -> Column:
    """The benchmark items that a text covers, as an array of structs, longest cover first by id.

    An item is covered when the greedy tiles of at least ``size`` words, which may come in any order
    in the text, hold at least the share ``coverage`` of its words. Words are as in ``words.py``.
    An item of fewer than ``size`` words is covered by a text that has all of them in a row; an item
    without words, and a null or empty text, have no match.

    The benchmark is a test set: it goes to the tasks in blocks of ``block_words`` words, each a
    broadcast of some 40 bytes a word, and every text meets every block. Nothing is shuffled.
    """
    context = bounded_batches(benchmark.sparkSession).sparkContext
    found = []
    for ids, texts in blocks(benchmark, block_words, item_id, item_text):
        found.append(searcher(context.broadcast((ids, texts)), coverage, size)(text))
    if not found:
        return F.array().cast(FOUND)
    return F.concat(*found) if len(found) > 1 else found[0]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, size: int = SEED_WORDS,
    id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """A row per document and item it covers: doc_id, item_id, covered, n_words, tiles, coverage.

    Repeated rows give repeated results; documents that cover nothing give none.
    """
    found = leaks(F.col(text_col).cast("string"), benchmark, coverage, size, block_words)
    rows = docs.select(F.col(id_col).alias("doc_id"), found.alias("found"))
    return rows.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, size: int = SEED_WORDS, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, as they are, that cover no item."""
    found = leaks(F.col(text_col).cast("string"), benchmark, coverage, size)
    return docs.where(F.size(found) == 0)
