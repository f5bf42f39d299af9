"""Documents ranked by their terms for each item of a query table, by dense matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodtide.llm.fingerprints import lowered, run_hashes, runs, same_bytes
from moodtide.llm.frames import ascii_lower, stored, text_of
from moodtide.llm.words import IS_WORD, U, flat_bytes, slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A vocabulary of so many distinct terms is looked up in one pass over the texts, and a block of
#: items of so many terms is multiplied at once; one item alone may have more.
VOCABULARY, BLOCK_ITEMS, BLOCK_TERMS = 1 << 20, 256, 1 << 13
TILE_TERMS, TILE_DOCS = 1024, 512
#: The impact of a term is at most 10 ** 9 / 1000; sums of products below 2 ** 53 are exact.
MOST_IMPACT = 10**6
LEAST_NORM = 100 - 25
SUM_LIMIT = (1 << 53) - 1
HITS = "doc_id long, n long, terms array<int>, tfs array<long>"
BEST = "item int, doc_id long, score long"


class Vocabulary:
    """The distinct terms of some items, in the order of their numbers, found in texts by hash and bytes."""

    def __init__(self, terms: list[str]) -> None:
        self.data, offsets = flat_bytes(pa.array(terms, pa.string()))
        self.starts, self.sizes = offsets[:-1], np.diff(offsets)
        hashes = run_hashes(self.data, self.starts, offsets[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(hashes >> U(42)).astype(np.int64)] = True

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the runs are terms, and their numbers."""
        hashes = run_hashes(data, starts, ends)
        runs_, numbers = [], []
        at = np.flatnonzero(self.maybe[(hashes >> U(42)).astype(np.int64)])
        slot = np.searchsorted(self.hashes, hashes[at])
        while len(at):  # again only for runs whose hash several terms share
            inside = slot < len(self.hashes)
            at, slot = at[inside], slot[inside]
            equal = self.hashes[slot] == hashes[at]
            at, slot = at[equal], slot[equal]
            number = self.order[slot]
            sizes = ends[at] - starts[at]
            fits = sizes == self.sizes[number]
            fits[fits] = same_bytes(data, starts[at[fits]], self.data, self.starts[number[fits]], sizes[fits])
            runs_.append(at[fits])
            numbers.append(number[fits])
            at, slot = at[~fits], slot[~fits] + 1
        return np.concatenate(runs_ or [at]), np.concatenate(numbers or [at])


def find_terms(rows: DataFrame, terms: Broadcast) -> DataFrame:
    """doc_id, n, terms, tfs: the number of all terms of each text, and those of the vocabulary."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for begin, end in slices(texts):
                data, offsets = lowered(texts.slice(begin, end - begin))
                starts, ends = runs(IS_WORD[data], offsets)
                n = np.diff(np.searchsorted(starts, offsets))
                at, number = vocabulary.find(data, starts, ends)
                owner = np.searchsorted(offsets, starts[at], "right") - 1
                pairs, tfs = np.unique(owner * (len(vocabulary.sizes) + 1) + number, return_counts=True)
                owner, number = np.divmod(pairs, len(vocabulary.sizes) + 1)
                bounds = pa.array(np.searchsorted(owner, np.arange(end - begin + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(bounds, pa.array(number.astype(np.int32))),
                     pa.ListArray.from_arrays(bounds, pa.array(tfs.astype(np.int64)))],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return rows.mapInArrow(found, HITS)


class Tile(NamedTuple):
    """Some of a block's terms, and what each is worth to each item (weight times repeats)."""

    terms: np.ndarray
    worth: np.ndarray


def tiles_of(terms: np.ndarray, worth: np.ndarray, most: int = MOST_IMPACT) -> list[Tile]:
    """The block's matrix in tiles, so that no sum of products in a tile reaches 2 ** 53.

    ``worth`` are whole numbers, a row per term. A tile ends after TILE_TERMS rows or before an
    item's column would pass the limit; a number over the limit by itself is dealt to several rows.
    """
    limit = SUM_LIMIT // most
    rows: list[tuple[int, np.ndarray]] = []
    for term, row in zip(terms, worth):
        parts = -(-int(row.max(initial=0)) // limit)
        for part in range(parts):
            share = row // parts
            rows.append((term, row - share * (parts - 1) if part == 0 else share))
    tiles, begin, sums = [], 0, np.zeros(worth.shape[1], np.int64)
    for i, (_, row) in enumerate(rows):
        if i - begin == TILE_TERMS or (sums + row > limit).any():
            tiles.append(rows[begin:i])
            begin, sums = i, np.zeros(worth.shape[1], np.int64)
        sums = sums + row
    tiles.append(rows[begin:])
    return [Tile(np.array([t for t, _ in tile]), np.array([r for _, r in tile], np.float64)) for tile in tiles if tile]


class Best:
    """The rows of highest score per item, equal scores by ascending id, null last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.least = np.ones(items, np.int64)  # what a score must reach to count
        self.rows = [np.zeros(0, np.int64)] * 4  # item, score, id, whether the id is null

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """``scores`` has a row per document; ties with the last one kept come along until the cut."""
        least = self.least
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        doc, item = np.nonzero(scores >= least)
        if not len(doc):
            return
        new = [item, scores[doc, item], ids[doc], no_id[doc]]
        item, score, doc_id, none = (np.concatenate([a, b]) for a, b in zip(self.rows, new))
        order = np.lexsort((doc_id, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, item, place = order[place < self.k], item[place < self.k], place[place < self.k]
        self.rows = [item, score[order], doc_id[order], none[order]]
        last = place == self.k - 1
        self.least[item[last]] = self.rows[1][last]


def best_documents(hits: DataFrame, block: Broadcast, docs: int, words: int, k: int) -> DataFrame:
    """item, doc_id, score: each task's best ``k`` documents for each item of the block."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, worth = block.value
        tiles = tiles_of(terms, worth)
        best = Best(worth.shape[1], k)
        for batch in batches:
            id_column, n, found, tfs = batch.columns
            no_id = np.asarray(id_column.is_null())
            ids = id_column.fill_null(0).to_numpy()
            norms = np.array([LEAST_NORM + 25 * length * docs // max(words, 1) for length in n.to_pylist()], np.int64)
            bounds = found.offsets.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
            number = found.values.to_numpy()[bounds[0] : bounds[-1]]
            tf = tfs.values.to_numpy()[bounds[0] : bounds[-1]].astype(np.int64)
            impact = (10**9 * tf // (1000 * tf + 12 * norms[owner])).astype(np.float64)
            bounds = bounds - bounds[0]
            for begin in range(0, len(ids), TILE_DOCS):
                end = min(begin + TILE_DOCS, len(ids))
                mine = slice(bounds[begin], bounds[end])
                scores = np.zeros((end - begin, worth.shape[1]), np.int64)
                for tile in tiles:
                    at = np.searchsorted(tile.terms, number[mine])
                    has = tile.terms[np.minimum(at, len(tile.terms) - 1)] == number[mine]
                    if has.any():
                        dense = np.zeros((end - begin, len(tile.terms)))
                        dense[owner[mine][has] - begin, at[has]] = impact[mine][has]
                        scores += (dense @ tile.worth).astype(np.int64)
                best.add(scores, ids[begin:end], no_id[begin:end])
        item, score, doc_id, none = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(doc_id, pa.int64(), mask=none.astype(bool)), pa.array(score)],
            ["item", "doc_id", "score"],
        )

    return hits.mapInArrow(ranked, BEST)


class Item(NamedTuple):
    item: int
    item_id: int | None
    counts: dict[str, int]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per item with a term: its number, its id, and its terms with their counts."""
    numbered = stored(
        items.select(F.col(id_col).cast("long").alias("item_id"), ascii_lower(text_of(text_col)).alias("text")).withColumn(
            "number", F.monotonically_increasing_id()
        ),
        "items",
    )
    terms = numbered.select("number", "item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    counted = terms.groupBy("number", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    return counted.groupBy("number", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "times"))).alias("counts"))


def parts_of(items: Iterator[Item], most_items: int | None, most_terms: int) -> Iterator[list[Item]]:
    """Items in a row that have at most so many distinct terms together; an item is never cut."""
    part: list[Item] = []
    terms: set[str] = set()
    for item in items:
        if part and (len(part) == most_items or len(terms.union(item.counts)) > most_terms):
            yield part
            part, terms = [], set()
        part.append(item)
        terms.update(item.counts)
    if part:
        yield part


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    vocabulary_terms: int = VOCABULARY,
    block_items: int = BLOCK_ITEMS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    Terms are the runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. With
    N documents that have a term, L terms of all of them, n of the document's own, and df documents
    that hold a term, a term found tf times in a document scores
    floor(1000 ln((2 N + 2) / (2 df + 1))) * (10 ** 9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L,
    once for each time the item has it. Scores are whole numbers; only those above 0 rank, equal
    ones by ascending doc_id, null last. Null and empty texts have no terms, items without terms no
    rows. Every row is a document, and every row of ``items`` an item, also where ids repeat.

    The items go to the tasks in parts: one pass over the texts finds the terms of a part's
    vocabulary, whose counts are written, and one pass over the counts multiplies each block of
    items. Each part is taken back before the next; nothing larger than a part is on the driver.
    Each task hands on ``k`` rows an item.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    context, found, totals = docs.sparkSession.sparkContext, [], None
    wanted = (Item(i, r["item_id"], r["counts"]) for i, r in enumerate(item_terms(items, item_id, item_text).toLocalIterator()))
    for part in parts_of(wanted, None, vocabulary_terms):
        terms = sorted(set().union(*(item.counts for item in part)))
        shared = context.broadcast(terms)
        hits = stored(find_terms(rows, shared), "hits")
        shared.destroy()
        if totals is None:
            totals = hits.agg(F.sum("n").alias("words"), F.sum((F.col("n") > 0).cast("long")).alias("docs")).first()
        n_docs, n_words = totals["docs"] or 0, totals["words"] or 0
        df = np.zeros(len(terms), np.int64)
        for row in hits.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[row["t"]] = row["count"]
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        number = {term: i for i, term in enumerate(terms)}
        for block in parts_of(iter(part), block_items, block_terms):
            mine = np.array(sorted({number[t] for item in block for t in item.counts}))
            worth = np.zeros((len(mine), len(block)), np.int64)
            for j, item in enumerate(block):
                for term, times in item.counts.items():
                    worth[np.searchsorted(mine, number[term]), j] = times * weight[number[term]]
            held = df[mine] > 0  # the others add nothing
            shared = context.broadcast((mine[held], worth[held]))
            best = stored(best_documents(hits, shared, n_docs, n_words, k), "best")
            shared.destroy()
            names = docs.sparkSession.createDataFrame([(j, it.item, it.item_id) for j, it in enumerate(block)], "item int, number long, item_id long")
            found.append(best.join(F.broadcast(names), "item").drop("item"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    in_order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
