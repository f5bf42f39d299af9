"""Near-duplicates by DartMinHash signatures, banded joins and an exact check of each link.

The bands are joined in rounds, and classes found in one round give no more pairs in the next. What
still shares a key across classes is compared in blocks, all of a block at once, by a product of
matrices over the texts' cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.llm.components import components
from moodtide.llm.frames import marked, stored
from moodtide.llm.words import FACTORS, MULTIPLIER, U, mix, sequence_keys, shingles_of, slices, words_of
from moodtide.session import bounded_batches

WORDS = 5
BANDS = 32
ROWS = 6
EMPTY = np.iinfo(np.uint64).max
#: Darts per coordinate beyond ln(coordinates): about one text in fifty has to throw again.
SPARE = 4.0
#: Bands joined in the first round; most of a large class comes together in it.
FIRST_BANDS = 4
#: Texts and words of one side of a block in which all are compared.
BLOCK_TEXTS, BLOCK_WORDS = 512, 1 << 21
TILE_CELLS = 4096
CELLS_AT_ONCE = 64
SKETCH = "struct<k1:long,k2:long,n_words:long,bands:array<long>>"
SKETCH_TYPE = pa.struct(
    [("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("bands", pa.list_(pa.int64()))]
)


def cells_of(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all unit cells of all texts, and the text of each.

    A shingle that occurs w times in a text is an element of weight w, whose region is cut into w
    cells of width 1; so the weighted similarity of two texts is the share of cells in common.
    """
    shingles, owner = shingles_of(words, offsets, size)
    with np.errstate(over="ignore"):
        keys = mix(shingles + owner.astype(U) * U(MULTIPLIER))
        order = np.argsort(keys)
        keys, shingles, owner = keys[order], shingles[order], owner[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(first)
        copy = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
        return mix(shingles + copy.astype(U) * FACTORS[20]), owner


def throw_darts(cells: np.ndarray, owner: np.ndarray, texts: int, k: int) -> np.ndarray:
    """A signature of ``k`` coordinates per text (rows of zero cells stay EMPTY).

    Over each cell stands an endless strip in which darts fall as a Poisson process of rate 1, fixed
    by the cell's hash alone. A text takes the darts below a height at which about
    k (ln k + SPARE) of them are expected; each dart belongs to a hashed coordinate, and the lowest
    per coordinate is kept. Texts with a coordinate left empty throw again to twice the height: the
    lower darts are the same, so signatures do not depend on the height. Two texts agree in a
    coordinate with the probability of their weighted Jaccard similarity.
    """
    signature = np.full((texts, k), EMPTY, U)
    height = k * (math.log(k) + SPARE) / np.maximum(np.bincount(owner, minlength=texts), 1)
    todo_cells, todo_owner = cells, owner
    while len(todo_cells):
        live, who, dart_no = todo_cells, todo_owner, 0
        at = np.zeros(len(live))
        flat = signature.reshape(-1)
        while len(live):
            with np.errstate(over="ignore"):
                draw = mix(live + U((dart_no * MULTIPLIER) & EMPTY))
            at = at - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            below = at < height[who]
            live, who, at, draw = live[below], who[below], at[below], draw[below]
            dart = mix(draw ^ FACTORS[21])
            coordinate = ((dart & U(0xFFFFFFFF)) * U(k) >> U(32)).astype(np.int64)
            value = (at.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (dart >> U(32))
            np.minimum.at(flat, who * k + coordinate, value)
            dart_no += 1
        again = (signature == EMPTY).any(axis=1)
        chosen = again[todo_owner]
        todo_cells, todo_owner = todo_cells[chosen], todo_owner[chosen]
        height = height * 2
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = signature.reshape(len(signature), bands, rows) * FACTORS[:rows]
        return mix(parts.sum(axis=2, dtype=U) + np.arange(bands, dtype=U) * U(MULTIPLIER)).view(np.int64)


def lists(numbers: np.ndarray) -> pa.Array:
    """The rows of a matrix as Arrow lists."""
    ends = np.arange(len(numbers) + 1) * numbers.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers.reshape(-1)))


def sketch_batch(texts: pa.Array, size: int, bands: int, rows: int) -> pa.Array:
    found = [pa.array([], SKETCH_TYPE)]
    for begin, end in slices(texts):
        words, offsets = words_of(texts.slice(begin, end - begin))
        cells, owner = cells_of(words, offsets, size)
        signature = throw_darts(cells, owner, end - begin, bands * rows)
        k1, k2 = sequence_keys(words, offsets)
        columns = [
            pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(offsets).astype(np.int64)),
            lists(band_keys(signature, bands, rows)),
        ]
        found.append(pa.StructArray.from_arrays(columns, fields=list(SKETCH_TYPE)))
    return pa.concat_arrays(found)


def sketch(text: Column, size: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> Column:
    @F.arrow_udf(SKETCH)
    def sketched(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield sketch_batch(part, size, bands, rows)

    return sketched(text)


def cell_sets(text: Column, size: int = WORDS) -> Column:
    """The sorted cells of a text as bytes."""

    @F.arrow_udf("binary")
    def sets(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            found: list[bytes] = []
            for begin, end in slices(part):
                for at in range(begin, end, CELLS_AT_ONCE):
                    n = min(CELLS_AT_ONCE, end - at)
                    cells, owner = cells_of(*words_of(part.slice(at, n)), size)
                    order = np.lexsort((cells, owner))
                    ends = np.cumsum(np.bincount(owner, minlength=n))
                    found += [x.tobytes() for x in np.split(cells[order], ends[:-1])]
            yield pa.array(found, pa.binary())

    return sets(text)


def similarity(a: Column, b: Column) -> Column:
    """Cells in common over all cells of two sorted sets."""

    @F.arrow_udf("double")
    def similar(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in parts:
            out = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(x) + len(y)
                merged = np.sort(np.concatenate([x, y]))
                common = int((merged[1:] == merged[:-1]).sum())
                out.append(common / (both - common) if both else 1.0)
            yield pa.array(out, pa.float64())

    return similar(a, b)


def sets_of(wanted: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """node and cells of every text in ``wanted`` (node); texts: node, text."""
    # no left_semi: the optimizer would move it below the bitmap, and all texts would be shuffled
    found = marked(texts, wanted, "node").where("marked").join(wanted, "node").dropDuplicates(["node"])
    return stored(found.select("node", cell_sets(F.col("text"), size).alias("cells")), "cells")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least ``least`` similar."""
    return stored(
        pairs.join(sets.select(F.col("node").alias("a"), F.col("cells").alias("cells_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("cells").alias("cells_b")), "b")
        .where(similarity(F.col("cells_a"), F.col("cells_b")) >= least)
        .select("a", "b"),
        "links",
    )


def similarities(cells: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The similarity of each text of ``left`` to each of ``right``, which number the texts of ``cells``."""
    sizes = np.array([len(c) for c in cells])
    _, number, count = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(cells)), sizes)
    several = count[number] > 1  # what one text alone has is common to no two
    number, owner = (np.cumsum(count > 1) - 1)[number[several]], owner[several]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    common = np.zeros((len(left), len(right)))
    for tile in range(0, int(number[-1]) + 1 if len(number) else 0, TILE_CELLS):
        here = slice(*np.searchsorted(number, [tile, tile + TILE_CELLS]))
        holds = np.zeros((len(cells), TILE_CELLS), np.float32)
        holds[owner[here], number[here] - tile] = 1
        common += holds[left] @ holds[right].T
    common = np.where(left[:, None] == right[None, :], sizes[left][:, None], common)
    return common / (sizes[left][:, None] + sizes[right][None, :] - common)


def block_links(least: float):
    """A function of one block (node, class_id, stray, inside, cells) that gives links between its classes."""

    def compare(block: pa.Table) -> pa.Table:
        _, at, text = np.unique(block["node"].to_numpy(), return_index=True, return_inverse=True)
        node, classes = block["node"].to_numpy()[at], block["class_id"].to_numpy()[at]
        cells = [np.frombuffer(block["cells"][int(i)].as_buffer(), U) for i in at]
        left, right = (np.unique(text[block[c].to_numpy(zero_copy_only=False)]) for c in ("stray", "inside"))
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            near = similarities(cells, left, right) >= least
            near &= classes[left][:, None] != classes[right][None, :]
            above: dict[int, int] = {}

            def top(c: int) -> int:
                while c in above:
                    c = above[c]
                return c

            for i, j in zip(*np.nonzero(near)):
                a, b = top(int(classes[left[i]])), top(int(classes[right[j]]))
                if a != b:  # one link joins two classes, more of them say nothing new
                    above[max(a, b)] = min(a, b)
                    links.append((int(node[left[i]]), int(node[right[j]])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return compare


def with_class(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return members.withColumn("class_id", F.col("node"))
    return members.join(classes, "node", "left").withColumn("class_id", F.coalesce("class_id", "node"))


def centre_pairs(members: DataFrame) -> DataFrame:
    """Each node of a key with the key's centre, where their classes differ: at most one pair a node and key.

    The centre is of the class with the most nodes of the key, and drawn by a hash of key and node,
    so a class has different ones under its keys.
    """
    drawn = F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node"))
    of_class = members.groupBy("key", "class_id").agg(F.count(F.lit(1)).alias("n"), drawn.alias("c"))
    most = F.max_by(F.struct(F.col("c.node").alias("centre"), F.col("class_id").alias("home")), F.struct("n", "c.h"))
    centres = of_class.groupBy("key").agg(most.alias("c")).select("key", "c.centre", "c.home")
    apart = members.join(centres, "key").where("class_id <> home")
    return stored(apart.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "pairs")


def links_across(members: DataFrame, sets: DataFrame, least: float, block_texts: int, block_words: int) -> DataFrame:
    """Links between classes that still share a key: members have key, node, words and class_id.

    In each key the class with the most nodes is at home, and each node of another class, a stray, is
    compared with all nodes of the key that are not of its class. Strays and nodes are dealt to
    blocks by hash, and every block of strays meets every block of nodes; a block gives as many
    links as join its classes, however many pairs of it are near.
    """
    of_class = members.groupBy("key", "class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    of_key = of_class.groupBy("key").agg(
        F.max(F.struct("n", "class_id")).alias("most"), F.max_by("words", F.struct("n", "class_id")).alias("home_words"),
        F.sum("n").alias("n"), F.sum("words").alias("words"),
    )

    def blocks(n: Column, words: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / block_texts), F.ceil(words / block_words)).cast("long")

    keys = of_key.where("most.n < n").select(
        "key", F.col("most.class_id").alias("home"), blocks(F.col("n"), F.col("words")).alias("rights"),
        blocks(F.col("n") - F.col("most.n"), F.col("words") - F.col("home_words")).alias("lefts"),
    )
    mixed = stored(members.join(keys, "key").withColumn("h", F.abs(F.xxhash64("node", "key") % (1 << 30))), "mixed")
    strays = mixed.where("class_id <> home").select(
        "key", "node", "class_id", (F.col("h") % F.col("lefts")).alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1)).alias("j"), F.lit(True).alias("stray"), F.lit(False).alias("inside"),
    )
    inside = mixed.select(
        "key", "node", "class_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)).alias("i"),
        (F.col("h") % F.col("rights")).alias("j"), F.lit(False).alias("stray"), F.lit(True).alias("inside"),
    )
    dealt = strays.unionByName(inside).join(sets, "node")
    return stored(dealt.groupBy("key", "i", "j").applyInArrow(block_links(least), "a long, b long"), "links")


def joined(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes with those together that ``links`` join."""
    if classes is None:
        return components(links)
    return components(classes.select(F.col("node").alias("a"), F.col("class_id").alias("b")).unionByName(links))


def near_duplicates(
    docs: DataFrame,
    least: float = 0.8,
    size: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_texts: int = BLOCK_TEXTS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, kept.

    Texts are compared by the weighted Jaccard similarity of their runs of ``size`` words, in lower
    case and without punctuation; a text of fewer words is one run. Classes are the components of
    the links of at least ``least``; class_id is the smallest doc_id of the class, whose document
    is the one kept. Texts of the same words are one node from the start, however many there are.
    Documents without words (null, empty or signs only) are classes of their own, and rows without
    an id have no class and are kept. Rows that share an id are one document. n_links counts the
    checked links of the document's words to other words.

    Each node has a key per band. In two rounds over the bands every node is compared with the
    centre of each of its keys, unless they are of one class by then. Nodes that share a key but are
    still of different classes are compared in blocks, exactly and all with all, so what has the same key is never
    passed over; a large class has few of them, as most of it comes together in the first round.
    """
    bounded_batches(docs.sparkSession)
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = stored(
        rows_in.select("doc_id", sketch(F.col("text"), size, bands, rows).alias("s")).select("doc_id", "s.*"), "sketches"
    )
    nodes = stored(
        sketches.where("n_words > 0 AND doc_id IS NOT NULL")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_words").alias("words")),
        "nodes",
    )
    keyed = nodes.select("node", "words", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keyed.join(shared, "key"), "members")
    sets = sets_of(members.select("node").distinct(), rows_in.select(F.col("doc_id").alias("node"), "text"), size)

    classes, links = None, None
    for first, last in ((0, FIRST_BANDS), (FIRST_BANDS, bands)):
        here = with_class(members.where((F.col("band") >= first) & (F.col("band") < last)), classes)
        found = verified(centre_pairs(here), sets, least)
        classes = joined(classes, found)
        links = found if links is None else links.unionByName(found)
    # of two nodes alone under a key one was the centre
    found = links_across(with_class(members.where("n > 2"), classes), sets, least, block_texts, block_words)
    if not found.isEmpty():
        classes = joined(classes, found)
        links = links.unionByName(found.distinct())

    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    node_class = stored(
        nodes.select("k1", "k2", "node")
        .join(classes, "node", "left")
        .join(degrees, "node", "left")
        .select("k1", "k2", F.coalesce("class_id", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "classes",
    )
    with_words = F.col("n_words") > 0
    out = stored(
        sketches.select("doc_id", "k1", "k2", "n_words")
        .join(node_class, ["k1", "k2"], "left")
        .select(
            "doc_id",
            F.when(with_words & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
            F.when(with_words & F.col("doc_id").isNotNull(), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        ),
        "documents",
    )
    sizes = out.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return out.join(sizes, "class_id", "left").select(
        "doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), "n_links",
        F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"),
    )
