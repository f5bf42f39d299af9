"""What Python and its buffers hold at once does not grow with the length of the rows."""

import tracemalloc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from small_tables import DOCS
from moodtide.llm import decontaminate, language, minhash, tokens
from moodtide.session import BATCH_LIMIT

CHARS = 100_000


def largest_batch(spark):
    @F.arrow_udf("long")
    def sizes(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([part.nbytes] * len(part), pa.int64())

    texts = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), CHARS).alias("t"), "id")
    return texts.select(sizes(F.concat("t", F.col("id").cast("string"))).alias("n")).agg(F.max("n")).first()[0]


OPERATORS = {
    "language": lambda docs, items: language.identify(docs),
    "near": lambda docs, items: minhash.near_duplicates(docs),
    "leaks": lambda docs, items: decontaminate.without_leaks(docs, items),
    "tokens": lambda docs, items: tokens.Tokenizer(docs.sparkSession),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_batches_of_long_rows_are_bounded(spark, name):
    docs = spark.createDataFrame([(i, f"one text {i}", "en", "s", "x", "y", 1) for i in range(3)], DOCS)
    items = spark.createDataFrame([(1, "an item of some six words")], "item_id long, text string")
    before = spark.conf.get(BATCH_LIMIT, None)
    try:
        spark.conf.unset(BATCH_LIMIT)
        OPERATORS[name](docs, items)
        assert largest_batch(spark) < 6_000_000  # of 20 MB
        spark.conf.set(BATCH_LIMIT, "1000000")
        OPERATORS[name](docs, items)
        assert largest_batch(spark) < 1_500_000  # a limit of the session's own holds
    finally:
        spark.conf.set(BATCH_LIMIT, before) if before else spark.conf.unset(BATCH_LIMIT)


def test_grams_of_a_large_batch_are_held_in_parts(monkeypatch):
    draw = np.random.default_rng(3)
    texts = pa.array(["".join(map(chr, draw.integers(97, 123, 2000))) for _ in range(1000)])
    model = language.Model(["a", "b"], draw.random((language.DIMS, 2)), np.zeros(2))
    tracemalloc.start()
    got = model.predict(texts)
    grams = sum(len(at) for at, _ in language.counts_of(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35_000_000, peak
    monkeypatch.setattr(language, "GRAM_BYTES", 1 << 30)
    assert got.equals(model.predict(texts))
    assert grams == sum(len(at) for at, _ in language.counts_of(texts))


def test_a_text_is_wholly_like_itself_in_a_block():
    cells = [np.arange(a, b, dtype=np.uint64) for a, b in ((0, 30), (10, 40), (90, 95))]
    got = minhash.similarities(cells, np.array([0, 2]), np.array([0, 1, 2]))
    assert got.tolist() == [[1.0, 0.5, 0.0], [0.0, 0.0, 1.0]]
