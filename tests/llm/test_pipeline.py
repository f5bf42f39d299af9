"""The pipeline against a plain version on a small table, and its stages on awkward ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from small_tables import DOCS, awkward
from test_llm_operators import WORD, plain_classes, plain_tiles
from moodtide.llm import language, tokens

SMALL = "/root/testdata/sf0.001"


def plain_pipeline(spark):
    """Ids and token counts that should come out, row by row and pair by pair."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = {r["doc_id"] for r in language.identify(docs).where("score >= 0.3").collect()}
    left = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] in known), key=lambda x: (-len(x[1]), x[0]))
    best = {}
    for i, text in left:
        best.setdefault(text.translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))), (i, text))
    left = sorted(best.values())
    classes = plain_classes([t for _, t in left])
    left = [x for at, x in enumerate(left) if classes[at] == at]
    items = [WORD.findall(r["text"].lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def leaks(text):
        words = WORD.findall(text.lower())
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        return any(
            plain_tiles(words, item, 5) >= 0.6 * len(item)
            for item in items if any(tuple(item[i : i + 5]) in runs for i in range(len(item) - 4))
        )

    encoding, _ = tokens.Tokenizer(spark).load()
    return {i: len(encoding.encode_ordinary(t)) for i, t in left if not leaks(t)}


def test_pipeline_against_plain_version(spark):
    got = corpus_pipeline.run(spark, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == plain_pipeline(spark)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_awkward_and_empty_tables(spark, name, stage):
    rows = awkward(spark)
    out = stage(spark, rows, SMALL)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert out.count() <= rows.count() or last
    assert last or out.columns == rows.columns
    assert stage(spark, rows.limit(0), SMALL).count() == 0


def test_repeated_rows_leave_one(spark):
    rows = awkward(spark)
    out = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, rows, SMALL)
    assert sorted(r["doc_id"] or 0 for r in out.collect()).count(4) == 1


def test_texts_without_an_id_or_with_a_shared_one_stay(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [
        (None, "first text of its own"), (None, "second text, quite different"), (None, "third one has no like"),
        (None, "first  text of its own"), (5, "one text under five"), (5, "another text under five"),
        (6, long), (None, long.upper()), (None, "one text under five"), (8, f"begin {long}"), (8, "what eight says too"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", "x", "y", 1) for i, t in rows], DOCS)
    exact = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, SMALL)
    want = [*rows[1:8], *rows[9:]]
    assert sorted((str(r["doc_id"]), r["text"]) for r in exact.collect()) == sorted((str(i), t) for i, t in want)
    near = dict(corpus_pipeline.STAGES)["near_dedup"](spark, exact, SMALL)
    assert near.columns == docs.columns
    want = [*rows[1:7], rows[10]]
    assert sorted((str(r["doc_id"]), r["text"]) for r in near.collect()) == sorted((str(i), t) for i, t in want)
