"""Sentiment of cleaned posts: by word lists inside the JVM, or by a model in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodtide.functions.sentiment import (
    DEFAULT_LABELS,
    lexicon_logits,
    polarised_score,
    predicted_label,
    softmax,
)
from moodtide.operators.labels import Classes

# texts of one batch -> one list of logits per text
Model = Callable[[list[str]], list[list[float]]]

MODEL_BATCH = 16
#: Model batches whose texts are Python strings at one time, whatever an Arrow batch holds.
BATCHES_AT_ONCE = 8


def with_sentiment(
    df: DataFrame,
    logits: list,
    positive: int = 2,
    negative: int = 0,
    labels: dict[int, str] | None = None,
) -> DataFrame:
    """Add ``sentiment_score`` and ``sentiment_label`` from one logit column per class."""
    named = {f"_p{i}": p for i, p in enumerate(softmax(logits))}
    with_p = df.withColumns(named)
    p = [F.col(name) for name in named]
    return with_p.withColumns(
        {
            "sentiment_score": polarised_score(p[positive], p[negative]),
            "sentiment_label": predicted_label(p, labels or DEFAULT_LABELS),
        }
    ).drop(*named)


def score_with_lexicon(
    posts: DataFrame, positive: list[str], negative: list[str], text: str = "clean_content"
) -> DataFrame:
    named = {f"_z{i}": z for i, z in enumerate(lexicon_logits(F.col(text), positive, negative))}
    counted = posts.withColumns(named)
    return with_sentiment(counted, [F.col(name) for name in named]).drop(*named)


def score_with_model(
    posts: DataFrame,
    load: Callable[[], Model],
    classes: int | Classes = 3,
    positive: int = 2,
    negative: int = 0,
    labels: dict[int, str] | None = None,
    text: str = "clean_content",
    batch_size: int = MODEL_BATCH,
) -> DataFrame:
    """Score with a model loaded once per task; it only turns texts into logits.

    The model gets whole texts; if it reads only so many tokens of each, that is its own contract.
    ``classes`` is a number of outputs or, with their meaning, the ``Classes`` of its labels. Every other column of a row travels with it, so results need no join back.
    Rows stay in Arrow and go back a few model batches at a time, so a worker holds one Arrow batch and
    few texts as strings, however many rows come.
    """
    if isinstance(classes, Classes):
        positive, negative, labels = classes.positive, classes.negative, classes.labels
        classes = classes.count
    names = [f"_z{i}" for i in range(classes)]
    schema = T.StructType(
        [*posts.schema.fields, *[T.StructField(name, T.DoubleType()) for name in names]]
    )

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            for begin in range(0, batch.num_rows, batch_size * BATCHES_AT_ONCE):
                rows = batch.slice(begin, batch_size * BATCHES_AT_ONCE)
                texts = rows.column(text).to_pylist()
                logits = [
                    row
                    for start in range(0, len(texts), batch_size)
                    for row in model(texts[start : start + batch_size])
                ]
                outputs = np.array(logits, dtype=float)
                if outputs.shape != (len(texts), classes):
                    raise ValueError(f"logits of shape {outputs.shape} for {len(texts)} texts and {classes} classes")
                columns = [pa.array(z, pa.float64(), from_pandas=True) for z in outputs.T]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], [*rows.schema.names, *names])

    inferred = posts.mapInArrow(infer, schema)
    return with_sentiment(inferred, [F.col(n) for n in names], positive, negative, labels).drop(
        *names
    )


