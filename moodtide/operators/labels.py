"""Which output of a model means what."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.fixed_values import LABEL_NEGATIVE, LABEL_NEUTRAL, LABEL_POSITIVE
from moodtide.functions.sentiment import label_from_words


def label_mapping(labels: DataFrame) -> DataFrame:
    """(model_id, num_labels, label_index, raw_label) to a class per index, and one index
    per class and model.

    Wording decides first, the usual order (negative, neutral, positive) fills what it
    leaves open. A model's rows are its few outputs.
    """
    named = labels.withColumn("_named", label_from_words(F.col("raw_label")))
    model = W.partitionBy("model_id")

    def first_index(label: str):
        return F.min(F.when(F.col("_named") == label, F.col("label_index"))).over(model)

    n, i = F.col("num_labels"), F.col("label_index")
    usual = (
        F.when((n >= 3) & (i == 0), F.lit(LABEL_NEGATIVE))
        .when((n >= 3) & (i == 1), F.lit(LABEL_NEUTRAL))
        .when((n >= 3) & (i == 2), F.lit(LABEL_POSITIVE))
        .when((n == 2) & (i == 0), F.lit(LABEL_NEGATIVE))
        .when((n == 2) & (i == 1), F.lit(LABEL_POSITIVE))
        .otherwise(F.lit(LABEL_NEUTRAL))
    )
    negative = F.coalesce(first_index(LABEL_NEGATIVE), F.lit(0))
    positive = F.coalesce(
        first_index(LABEL_POSITIVE), F.when(n >= 3, 2).when(n == 2, 1).otherwise(0)
    )
    neutral = F.coalesce(
        first_index(LABEL_NEUTRAL), F.when(n >= 3, 1).when(n == 2, negative).otherwise(0)
    )
    return named.select(
        "model_id",
        "label_index",
        F.coalesce("_named", usual).alias("label"),
        positive.alias("positive_index"),
        neutral.alias("neutral_index"),
        negative.alias("negative_index"),
    )


@dataclass(frozen=True)
class Classes:
    """What the outputs of one model mean: how many, which is positive and negative, their labels."""

    count: int
    positive: int
    negative: int
    labels: dict[int, str]


def classes_of(labels: DataFrame, model_id: int) -> Classes:
    """The classes of one model, by the wording of its labels. A model has a few outputs."""
    outputs = label_mapping(labels.where(F.col("model_id") == model_id)).orderBy("label_index").collect()
    if not outputs:
        raise ValueError(f"no labels of model {model_id}")
    first = outputs[0]
    return Classes(
        len(outputs),
        first["positive_index"],
        first["negative_index"],
        {row["label_index"]: row["label"] for row in outputs},
    )
