"""Class probabilities to a score in [0, 1] and a label.

The number of classes is a property of the model, known when the plan is built, so all of
this is plain arithmetic inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodtide.fixed_values import (
    LABEL_NEGATIVE,
    LABEL_NEUTRAL,
    LABEL_POSITIVE,
    NEGATIVE_WORDS,
    NEUTRAL_WORDS,
    POSITIVE_WORDS,
    SPACES,
)

DEFAULT_LABELS = {0: LABEL_NEGATIVE, 1: LABEL_NEUTRAL, 2: LABEL_POSITIVE}


def softmax(logits: list[Column]) -> list[Column]:
    peak = F.greatest(*logits) if len(logits) > 1 else logits[0]
    powers = [F.exp(logit - peak) for logit in logits]
    total = reduce(add, powers)
    return [power / total for power in powers]


def polarised_score(p_positive: Column, p_negative: Column) -> Column:
    """0.5 when both are even; the square root pushes small leads away from the middle."""
    lead = p_positive - p_negative
    score = F.lit(0.5) + F.lit(0.5) * F.signum(lead) * F.sqrt(F.abs(lead))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def predicted_label(
    probabilities: list[Column], labels: dict[int, str] | None = None
) -> Column:
    """Label of the likeliest class, the first one on ties."""
    labels = DEFAULT_LABELS if labels is None else labels
    peak = F.greatest(*probabilities) if len(probabilities) > 1 else probabilities[0]
    choice = F.when(F.lit(False), F.lit(LABEL_NEUTRAL))
    for index, probability in enumerate(probabilities):
        choice = choice.when(
            probability == peak, F.lit(labels.get(index, LABEL_NEUTRAL))
        )
    return choice.otherwise(F.lit(LABEL_NEUTRAL))


def normalised_label(raw_label: Column) -> Column:
    """Trimmed, lower case, without ``_`` and ``-``; null becomes empty."""
    trimmed = F.regexp_replace(F.coalesce(raw_label, F.lit("")), f"^[{SPACES}]+|[{SPACES}]+\\z", "")
    return F.translate(F.lower(trimmed), "_-", "")


def label_from_words(raw_label: Column) -> Column:
    """The class a label's own wording names; null when it names none."""
    name = normalised_label(raw_label)

    def holds_any(words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [name.contains(word) for word in words])

    return (
        F.when(holds_any(POSITIVE_WORDS), F.lit(LABEL_POSITIVE))
        .when(holds_any(NEUTRAL_WORDS), F.lit(LABEL_NEUTRAL))
        .when(holds_any(NEGATIVE_WORDS), F.lit(LABEL_NEGATIVE))
    )


def lexicon_logits(
    text: Column, positive: list[str], negative: list[str]
) -> list[Column]:
    """Word counts as logits (negative, neutral, positive), over the whole text.

    A deterministic stand-in for a trained model where none is installed.
    """
    words = F.split(F.lower(text), "[ \\r\\n\\t]+")

    def hits(lexicon: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*lexicon))).cast("double")

    return [hits(negative), F.lit(1.0), hits(positive)]
