"""Text cleaning."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodtide.fixed_values import CLEANING_STEPS

# A text without any of these is not changed by the steps that take something out.
REMOVAL_MARKS = ["<", "http", "$"]


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(
        lambda done, step: F.regexp_replace(done, F.lit(step[0]), F.lit(step[1])), steps, text
    )


def clean_text(content: Column, max_chars: int | None = None) -> Column:
    """Markup, links and ticker spans out; white space folded; trimmed; cut only if asked to.

    Plain substring tests skip the patterns that cannot match, which is most of the cost on
    ordinary posts. They read ``content`` itself and one intermediate result, so even where
    subexpressions are not shared (a pushed-down filter) no more than that one is computed
    twice.
    """
    *removals, line_breaks, space_runs = CLEANING_STEPS
    marked = reduce(or_, [F.contains(content, F.lit(mark)) for mark in REMOVAL_MARKS])
    bare = F.when(marked, _replaced(content, removals)).otherwise(content)
    one_line = _replaced(bare, [line_breaks])
    folded = F.when(
        F.contains(one_line, F.lit("  ")), _replaced(one_line, [space_runs])
    ).otherwise(one_line)
    whole = F.trim(folded)
    return whole if max_chars is None else F.substring(whole, 1, max_chars)
