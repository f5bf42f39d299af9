"""Post-id rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodtide.fixed_values import POST_ID_MAX_DIGITS, POST_ID_MIN_DIGITS


def is_valid_post_id(post_id: Column) -> Column:
    """The whole string is 8 to 11 ASCII digits (``\\z``: no trailing newline either)."""
    return post_id.rlike(f"^[0-9]{{{POST_ID_MIN_DIGITS},{POST_ID_MAX_DIGITS}}}\\z")


def is_dirty_post_id(post_id: Column) -> Column:
    """Too short, too long (in bytes) or holding a non-digit."""
    size = F.octet_length(post_id)
    return (
        (size < POST_ID_MIN_DIGITS)
        | (size > POST_ID_MAX_DIGITS)
        | post_id.rlike("[^0-9]")
    )


def post_id_from_href(href: Column) -> Column:
    """The last path or comma segment of 8 or more digits; null when there is none."""
    stem = F.regexp_replace(href, "[.html]+\\z", "")
    long_numbers = F.filter(
        F.split(stem, "[,/]"), lambda part: part.rlike("^[0-9]{8,}\\z")
    )
    return F.try_element_at(long_numbers, F.lit(-1))
