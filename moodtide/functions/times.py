"""Zone-free time expressions. ``as_of`` always stands in for the current time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodtide.fixed_values import (
    HISTORY_TIME_FORMAT,
    HOUR_LABEL_FORMAT,
    SPACES,
    VISIBLE_TIME_PATTERN,
)

_SPACE = f"[{SPACES}]"
_CLOCK = f"{_SPACE}+\\d{{1,2}}:\\d{{1,2}}"
_FULL_DASH = f"^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}{_CLOCK}(:[0-5]?\\d)?\\z"
_FULL_SLASH = f"^\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}{_CLOCK}\\z"
_SHORT = f"^\\d{{1,2}}[-/]\\d{{1,2}}{_CLOCK}\\z"


def ntz(moment: dt.datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def floor_hour(moment: Column) -> Column:
    """Start of the hour without a trip through the session time zone."""
    return moment - F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(moment), F.extract(F.lit("SECOND"), moment)
    )


def hour_label(moment: Column) -> Column:
    return F.date_format(moment, HOUR_LABEL_FORMAT)


def history_label(moment: Column) -> Column:
    return F.date_format(moment, HISTORY_TIME_FORMAT)


def visible_time(text: Column) -> Column:
    """First date-and-time in free text, null when there is none."""
    found = F.regexp_extract(text, VISIBLE_TIME_PATTERN.replace("\\s", _SPACE), 1)
    return F.nullif(found, F.lit(""))


def parse_post_time(text: Column, as_of: Column) -> Column:
    """Five accepted shapes, else ``as_of``.

    ``Y-m-d H:M[:S]``, ``Y/m/d H:M``; without a year the year of ``as_of`` is taken, but
    29 February is refused there, since a bare month and day is checked against a
    non-leap year.
    """
    trimmed = F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+\\z", "")
    part = F.split(trimmed, f"[-/:{SPACES}]+")

    def number(position: int) -> Column:
        return F.try_element_at(part, F.lit(position)).try_cast("int")

    full = F.try_make_timestamp_ntz(
        number(1),
        number(2),
        number(3),
        number(4),
        number(5),
        F.coalesce(number(6), F.lit(0)).cast("decimal(16,6)"),
    )
    short = F.when(
        ~((number(1) == 2) & (number(2) == 29)),
        F.try_make_timestamp_ntz(
            F.year(as_of),
            number(1),
            number(2),
            number(3),
            number(4),
            F.lit(0).cast("decimal(16,6)"),
        ),
    )
    return F.coalesce(
        F.when(trimmed.rlike(_FULL_DASH) | trimmed.rlike(_FULL_SLASH), full).when(
            trimmed.rlike(_SHORT), short
        ),
        as_of,
    )
