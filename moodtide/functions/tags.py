"""Product tags: JSON text to an array of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tags_array(tags: Column) -> Column:
    """A list as it is, an object's values, anything else empty."""
    return F.coalesce(
        F.from_json(tags, "array<string>"),
        F.map_values(F.from_json(tags, "map<string,string>")),
        F.array().cast("array<string>"),
    )


def tags_array_lenient(tags: Column) -> Column:
    """As above, but a non-empty JSON string becomes a one-element list."""
    is_text = F.ltrim(tags).startswith('"')
    plain = F.get(
        F.from_json(F.concat(F.lit("["), tags, F.lit("]")), "array<string>"), F.lit(0)
    )
    return F.when(is_text & (plain != ""), F.array(plain)).otherwise(tags_array(tags))
