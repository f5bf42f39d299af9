"""Connected components by alternating stars, with tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.llm.frames import stored


def all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge upward at most, and none that has one is a centre itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("centre"))
    )
    around = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("centre").alias("centre"))
    wrong = (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("centre") == 1))
    return not around.agg(F.max(wrong)).first()[0]


def linked_to_least(edges: DataFrame, upward: bool) -> DataFrame:
    """One star operation: every node hands neighbours over to the least node it knows.

    ``edges`` has u > v. Upward, each node links its greater neighbours; otherwise its smaller ones
    and itself.
    """
    around = edges
    if upward:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if upward:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, class_id for every node of an edge; class_id is the least node of its component.

    Loops and repeated edges do not matter, edges with a null end are left out. ``edges`` should be
    a stored table, as the first round reads it several times; each round writes its own edges to
    the shared folder. They are done when all are stars, one edge per node; then each centre is the
    least node, as edges lead to smaller ones. The driver sees only whether they are.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    )
    done = False
    while not done:
        up = linked_to_least(edges, True).where("u <> v")
        edges = stored(linked_to_least(up, False).where("u <> v").distinct(), "edges")
        done = all_stars(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class_id")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("class_id")).distinct()
    )
