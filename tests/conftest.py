import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from moodtide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def evaluate(spark):
    """Values of ``expression(column)`` over the given inputs, in their order."""

    def run(expression, values, kind="string"):
        from pyspark.sql import functions as F

        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {kind}")
        out = df.select("i", expression(F.col("v")).alias("out")).collect()
        return [row["out"] for row in sorted(out, key=lambda row: row["i"])]

    return run
