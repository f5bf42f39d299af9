"""Work that few large files or partitions must not leave to one task."""

import datetime as dt
import glob

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moodtide.operators import pages as page_ops
from moodtide.operators import scorer
from moodtide.schemas import TABLES
from moodtide.session import fresh_dir
from moodtide.sources.tables import Tables
from moodtide.streaming import jobs

T0 = dt.datetime(2024, 1, 30, 23, 0)


@pytest.fixture
def tables(spark):
    return Tables(spark, fresh_dir(spark, "test"))


def test_pages_of_one_file_are_parsed_by_many_tasks(spark, tables, monkeypatch):
    n = F.col("id")
    html = F.concat(F.lit('<div><a data-postid="'), (n + 10_000_000).cast("string"), F.lit('">post</a></div>'))
    pages = spark.range(2_000).select(F.when(n % 500 != 0, n).alias("page_id"), html.alias("html"))
    path = fresh_dir(spark, "pages")
    pages.coalesce(1).write.parquet(path)
    parts, parse = [], page_ops.page_posts

    def watched(dealt, as_of):
        parts.append(dealt.rdd.getNumPartitions())
        return parse(dealt, as_of)

    monkeypatch.setattr(page_ops, "page_posts", watched)
    stream = jobs.file_stream(spark, path, pages.schema, per_batch=1)
    jobs.ingest_stream(stream, tables, T0, f"{tables.root}-checkpoint")
    assert len(parts) == 1 and parts[0] > 1
    assert tuple(jobs.stream_counters(tables).first()) == (2_000, 1_996, 2_000, 2_000)
    assert tables.posts().count() == 2_000


def test_a_large_day_is_written_by_several_tasks(spark, tables):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    filled = {"id": F.col("id"), "source_post_id": F.col("id").cast("string"), "create_time": F.lit(T0).cast("timestamp_ntz")}
    row = [filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["raw_data"].fields]
    rows = spark.range(100_000).select(*row, F.lit(0).alias("seq"))
    spark.conf.set(size, "64k")
    try:
        for number in (0, 1):
            tables.merge("raw_data", rows, "source_post_id", ["post_time", "update_time"], "seq", number)
    finally:
        spark.conf.unset(size)
    assert len(glob.glob(f"{tables.path('raw_data').removeprefix('file://')}/create_date=*/*.parquet")) > 1
    assert tables.posts().count() == tables.posts().select("source_post_id").distinct().count() == 100_000


def test_scored_rows_leave_a_few_at_a_time(spark, monkeypatch):
    """What goes to the workers, on one large Arrow batch: rows are handed on while most are unread."""
    posts = spark.range(1).select("id", F.lit("x").alias("text"))
    taken = []
    for name in ("mapInArrow", "mapInPandas"):
        plain = getattr(type(posts), name)

        def watched(df, infer, schema, plain=plain):
            taken.append(infer)
            return plain(df, infer, schema)

        monkeypatch.setattr(type(posts), name, watched)
    seen = []

    def load():
        def model(texts):
            seen.extend(texts)
            return [[0.0, 1.0, float("nan")]] * len(texts)

        return model

    scorer.score_with_model(posts, load, text="text")
    batch = pa.RecordBatch.from_pydict({"id": list(range(10_000)), "text": ["x"] * 9_999 + [None]})
    pieces = taken[0](iter([batch]))
    first = next(pieces)
    assert first.num_rows == len(seen) < 1_000
    rest = list(pieces)
    assert len(seen) == 10_000 and seen[-1] is None and max(p.num_rows for p in rest) < 1_000
    assert pa.Table.from_batches([first, *rest]).column("id").to_pylist() == list(range(10_000))
    assert first.column("_z2").null_count == first.num_rows


def test_columns_of_all_kinds_pass_the_model(spark):
    """Before, a null among long ids turned them into doubles."""
    kinds = "id long, clean_content string, day date, at timestamp, local timestamp_ntz, n decimal(20,2), parts array<int>, pair struct<a:int,b:string>, raw binary, yes boolean"
    day = dt.date(2024, 1, 30)
    some = (2**60 + 1, "a", day, T0, T0, None, [1, None], (1, "x"), bytearray(b"ab"), True)
    data = [some, (None, None, *[None] * 8), (2**60 + 3, "b c", day, T0, T0, None, [], (None, None), bytearray(), False)]
    posts = spark.createDataFrame(data, kinds).coalesce(1)
    scored = scorer.score_with_model(posts, lambda: lambda texts: [[0.0, 0.0, 9.0]] * len(texts))
    assert scored.columns == [*posts.columns, "sentiment_score", "sentiment_label"]
    key = lambda row: str(row[0])
    assert sorted(map(tuple, scored.select(posts.columns).collect()), key=key) == sorted(map(tuple, posts.collect()), key=key)
    with pytest.raises(Exception, match="logits of shape"):
        scorer.score_with_model(posts, lambda: lambda texts: [[0.0, 1.0]] * len(texts)).collect()
