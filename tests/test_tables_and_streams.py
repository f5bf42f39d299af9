import datetime as dt

import pytest
from pyspark.sql import functions as F

from moodtide.operators import profile, scorer, trend
from moodtide.plans import batch
from moodtide.schemas import PAGES, TABLES
from moodtide.session import fresh_dir, shared_dir
from moodtide.sources import key_filters, views
from moodtide.sources.tables import Tables
from moodtide.streaming import jobs

T0 = dt.datetime(2024, 1, 30, 23, 0)
EVENTS = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    return Tables(spark, fresh_dir(spark, "test"))


def by(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_shared_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert named is not None or shared_dir(spark)
    if named:
        assert shared_dir(spark) == named.rstrip("/")


def test_missing_tables_are_empty(tables):
    for name, schema in TABLES.items():
        assert tables.read(name).schema == schema and tables.read(name).count() == 0
    assert tables.posts().count() == 0 and tables.appended("posts_clean").count() == 0


def test_snapshots(spark, tables):
    for n in (1, 2, 3):
        tables.replace("products", spark.range(n))
    assert tables.versions("products") == [1, 2, 3]
    assert tables.read("products").count() == 3
    assert tables.read("products", before=3).count() == 2
    assert tables.expire("products", keep=2) == [1] and tables.versions("products") == [2, 3]


def test_appended_batches_replay(spark, tables):
    row = [(1, "x", T0)]
    for number in (0, 1, 1):
        tables.append("posts_clean", spark.createDataFrame(row, TABLES["posts_clean"]), number)
    assert tables.appended("posts_clean").count() == 2


def landed(spark, *posts):
    data = [
        (int(key), "p", key, "u", "t", text, None, None, None, when, created, when, 0, seq)
        for key, text, when, created, seq in posts
    ]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["raw_data"])
    return spark.createDataFrame(data, schema + ", seq int")


def test_merge_rewrites_only_touched_days(spark, tables):
    day = dt.timedelta(days=1)
    refresh = ["post_time", "update_time"]

    def merge(batch_id, *posts):
        tables.merge("raw_data", landed(spark, *posts), "source_post_id", refresh, "seq", batch_id)

    merge(0, ("11111111", "a", T0, T0, 1), ("22222222", "b", T0, T0 - day, 1), ("33333333", "c", T0, T0 - 2 * day, 1))
    import glob
    import os

    def files():
        found = glob.glob(tables.path("raw_data") + "/create_date=*/*.parquet")
        return {os.path.basename(os.path.dirname(f)): os.path.basename(f) for f in found}

    before = files()
    later = T0 + dt.timedelta(hours=1)
    again = [("11111111", "ignored", later, later, 1), ("44444444", "d", T0, T0, 1)]
    merge(1, *again)
    want = [("11111111", "a", later), ("22222222", "b", T0), ("33333333", "c", T0), ("44444444", "d", T0)]
    assert by(tables.posts().select("source_post_id", "content", "post_time"), "source_post_id") == want
    after = files()
    same = {d for d in before if before[d] == after[d]}
    assert same == {"create_date=2024-01-28", "create_date=2024-01-29"}
    merge(2, ("55555555", "e", T0, T0, 1))
    merge(1, *again)  # a replay of what is done must not bring the older state back
    want.append(("55555555", "e", T0))
    assert by(tables.posts().select("source_post_id", "content", "post_time"), "source_post_id") == want


def test_sentiment_merges_by_id_range(spark, tables):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["user_sentiment"])
    refresh = ["user_id", "clean_content", "sentiment_score", "sentiment_label", "analyze_time"]

    def merge(batch_id, *scored):
        data = [(i, i, "u", "t", score, "x", T0, seq) for i, score, seq in scored]
        rows = spark.createDataFrame(data, schema + ", seq int")
        tables.merge("user_sentiment", rows, "raw_data_id", refresh, "seq", batch_id)

    merge(0, (1, 0.1, 1), (20_000_000, 0.2, 1))
    merge(1, (1, 0.8, 1), (1, 0.9, 2), (2, 0.3, 1))
    got = by(tables.stored("user_sentiment").select("raw_data_id", "sentiment_score"), "raw_data_id")
    assert got == [(1, 0.9), (2, 0.3), (20_000_000, 0.2)]


def test_old_days_are_dropped(spark, tables):
    day = dt.timedelta(days=1)
    posts = landed(spark, *[(f"1111111{i}", "x", T0, T0 - i * day, 1) for i in (0, 15, 16)])
    tables.merge("raw_data", posts, "source_post_id", ["post_time", "update_time"], "seq", 0)
    assert batch.prune(tables, T0) == 1
    assert tables.posts().count() == 2
    # the cutoff falls inside a day
    assert batch.prune(tables, T0 + dt.timedelta(seconds=1)) == 1
    assert batch.prune(tables, T0 + dt.timedelta(seconds=1)) == 0
    assert tables.posts().count() == 1


def test_a_batch_can_be_run_again(spark, tables):
    one = spark.createDataFrame([(0, "u", page((10000001, "ann", "good", "2024-01-30 10:00")))], PAGES)
    batch.run(tables, one, scorer_by_words, T0, 0)
    for _ in range(2):
        batch.clean(tables, T0, 0)
        batch.score(tables, scorer_by_words, T0, 0)
    assert tables.appended("posts_clean").count() == tables.appended("posts_scored").count() == 1
    assert tables.stored("user_sentiment").count() == 1


def scorer_by_words(df):
    return scorer.score_with_lexicon(df, ["good"], ["bad"])


def page(*posts):
    return "".join(
        f'<div><a data-postid="{i}">{text}</a><i class="l4">{user}</i><i class="l5">{time}</i></div>'
        for i, user, text, time in posts
    )


def test_whole_round(spark, tables):
    def pages(*htmls):
        return spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], PAGES)

    first = pages(
        page((10000001, "ann", "good good", "2024-01-30 10:00"), (10000002, "ann", "bad $X$", "2024-01-30 11:00")),
        page((10000003, "bob", "&lt;b&gt;", "2024-01-30 12:00"), (10000001, "ann", "good good", "2024-01-30 10:05")),
    )
    assert batch.run(tables, first, scorer_by_words, T0, 0)["upsert_rows"] == 4
    assert tables.posts().count() == 3
    sentiment = by(tables.stored("user_sentiment").select("raw_data_id", "clean_content", "sentiment_label"), "raw_data_id")
    # post 3 cleans to nothing and stays behind; one hit ties with the neutral logit
    assert sentiment == [(10000001, "good good", "乐观"), (10000002, "bad", "悲观")]
    assert [r[0] for r in by(tables.read("risk_profile"), "user_id")] == ["ann"]
    assert by(tables.posts().where("id = 10000001").select("post_time"), "post_time")[0][0] == dt.datetime(2024, 1, 30, 10, 5)

    second = pages(page((10000004, "bob", "good", "2024-01-30 13:00"), (10000005, "bob", "bad", "2024-01-30 13:00")))
    batch.run(tables, second, scorer_by_words, T0 + dt.timedelta(hours=1), 1)
    assert tables.stored("user_sentiment").count() == 4
    assert [r[0] for r in by(tables.read("risk_profile"), "user_id")] == ["ann", "bob"]

    # the same round once more, under its number
    again = batch.run(tables, second, scorer_by_words, T0 + dt.timedelta(hours=1), 1)
    assert again["upsert_rows"] == 2 and tables.stored("user_sentiment").count() == 4

    # nothing new: a third round changes no answer
    before = by(tables.read("risk_profile").drop("update_time"), "user_id")
    batch.run(tables, second, scorer_by_words, T0 + dt.timedelta(hours=2), 2)
    assert tables.stored("user_sentiment").count() == 4
    assert by(tables.read("risk_profile").drop("update_time"), "user_id") == before


def test_catalog_reload(spark, tables):
    products = views.catalog(spark, EVENTS)
    assert batch.reload_catalog(tables, products) == batch.reload_catalog(tables, products) == 200


def stream_of(spark, df, order, files):
    path = fresh_dir(spark, "landed")
    df.repartitionByRange(files, order).write.parquet(path)
    return lambda: jobs.file_stream(spark, path, df.schema, per_batch=1)


def stream_in_order(spark, df, order, files):
    """As above, with the files landing one after the other in the order of ``order``."""
    path = fresh_dir(spark, "landed")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // files)
    for start in range(0, len(rows), size):
        part = spark.createDataFrame(rows[start : start + size], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return lambda: jobs.file_stream(spark, path, df.schema, per_batch=1)


def test_hourly_stream_equals_batch_on_closed_hours(spark):
    posts = views.posts(spark, EVENTS)
    for files in (1, 4):
        out = fresh_dir(spark, "hourly")
        jobs.run_to_files(jobs.hourly_stream(stream_in_order(spark, posts, "post_time", files)()), out)
        got = {r["hour"]: r for r in spark.read.parquet(out).collect()}
        want = {r["hour"]: r for r in trend.hourly_sentiment(posts, digits=None).collect()}
        last = max(r["post_time"] for r in posts.where("sentiment_score is not null").select("post_time").collect())
        closed = {h for h in want if h + dt.timedelta(hours=1) <= last - dt.timedelta(hours=1)}
        assert set(got) == closed
        assert all(got[h]["avg_score"] == pytest.approx(want[h]["avg_score"]) for h in closed)


def test_late_rows_are_dropped_by_the_watermark(spark):
    hour = dt.timedelta(hours=1)
    # late rows are judged by the watermark of the batch before, hence the batch in between
    times = [T0, T0 + 5 * hour, T0 + 5 * hour, T0, T0 + 9 * hour]
    data = [(i, t, 0.5) for i, t in enumerate(times)]
    df = spark.createDataFrame(data, "id long, post_time timestamp_ntz, sentiment_score double")
    out = fresh_dir(spark, "late")
    jobs.run_to_files(jobs.hourly_stream(stream_in_order(spark, df, "id", 5)()), out)
    got = {r["hour"]: r["posts"] for r in spark.read.parquet(out).collect()}
    assert got == {T0: 1, T0 + 5 * hour: 2}


def test_dedup_stream_across_batches(spark):
    data = [(1, "a", T0), (2, "b", T0), (3, "a", T0 + dt.timedelta(days=1)), (4, "c", T0)]
    df = spark.createDataFrame(data, "id long, source_post_id string, post_time timestamp_ntz")
    out = fresh_dir(spark, "dedup")
    jobs.run_to_files(jobs.dedup_stream(stream_in_order(spark, df, "id", 4)()), out)
    assert [r[1] for r in by(spark.read.parquet(out), "source_post_id")] == ["a", "b", "c"]


def test_dedup_stream_keeps_backfilled_posts(spark):
    days = [dt.timedelta(days=n) for n in (0, 60, 61, -90, 0, 200)]
    data = [(i, key, T0 + at) for i, (key, at) in enumerate(zip("abcdae", days))]
    df = spark.createDataFrame(data, "id long, source_post_id string, post_time timestamp_ntz")
    out = fresh_dir(spark, "dedup")
    stream = jobs.dedup_stream(stream_in_order(spark, df, "id", 6)())
    assert stream.schema == df.schema
    jobs.run_to_files(stream, out)
    assert [tuple(r) for r in by(spark.read.parquet(out), "id")] == [data[i] for i in (0, 1, 2, 3, 5)]


def test_profile_stream_in_batches_and_replayed(spark, tables):
    posts = views.posts(spark, EVENTS)
    jobs.profile_stream(stream_of(spark, posts, "id", 3)(), tables, fresh_dir(spark, "cp"))
    got = by(jobs.profiles_from_stats(tables.read("user_stats", schema=jobs.STATS)), "user_id")
    want = by(profile.risk_profiles(posts), "user_id")
    assert [(g[0], g[3], g[4]) for g in got] == [(w[0], w[3], w[4]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)
    # a stream that starts over writes the same versions again
    jobs.profile_stream(stream_of(spark, posts, "id", 3)(), tables, fresh_dir(spark, "cp"))
    again = by(jobs.profiles_from_stats(tables.read("user_stats", schema=jobs.STATS)), "user_id")
    assert [a[3] for a in again] == [g[3] for g in got]


def test_merge_stats_with_nothing(spark):
    posts = views.posts(spark, EVENTS)
    stats = jobs.score_stats(posts)
    merged = jobs.merge_stats(spark.createDataFrame([], jobs.STATS), stats)
    assert by(merged, "user_id") == by(stats.select("user_id", "n", "mean", "m2"), "user_id")


def test_a_pruned_post_starts_over(spark, tables):
    def crawl(text, when, number):
        one = spark.createDataFrame([(0, "u", page((10000001, "ann", text, "2024-01-30 10:00")))], PAGES)
        return batch.run(tables, one, scorer_by_words, when, number)

    crawl("good good", T0, 0)
    later = T0 + dt.timedelta(days=20)
    assert batch.prune(tables, later) == 1
    assert tables.posts().count() == tables.appended("posts_clean").count() == tables.appended("posts_scored").count() == 0
    crawl("now bad bad", later, 1)
    assert [r["clean_content"] for r in tables.appended("posts_clean").collect()] == ["now bad bad"]
    assert [r["clean_content"] for r in tables.stored("user_sentiment").collect()] == ["now bad bad"]


def test_key_filters_miss_no_key_and_few_strangers(spark):
    stored = spark.range(60_000).select(
        F.concat(F.lit("9"), F.col("id") * 2).alias("k"), F.pmod("id", F.lit(3)).alias("day")
    ).unionByName(spark.createDataFrame([(None, 1)], "k string, day long"))
    filters = key_filters.key_filters(stored, "k", "day")
    assert filters.count() == 9  # 20,000 keys a day, three blocks each
    for day in (0, 1, 2):
        own = stored.where(F.col("day") == day)
        assert day in {r["day"] for r in key_filters.may_hold(filters, own, "k", "day").collect()}
    ranges = filters.select("day", "low", "high", "blocks").distinct().count()
    assert ranges == 3

    def met(keys):
        alone = keys.withColumn("n", F.monotonically_increasing_id())
        return sum(
            key_filters.may_hold(filters, alone.where(F.pmod("n", F.lit(50)) == i), "k", "day").count() for i in range(2)
        )

    assert met(spark.range(100).select(F.concat(F.lit("9"), F.col("id") * 2 + 1).alias("k"))) <= 2
    assert met(spark.createDataFrame([(None,), ("1",), ("8" * 20,)], "k string")) == 0


def test_all_stored_keys_are_found_one_by_one(spark):
    stored = spark.range(3_000).select((F.col("id") * 7).alias("k"), F.lit(0).alias("day"))
    filters = key_filters.key_filters(stored, "k", "day")
    bits = [key_filters._is_set(name, key_filters._position("k", i)) for i, name in enumerate(key_filters.BITMAPS)]
    asked = stored.select("k").crossJoin(filters.drop("day"))
    assert asked.where(bits[0] & bits[1] & bits[2] & bits[3]).count() == 3_000


def test_merge_opens_only_days_that_may_hold_a_key(spark, tables):
    day = dt.timedelta(days=1)
    refresh = ["post_time", "update_time"]

    def merge(batch_id, posts):
        tables.merge("raw_data", posts, "source_post_id", refresh, "seq", batch_id)

    for i in range(4):
        merge(i, landed(spark, *[(str(10_000_000 + 100 * i + n), "x", T0, T0 + i * day, 0) for n in range(50)]))
    first = landed(spark, ("10000007", "again", T0 + day, T0 + 30 * day, 0))
    assert tables.may_hold("raw_data", first, "source_post_id") == [T0.date()]
    unknown = landed(spark, ("10000075", "x", T0, T0, 0), ("99", "x", T0, T0, 0))
    assert tables.may_hold("raw_data", unknown, "source_post_id") == []
    merge(4, first)  # a month later
    assert tables.posts().count() == 200
    assert tables.posts().where("source_post_id = '10000007'").first()["post_time"] == T0 + day
    tables._delete(f"{tables.path('raw_data')}-keys")  # a table of before the filters
    merge(5, landed(spark, ("10000107", "again", T0 + day, T0 + 31 * day, 0)))
    assert tables.posts().count() == 200
    assert len(tables._children(f"{tables.path('raw_data')}-keys", "create_date=")) == 4


def test_counters_of_a_replayed_stream(spark, tables):
    as_of = dt.datetime(2024, 5, 5)
    pages = views.list_pages(spark, "/root/testdata/sf0.01").where("page_id % 25 = 0")
    path = fresh_dir(spark, "pages")
    pages.repartition(2).write.parquet(path)

    def run(name):
        stream = jobs.file_stream(spark, path, pages.schema, per_batch=1)
        jobs.ingest_stream(stream, tables, as_of, f"{tables.root}-{name}")
        return tuple(jobs.stream_counters(tables).first())

    counted = run("a")
    assert counted[0] == pages.count() and counted[2] >= counted[3] == tables.posts().count() > 0
    assert run("b") == counted  # the same batch numbers once more


def test_reloaded_catalogue_has_defaults(spark, tables):
    products = views.catalog(spark, EVENTS).withColumn("sharpe_ratio", F.lit(None).cast("double"))
    batch.reload_catalog(tables, products)
    assert tables.read("products").where("sharpe_ratio = 0.0").count() == products.count()
    cells = tables.read("product_cells", schema="risk_level string")
    assert tables.versions("product_cells") == tables.versions("products")
    assert {r[0] for r in cells.select("risk_level").distinct().collect()} <= {
        r[0] for r in products.select("risk_rating").distinct().collect()
    } and cells.count() > 0
