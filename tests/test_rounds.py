"""Chained streams over several landed files, retention that is cut short, and large inputs of helpers."""

import datetime as dt
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from moodtide.functions import page_outline
from moodtide.operators import pages, profile, scorer, trend
from moodtide.plans import batch
from moodtide.session import fresh_dir
from moodtide.sources import views
from moodtide.sources.tables import Tables
from moodtide.streaming import jobs, rounds

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
T0 = dt.datetime(2024, 1, 30, 23, 0)
EVENTS = "/root/testdata/sf0.001"
POSTS = "id long, source_post_id string, user_id string, content string"


@pytest.fixture
def tables(spark):
    return Tables(spark, fresh_dir(spark, "test"))


def words(posts):
    return scorer.score_with_lexicon(posts, ["good"], ["bad"])


def files_of(path):
    return {name: os.path.getmtime(os.path.join(path, name)) for name in os.listdir(path) if name.endswith(".parquet")}


def test_rounds_read_new_files_only(spark):
    landed, cleaned, scored = (fresh_dir(spark, name) for name in ("landed", "cleaned", "scored"))
    schema = spark.createDataFrame([], POSTS).schema

    def land(*rows):
        spark.createDataFrame(rows, POSTS).coalesce(1).write.mode("append").parquet(landed)

    def work(when):
        rounds.clean_landed(spark, jobs.file_stream(spark, landed, schema), cleaned, when)
        return rounds.score_cleaned(spark, cleaned, scored, words, when).orderBy("id").collect()

    long = "good " * 5000
    land((1, "a", "ann", "good <b>x</b>"), (2, "b", "bob", None), (3, "c", "bob", "$X$"))
    assert [(r["id"], r["sentiment_label"]) for r in work(T0)] == [(1, "中立")]
    before = {**files_of(cleaned), **files_of(scored)}
    land((4, "d", "ann", "bad bad"), (5, "a", "ann", "good good: landed again"), (6, "f", "eve", long))
    later = T0 + dt.timedelta(hours=1)
    got = work(later)
    assert [(r["id"], r["user_id"], r["analyze_time"]) for r in got] == [(1, "ann", T0), (4, "ann", later), (6, "eve", later)]
    assert len(got[2]["clean_content"]) == len(long.strip())
    after = {**files_of(cleaned), **files_of(scored)}
    assert before.items() <= after.items()  # nothing of the first round is written again
    assert work(later + dt.timedelta(hours=1)) == got  # nothing new
    # the second round's plan has the new files alone, and no join
    log = sorted(int(n) for n in os.listdir(f"{cleaned}-checkpoint/offsets") if n.isdigit())
    assert log[-1] <= 3
    progress = rounds.clean_stream(jobs.file_stream(spark, landed, schema), T0)
    assert "Join" not in progress._jdf.queryExecution().analyzed().toString()


def test_late_hours_are_kept(spark, tables):
    posts = views.posts(spark, EVENTS).select("id", "post_time", "sentiment_score")
    rows = posts.orderBy(F.hash("id")).collect()
    path, checkpoint = fresh_dir(spark, "landed"), fresh_dir(spark, "cp")
    stream = lambda: jobs.file_stream(spark, path, posts.schema, per_batch=1)
    kept = {}
    for n in range(3):
        part = rows[n::3]
        spark.createDataFrame(part, posts.schema).coalesce(1).write.mode("append").parquet(path)
        rounds.hourly_sums_stream(stream(), tables, checkpoint)
        folders = sorted(os.listdir(tables.path("hourly_sums")))
        assert len(folders) == n + 1
        for name, files in kept.items():
            assert files_of(f"{tables.path('hourly_sums')}/{name}") == files
        kept = {name: files_of(f"{tables.path('hourly_sums')}/{name}") for name in folders}
    got = {r["hour"]: r for r in rounds.hourly_from_sums(tables.appended("hourly_sums")).collect()}
    want = {r["hour"]: r for r in trend.hourly_sentiment(posts, digits=None).collect()}
    assert {h: r["posts"] for h, r in got.items()} == {h: r["posts"] for h, r in want.items()}
    assert all(got[h]["avg_score"] == pytest.approx(want[h]["avg_score"]) for h in want)
    # a stream that starts over writes the same sums under the same numbers
    rounds.hourly_sums_stream(stream(), tables, fresh_dir(spark, "cp"))
    assert sum(r["posts"] for r in tables.appended("hourly_sums").collect()) == sum(r["posts"] for r in want.values())


def test_only_changed_users_are_written(spark, tables):
    schema = "user_id string, sentiment_score double"
    path, checkpoint = fresh_dir(spark, "landed"), fresh_dir(spark, "cp")
    batches = [[("ann", 0.1), ("ann", 0.5), ("bob", 0.3), ("eve", None)], [("bob", 0.9)], [("ann", 0.2), ("dan", 0.7)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        rounds.user_stats_stream(jobs.file_stream(spark, path, spark.createDataFrame([], schema).schema), tables, checkpoint)
    folders = sorted(os.listdir(tables.path("user_stats_changed")))
    changed = [{r["user_id"] for r in spark.read.parquet(f"{tables.path('user_stats_changed')}/{f}").collect()} for f in folders]
    assert changed == [{"ann", "bob"}, {"bob"}, {"ann", "dan"}]
    everything = spark.createDataFrame(sum(batches, []), schema)
    stats = rounds.latest_stats(tables.appended("user_stats_changed"))
    got = {r["user_id"]: r for r in jobs.profiles_from_stats(stats, 1).collect()}
    want = {r["user_id"]: r for r in profile.risk_profiles(everything, 1).collect()}
    assert got.keys() == want.keys()
    for user, row in want.items():
        assert got[user]["post_count"] == row["post_count"]
        assert got[user]["avg_sentiment"] == pytest.approx(row["avg_sentiment"])
        assert got[user]["volatility"] == pytest.approx(row["volatility"])


RAW = "id long, source_post_id string, create_time timestamp_ntz, post_time timestamp_ntz, update_time timestamp_ntz, seq int"


def landed_posts(spark, tables):
    day = dt.timedelta(days=1)
    rows = [(i, f"p{i}", T0 - n * day, T0, T0, 1) for i, n in enumerate((0, 14, 15, 15, 16, 17))]
    rows.append((9, "p9", T0 - 15 * day + dt.timedelta(minutes=30), T0, T0, 1))
    from moodtide.schemas import TABLES

    df = spark.createDataFrame(rows, RAW)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["raw_data"].fields if f.name not in df.columns]
    tables.merge("raw_data", df.select("*", *missing), "source_post_id", ["post_time", "update_time"], "seq", 0)
    stage = spark.createDataFrame([(i, "text", T0) for i in (0, 1, 2, 4, 9)], "id long, clean_content string, update_time timestamp_ntz")
    tables.append("posts_clean", stage, 0)
    tables.append("posts_clean", stage.where("id = 4").withColumn("id", F.lit(5).cast("long")), 1)


class CutShort(Exception):
    pass


@pytest.mark.parametrize("at", range(8))
def test_retention_that_is_cut_short_goes_on(spark, tables, monkeypatch, at):
    """The run dies before its n-th change of stored files; the next one loses nothing."""
    landed_posts(spark, tables)
    now, left, delete = T0 + dt.timedelta(minutes=1), [at], tables._delete

    def dying(real):
        def change(*args, **kwargs):
            left[0] -= 1
            if left[0] < 0:
                raise CutShort
            return real(*args, **kwargs)

        return change

    with monkeypatch.context() as patch:
        patch.setattr(tables, "_delete", dying(tables._delete))
        patch.setattr(tables, "append", dying(tables.append))
        try:
            batch.prune(tables, now)
        except CutShort:
            # the worst place: the day's folder is gone already
            if at % 2:
                delete(f"{tables.path('raw_data')}/create_date=2024-01-15")
    batch.prune(tables, now if at % 3 else now + dt.timedelta(seconds=1))
    assert sorted(r["id"] for r in tables.posts().select("id").collect()) == [0, 1, 9]
    assert sorted(r["id"] for r in tables.appended("posts_clean").collect()) == [0, 1, 9]
    assert batch.prune(tables, now) == 0


def test_an_object_of_many_posts_is_read_once():
    ids = ",".join('{"post_id":%d}' % i for i in range(20_000))
    script = '{"publish_time":"2024-01-30 10:00","x":"} {","list":[' + ids + "]," + ",".join('"post_id":%d' % i for i in range(20_000)) + "}"
    places = [m.start() for m in page_outline._NAMED_ID.finditer(script)]
    started = time.time()
    page_outline._objects_around(script, places)
    page_outline._script_times([script] * 3)
    assert time.time() - started < 3


def test_innermost_objects():
    script = 'a } {1 {2 "{" } 3 {4} {5'
    found = page_outline._objects_around(script, [0, 5, 8, 17, 19, 23])
    assert found == {0: None, 5: None, 8: (7, 15), 17: None, 19: (18, 21), 23: None}


@pytest.mark.parametrize("n", [10, 400, 2000, 20_000])
def test_links_of_many_attributes(spark, n):
    attributes = " ".join(f"a{i}='v>{i}' b{i}=x c{i}" for i in range(n // 3))
    html = f"<p>it's</p><a {attributes} href=\"/x\" {attributes}>text</a> <a data-href='/no' HREF = '/y'>z"
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    got = [(r["href"], r["text"]) for r in pages.page_links(df).orderBy("pos").collect()]
    assert got == [("/x", "text"), ("/y", "z")]


def test_entry_without_the_extra_packages():
    code = (
        "import sys\nfor name in ('tiktoken', 'zstandard', 'xxhash'): sys.modules[name] = None\n"
        "import __spark_entry__ as e\nassert 'risk_profiles' in e.queries() and not any(q.startswith('op') for q in e.queries())\n"
        "assert 'pipeline' not in e.queries() and 'risk_profiles' in e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=100)
