import datetime as dt

import pytest

from moodtide.functions import page_outline
from moodtide.operators import pages
from moodtide.schemas import PAGES
from moodtide.sources import views

AS_OF = dt.datetime(2024, 6, 1, 12, 0)


def posts(spark, *htmls):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(htmls)], PAGES)
    found = pages.page_posts(df, AS_OF).orderBy("page_id", "pos").collect()
    return [
        (r["source_post_id"], r["user_id"], r["content"], r["post_time"], r["time_source"])
        for r in found
    ]


def row(post_id, title="t", author='<i class="l4">ann</i>', time='<i class="l5">03-20 14:30</i>'):
    return f'<div><span><a data-postid="{post_id}">{title}</a></span>{author}{time}</div>'


WHEN = dt.datetime(2024, 3, 20, 14, 30)


def test_marked_page(spark):
    got = posts(spark, row(12345678) + row(12345679, "two <b>bold</b> words", author=""))
    assert got == [
        ("12345678", "ann", "t", WHEN, "dom_time_tag"),
        ("12345679", "unknown", "twoboldwords", WHEN, "dom_time_tag"),
    ]


def test_legacy_rows_only_without_marked_links(spark):
    old = (
        '<div class="articleh x"><a href="/other">no</a><a href="/news,zssh000001,1685981016.html">old</a>'
        '<a href="/news,zssh000001,1685981017.html">second</a><b class="author">bob</b></div>'
    )
    assert posts(spark, old) == [("1685981016", "bob", "old", AS_OF, "not_found")]
    assert [p[0] for p in posts(spark, old + row(12345678))] == ["12345678"]


def test_first_mention_wins_even_without_title(spark):
    assert [p[2] for p in posts(spark, row(12345678, "one") + row(12345678, "again"))] == ["one"]
    assert posts(spark, row(12345678, " ") + row(12345678, "good")) == []
    # the same id on another page is another mention
    assert len(posts(spark, row(12345678), row(12345678))) == 2


@pytest.mark.parametrize("bad", ["1234567", "123456789012", "1234567x", ""])
def test_unusable_ids(spark, bad):
    assert posts(spark, row(bad)) == []


def test_time_sources(spark):
    script = (
        '<script>x={"list":[{"post_id":123456789,"post_publish_time":"2020-01-01 00:00:00"},'
        '{"user":{"n":"}{"},"post_id":12345678,"post_publish_time":" 2024-02-03 04:05:06 "}]}</script>'
    )
    text_row = row(12345679, time="<p>seen 2024/03/20 14:30 ok</p>")
    assert [p[3:] for p in posts(spark, row(12345678) + text_row + row(12345670, time="") + script)] == [
        (dt.datetime(2024, 2, 3, 4, 5, 6), "script_json"),
        (WHEN, "container_text_regex"),
        (AS_OF, "not_found"),
    ]


def test_empty_tag_falls_back_to_text(spark):
    got = posts(spark, row(12345678, time='<i class="mytime"></i> 03-20 14:30'))
    assert got[0][3:] == (WHEN, "container_text_regex")


def test_script_quoted_and_source_ids(spark):
    script = (
        '<script>a={"post_id":"12345678","post_publish_time":"2024-03-20 14:30"};'
        'b={"source_post_id":"12345679","x":{"y":1},"post_publish_time":"2024-03-20 14:30"};'
        'c={"post_id":12345670</script>'
    )
    body = row(12345678, time="") + row(12345679, time="") + row(12345670, time="")
    assert [p[3:] for p in posts(spark, body + script)] == [
        (WHEN, "script_json"), (WHEN, "script_json"), (AS_OF, "not_found"),
    ]


def test_outline_reads_untidy_html():
    page = page_outline.Outline("<ul><li>a<li>b &lt; c</ul></p><br>d<!-- x -->e<script>s</script>")
    assert page.text(0) == "ab < cde" and page.scripts == ["s"]
    assert page.text(0, " ") == "a b < c d e"


def test_pages_without_posts_give_nothing(spark):
    assert posts(spark, "<p>hello</p>", None, "") == []


def test_landed_rows_and_counters(spark):
    df = spark.createDataFrame([(0, "u", row(12345678)), (1, "u", row(12345678) + row(12345679)), (2, "u", "<p>")], PAGES)
    found = pages.page_posts(df, AS_OF)
    landed = pages.landed_rows(found, AS_OF).collect()
    assert {(r["id"], r["process_status"], r["topic"]) for r in landed} == {(12345678, 0, "股吧"), (12345679, 0, "股吧")}
    assert pages.ingest_counters(df, found).first() == (3, 2, 3, 2)
    assert pages.page_range(df, 1, 2).count() == 2


def test_links_of_a_page(spark):
    df = spark.createDataFrame([(0, "u", '<a href="/x">one</a><a>no</a><a href="/y">two</a><a href="/x">more</a>')], PAGES)
    assert [tuple(r) for r in pages.page_links(df).orderBy("pos").collect()] == [(0, 0, "/x", "one"), (0, 1, "/y", "two")]


@pytest.mark.parametrize(
    "html,want",
    [
        ("<a href='/x'>one</a>", [("/x", "one")]),
        ("<a href=/x/y>one</a>", [("/x/y", "one")]),
        ('<A class=b\nHREF = "/x" id=c>one</A >', [("/x", "one")]),
        ('<a title="a > b" href="/x">one</a>', [("/x", "one")]),
        ("<a title=it's href='/x'>one</a>", [("/x", "one")]),
        ('<a href="/x">one <a href="/y"><b>two</b>', [("/x", "one"), ("/y", "two")]),
        ('<a data-href="/x">no</a><a title=" href=\'/no\'" href="/y">two</a>', [("/y", "two")]),
        ('<!-- <a href="/x">no</a> --><script>s = \'<a href="/z">no</a>\'</script><a href="/y">two</a>', [("/y", "two")]),
        ('<abbr href="/x">no</abbr><a href>no</a><a name="n">no</a>', []),
        ("<a " + "word " * 50_000, []),
    ],
)
def test_forms_of_links(spark, html, want):
    found = pages.page_links(spark.createDataFrame([(0, "u", html)], PAGES)).orderBy("pos").collect()
    assert [(r["href"], r["text"]) for r in found] == want


def test_list_pages_keep_every_event(spark):
    events = views.table(spark, "/root/testdata/sf0.001", "events")
    assert views.list_pages_from(events).count() == -(-events.count() // views.POSTS_PER_PAGE)


def test_unclosed_tags_take_linear_time():
    import time

    from moodtide.functions.page_outline import post_links

    html = "<p>text " * 20_000 + "</b>" * 20_000
    started = time.process_time()
    post_links(html)
    assert time.process_time() - started < 2
