import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from moodtide.functions import risk
from moodtide.functions import sentiment as sent
from moodtide.functions.ids import is_dirty_post_id, is_valid_post_id, post_id_from_href
from moodtide.functions.tags import tags_array, tags_array_lenient
from moodtide.fixed_values import CLEAN_CONTENT_CHARS
from moodtide.functions.text import clean_text
from moodtide.functions.times import floor_hour, hour_label, ntz, parse_post_time, visible_time

LOW, MID, HIGH = "保守型", "稳健型", "激进型"


def test_clean_text_boundaries(evaluate):
    cases = {
        None: None,
        "": "",
        "    ": "",
        "<p><br/></p>": "",
        "<p unclosed": "<p unclosed",
        "<script>x</script>": "x",
        "a\tb": "a b",
        "\ta\t": "a",
        "a \n b": "a b",
        "a\r\n\tb": "a b",
        "a  b   c": "a b c",
        "$A$x": "x",
        "lone $ stays": "lone $ stays",
        "$ over\nlines $!": "!",
        "see https://x.example/a?b c": "see c",
        "ht<b>tp://x.example y": "y",
        "a <i></i> b": "a b",
        "x" * 1000: "x" * 1000,
        "x" * 1001: "x" * 1000,
        "y" * 999 + "😀z": "y" * 999 + "😀",
        "z" * 999 + " tail": "z" * 999 + " ",
    }
    limited = lambda c: clean_text(c, CLEAN_CONTENT_CHARS)
    assert evaluate(limited, list(cases)) == list(cases.values())
    assert evaluate(clean_text, ["x" * 1001]) == ["x" * 1001]


def test_cleaned_text_holds_nothing_to_clean(evaluate):
    import random

    rng = random.Random(7)
    pieces = ["<b>", "</b>", "word", " ", "  ", "\n", "\t", "\r", "$AB$", "http://q.example/x ", "é"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(300)]
    for text in evaluate(lambda c: clean_text(c, CLEAN_CONTENT_CHARS), texts):
        assert not any(mark in text for mark in ("<b>", "http://", "\n", "\r", "\t", "  "))
        assert len(text) <= 1000


def test_post_ids(evaluate):
    ids = ["1234567", "12345678", "12345678901", "123456789012", "1234567x", "12345678\n", "１２３４５６７８", ""]
    assert evaluate(is_valid_post_id, ids) == [False, True, True, False, False, False, False, False]
    assert evaluate(is_dirty_post_id, ids) == [True, False, False, True, True, True, True, True]


def test_post_id_from_href(evaluate):
    hrefs = {
        "/news,zssh000001,1685981016.html": "1685981016",
        "/news,zssh000001,168598101612.html": "168598101612",
        "/news/12345678/1234567.html": "12345678",
        "/about.html": None,
        "": None,
        None: None,
    }
    assert evaluate(post_id_from_href, list(hrefs)) == list(hrefs.values())


def test_parse_post_time(evaluate):
    as_of = dt.datetime(2024, 6, 1, 12, 0)
    cases = {
        "2026-03-20 14:30": dt.datetime(2026, 3, 20, 14, 30),
        "2026/03/20 14:30": dt.datetime(2026, 3, 20, 14, 30),
        "2026-03-20 14:30:15": dt.datetime(2026, 3, 20, 14, 30, 15),
        "03-20 14:30": dt.datetime(2024, 3, 20, 14, 30),
        "03/20 14:30": dt.datetime(2024, 3, 20, 14, 30),
        "\u3000\x1c2026-3-2\u00a0\u20094:05\u3000": dt.datetime(2026, 3, 2, 4, 5),
        "03/20\u300014:30": dt.datetime(2024, 3, 20, 14, 30),
        " 2026-3-2 4:05 ": dt.datetime(2026, 3, 2, 4, 5),
        "2026/03/20 14:30:15": as_of,
        "02-29 10:00": as_of,
        "2024-02-29 10:00": dt.datetime(2024, 2, 29, 10, 0),
        "2023-02-29 10:00": as_of,
        "2026-03/20 14:30": as_of,
        "2026-03-20 24:30": as_of,
        "2026-03-20 14:30:60": as_of,
        "yesterday": as_of,
        "": as_of,
        None: as_of,
    }
    got = evaluate(lambda v: parse_post_time(v, ntz(as_of)), list(cases))
    assert dict(zip(cases, got)) == cases


def test_visible_time(evaluate):
    cases = {
        "on 2026/03/20 14:30 here": "2026/03/20 14:30",
        "2026-03-20  14:30:15!": "2026-03-20  14:30:15",
        "a 03-20 14:30 b": "03-20 14:30",
        "a 03-20\u300014:30 b": "03-20\u300014:30",
        "3-20 14:30": None,
        "nothing": None,
    }
    assert evaluate(visible_time, list(cases)) == list(cases.values())


def test_hours(evaluate):
    moment = dt.datetime(2024, 3, 31, 2, 59, 59, 999999)
    assert evaluate(floor_hour, [moment], "timestamp_ntz") == [dt.datetime(2024, 3, 31, 2)]
    assert evaluate(hour_label, [moment], "timestamp_ntz") == ["02:00"]


def test_tags(evaluate):
    cases = ['["a","b"]', '{"x":"a","y":"b"}', '"plain"', "", "[broken", None, "[]", '"q\\"t"']
    assert evaluate(tags_array, cases) == [["a", "b"], ["a", "b"], [], [], [], [], [], []]
    assert evaluate(tags_array_lenient, cases) == [
        ["a", "b"], ["a", "b"], ["plain"], [], [], [], [], ['q"t'],
    ]


def test_polarised_score(spark):
    rows = [(0.5, 0.5), (1.0, 0.0), (0.0, 1.0), (0.6, 0.2), (0.2, 0.6)]
    df = spark.createDataFrame(rows, "p double, n double")
    scores = [r[0] for r in df.select(sent.polarised_score(F.col("p"), F.col("n"))).collect()]
    assert scores[:3] == [0.5, 1.0, 0.0]
    assert scores[3] == pytest.approx(0.5 + 0.5 * math.sqrt(0.4))
    assert scores[3] + scores[4] == pytest.approx(1.0)


def test_softmax_and_label(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0), (3.0, 3.0, 1.0), (900.0, 0.0, 0.0)], "a double, b double, c double")
    p = sent.softmax([F.col(c) for c in "abc"])
    rows = df.select(*[c.alias(n) for c, n in zip(p, "xyz")], sent.predicted_label(p).alias("l")).collect()
    assert all(sum(r[:3]) == pytest.approx(1.0) for r in rows)
    assert [r["l"] for r in rows] == ["乐观", "悲观", "悲观"]
    one = sent.softmax([F.col("a")])
    assert df.select(one[0].alias("p"), sent.predicted_label(one, {0: "中立"}).alias("l")).first() == (1.0, "中立")


def test_label_words(evaluate):
    raw = ["LABEL_0", "Very-Positive", " neutral ", "NEG", None, "non-neutral negative", "p_o_s"]
    assert evaluate(sent.label_from_words, raw) == [None, "乐观", "中立", "悲观", None, "中立", "乐观"]


def test_risk_tree(spark):
    cases = [
        (0.4499, 0.25, LOW), (0.45, 0.25, MID), (0.5199, 0.25, MID), (0.52, 0.25, HIGH),
        (0.4499, 0.2501, LOW), (0.45, 0.2501, LOW), (0.5199, 0.2501, LOW), (0.52, 0.2501, MID),
        (0.5199999999999999, 0.0, HIGH), (0.52, 0.25000000000000006, HIGH),
    ]
    df = spark.createDataFrame(cases, "a double, s double, want string")
    got = df.select("want", risk.risk_level(F.col("a"), F.col("s")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_reasons(spark):
    cases = [
        (0.6, 0.1999, 12.0, "growth"), (0.6, 0.2, 12.0, "steady"), (0.5999, 0.0, 12.0, "balanced"),
        (0.6, 0.0, 11.99, "balanced"),
    ]
    df = spark.createDataFrame(cases, "a double, v double, y double, want string")
    code = risk.reason_code(F.col("a"), F.col("v"), F.col("y"))
    text = risk.reason_text(code, F.col("y"), F.lit(1.5), F.lit(0.25), F.lit(7.126))
    rows = df.select("want", code.alias("got"), text.alias("text")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert all("7.13" in r["text"] for r in rows)
    assert "12.00%" in rows[0]["text"] and "1.50%" in rows[1]["text"]


def test_product_score(spark):
    score = risk.product_score(F.lit(10.0), F.lit(2.0), F.lit(5.0), F.lit(0.5))
    assert spark.range(1).select(score).first()[0] == pytest.approx(4 + 6 - 3)
