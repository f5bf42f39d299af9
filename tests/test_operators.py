import datetime as dt
import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodtide.operators import (
    catalog, constraints, dashboard, history, labels, profile, recommend, retention, scorer, status,
    trend, upsert, word_model,
)

T0 = dt.datetime(2024, 1, 30, 23, 0)
LOW, MID, HIGH = "保守型", "稳健型", "激进型"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# --- profiles ----------------------------------------------------------------------------


def test_profiles_match_plain_statistics(spark):
    rng = random.Random(3)
    scores = {f"u{i}": [rng.random() for _ in range(i)] for i in range(1, 12)}
    data = [(u, s) for u, many in scores.items() for s in many] + [("u1", None)]
    got = {r["user_id"]: r for r in profile.risk_profiles(spark.createDataFrame(data, "user_id string, sentiment_score double")).collect()}
    assert "u1" not in got and set(got) == set(scores) - {"u1"}
    for user, row in got.items():
        assert row["post_count"] == len(scores[user])
        assert row["avg_sentiment"] == pytest.approx(statistics.fmean(scores[user]))
        assert row["volatility"] == pytest.approx(statistics.stdev(scores[user]))


def test_profile_single_post_kept_on_request(spark):
    one = spark.createDataFrame([("a", 0.7)], "user_id string, sentiment_score double")
    assert profile.risk_profiles(one).count() == 0
    assert profile.risk_profiles(one, min_posts=1).first()["volatility"] == 0.0


def test_missing_and_known(spark):
    profiles = spark.createDataFrame([("a", 1), ("b", 2)], "user_id string, n int")
    asked = spark.createDataFrame([("b",), ("b",), ("c",)], "user_id string")
    assert rows(profile.missing_profiles(asked, profiles), "user_id") == [("c",)]
    assert rows(profile.known_profiles(asked, profiles), "user_id") == [("b", 2)]


def test_dashboard(spark):
    schema = "user_id string, avg_sentiment double, risk_level string"
    some = spark.createDataFrame([("a", 0.6, LOW), ("b", 0.6, LOW), ("c", 0.6, HIGH), ("d", 0.6, HIGH)], schema)
    assert [tuple(r) for r in dashboard.risk_distribution(some).collect()] == [(LOW, 2, 0.5), (HIGH, 2, 0.5)]
    assert dashboard.global_sentiment(some).first() == (0.6, 4, "positive")
    none = some.where("false")
    assert dashboard.global_sentiment(none).first() == (0.0, 0, "bearish")
    assert dashboard.risk_distribution(none).count() == 0


# --- trend -------------------------------------------------------------------------------


def filled_by_hand(known: dict[int, float], edge: float, size: int):
    """Interpolate on a line through the known points and virtual points beyond both ends."""
    if not known:
        return [(edge, "anchor")] * size
    knots = {**{i: v for i, v in known.items()}, -1: edge, size: edge}
    out = []
    for i in range(size):
        if i in known:
            out.append((known[i], "real"))
            continue
        left = max(k for k in knots if k < i)
        right = min(k for k in knots if k > i)
        value = knots[left] + (knots[right] - knots[left]) * (i - left) / (right - left)
        inside = left in known and right in known
        out.append((value, "interpolated" if inside else "anchor"))
    return out


@pytest.mark.parametrize(
    "known",
    [{}, {0: 0.9}, {5: 0.9}, {2: 0.1}, {1: 0.2, 2: 0.4}, {1: 0.2, 3: 0.4}, {0: 0.3, 3: 0.9, 5: 0.0}, {i: i / 10 for i in range(6)}],
)
def test_fill_against_hand(spark, known):
    points = spark.createDataFrame([("s", i, known.get(i)) for i in range(6)], "k string, idx int, value double")
    got = rows(trend.fill_gaps(points, F.lit(0.5), ["k"], 6, None).select("idx", "value", "point_type"), "idx")
    want = filled_by_hand(known, 0.5, 6)
    assert [g[2] for g in got] == [w[1] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[0] for w in want])


def posts_at(spark, *entries):
    data = [(i, u, t, s) for i, (u, t, s) in enumerate(entries)]
    return spark.createDataFrame(data, "id long, user_id string, post_time timestamp_ntz, sentiment_score double")


def test_trend_range_is_half_open(spark):
    start, end = trend.trend_bounds(T0 + dt.timedelta(minutes=59))
    assert (start, end) == (dt.datetime(2024, 1, 30), dt.datetime(2024, 1, 31))
    posts = posts_at(spark, ("a", start, 0.2), ("a", end, 0.9), ("b", start - dt.timedelta(microseconds=1), 0.7), ("b", start, None))
    users = posts.select("user_id").distinct()
    got = trend.trend_by_series(posts, users, T0, digits_in=None, digits_out=None)
    first = rows(got.where("idx = 0").select("user_id", "value", "point_type", "label"), "user_id")
    assert first == [("a", 0.2, "real", "00:00"), ("b", pytest.approx(0.6), "anchor", "00:00")]
    assert got.where("user_id = 'b' and point_type <> 'anchor'").count() == 0
    assert got.count() == 48


def test_global_score_of_nothing_and_zero(spark):
    assert trend.global_score(posts_at(spark, ("a", T0, None))).first()[0] == 0.5
    assert trend.global_score(posts_at(spark, ("a", T0, 0.0))).first()[0] == 0.5
    assert trend.global_score(posts_at(spark, ("a", T0, 1 / 3))).first()[0] == 0.3333


def test_trend_rounds_to_four_places_by_default(spark):
    posts = posts_at(spark, ("a", T0, 1 / 3), ("a", T0 - dt.timedelta(hours=3), 2 / 3))
    got = {r["idx"]: r for r in trend.trend_global(posts, T0).collect()}
    assert got[23]["value"] == 0.3333 and got[20]["value"] == 0.6667
    assert got[21]["value"] == round(0.6667 + (0.3333 - 0.6667) / 3, 4)
    summary = trend.trend_summary(trend.trend_global(posts, T0)).first()
    assert (summary["real_points"], summary["filled_points"]) == (2, 22)
    assert summary["end_time"] == T0


# --- recommendation ------------------------------------------------------------------------

PRODUCT = "product_id long, product_name string, product_type string, risk_rating string, annual_yield double, max_drawdown double, sharpe_ratio double, tags string, purchase_url string"


def products_of(spark, numbers):
    data = [(i, f"p{i}", "t", level, y, d, s, '["a"]', None) for i, (level, y, d, s) in enumerate(numbers)]
    return spark.createDataFrame(data, PRODUCT)


def profiles_of(spark, users):
    data = [(f"u{i}", 0.5, v, 3, level) for i, (level, v) in enumerate(users)]
    return spark.createDataFrame(data, "user_id string, avg_sentiment double, volatility double, post_count long, risk_level string")


def best_by_hand(numbers, users):
    out = []
    for i, (level, v) in enumerate(users):
        scored = [
            (-(y * 0.4 + s * 10 * 0.3 - d * v * 1.2), p)
            for p, (rating, y, d, s) in enumerate(numbers) if rating == level
        ]
        out += [(f"u{i}", rank + 1, p) for rank, (_, p) in enumerate(sorted(scored)[:3])]
    return sorted(out)


def draw(seed, n, grid):
    rng = random.Random(seed)
    pick = (lambda a, b: rng.randint(a, b) / 2) if grid else rng.uniform
    return [(rng.choice([LOW, MID, HIGH]), pick(0, 40), pick(-5, 60), pick(-2, 6)) for _ in range(n)]


@pytest.mark.parametrize("seed,n,grid", [(1, 400, False), (2, 600, True), (3, 7, True), (4, 900, False)])
def test_best_products_against_all_pairs(spark, seed, n, grid):
    numbers = draw(seed, n, grid)
    rng = random.Random(seed)
    users = [(rng.choice([LOW, MID, HIGH]), rng.choice([0.0, rng.random() * 0.7, 5 * rng.random()])) for _ in range(150)]
    products, profiles = products_of(spark, numbers), profiles_of(spark, users)
    want = best_by_hand(numbers, users)
    columns = ("user_id", "rank", "product_id")
    for limits in ({}, {"first_buckets": 8, "lines_at_once": 20}):
        cells = recommend.build_cells(products, **limits)
        for hint in ("broadcast", "merge"):
            got = recommend.best_products(profiles, cells.hint(hint))
            assert rows(got.select(*columns), "user_id", "rank") == want


def test_divided_lines_hold_the_best_everywhere():
    rng = np.random.default_rng(5)
    t = np.linspace(0.01, 0.99, 300)
    sets = [
        (rng.uniform(0, 40, 500), rng.uniform(-5, 60, 500)),
        (rng.integers(0, 5, 300) * 1.0, rng.integers(0, 5, 300) * 1.0),
        (1 + t * t, 2 * t - 1 - t * t),  # every line is the best somewhere
        (np.full(200, 3.0) + np.arange(200) * 1e-13, np.full(200, 1.0)),  # nothing to tell apart
    ]
    for a, b in sets:
        parts = sorted(recommend.divided(a, b, 0.0, 1.0, 3), key=lambda part: part[0])
        assert parts[0][0] == 0.0 and parts[-1][1] == 1.0
        assert all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert len(parts) <= 4 * len(a)
        for low, high, lines in parts:
            for w in (low, (low + high) / 2, high):
                best = np.argsort(-(a - (a + b) * w), kind="stable")[:3]
                worst = (a - (a + b) * w)[best[-1]]
                sure = [i for i in best if (a - (a + b) * w)[i] >= worst]
                assert set(sure) <= set(lines.tolist()) or len(lines) >= 3 and np.isclose(
                    sorted((a - (a + b) * w)[lines])[-3:], sorted((a - (a + b) * w))[-3:], rtol=0, atol=1e-12
                ).all()
    assert max(len(lines) for _, _, lines in recommend.divided(*sets[2], 0.0, 1.0, 3)) <= 16


def test_copies_do_not_crowd_a_bucket(spark):
    numbers = [(LOW, 10.0, 1.0, 1.0)] * 500 + [(LOW, 9.0, 0.0, 1.0), (MID, 1.0, 1.0, 1.0)]
    users = [(LOW, 0.0), (LOW, 0.9), (MID, 0.1), (HIGH, 0.1)]
    cells = recommend.build_cells(products_of(spark, numbers))
    assert cells.agg(F.max(F.size("_options"))).first()[0] <= 4
    got = recommend.best_products(profiles_of(spark, users), cells)
    assert rows(got.select("user_id", "rank", "product_id"), "user_id", "rank") == best_by_hand(numbers, users)


def test_recommendation_output(spark):
    numbers = [(HIGH, 20.0, 1.0, 1.0), (HIGH, 10.0, 30.0, 2.0)]
    best = recommend.best_products(profiles_of(spark, [(HIGH, 0.1)]), recommend.build_cells(products_of(spark, numbers)))
    shown = recommend.recommendations(best).orderBy("rank").collect()
    assert [r["recommendation_score"] for r in shown] == [10.88, 6.4]
    assert shown[0]["tags"] == ["a"] and shown[0]["reason_code"] == "balanced"
    bands = recommend.recommendation_bands(best).orderBy("rank").first()
    assert tuple(bands)[3:] == ("high", "low", "mid", "mid")


# --- history -----------------------------------------------------------------------------


def test_history_limits_orders_and_ties(spark):
    hour = dt.timedelta(hours=1)
    entries = [("a", T0 - i * hour, i / 100) for i in range(11)] + [("b", T0, 0.1), ("b", T0, 0.2), ("b", T0, None)]
    got = rows(history.user_history(posts_at(spark, *entries)), "user_id", "seq")
    a = [r for r in got if r[0] == "a"]
    assert [r[3] for r in a] == [i / 100 for i in range(9, -1, -1)] and [r[1] for r in a] == list(range(1, 11))
    assert [r[1:] for r in got if r[0] == "b"] == [(1, "01-30 23:00:00", 0.1), (2, "01-30 23:00:00", 0.2)]


def test_history_plan_limits_before_the_shuffle(spark):
    posts = posts_at(spark, ("a", T0, 0.1))
    plan = history.user_history(posts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_series_prefers_history(spark):
    posts = posts_at(spark, ("a", T0, 0.1))
    sentiment = spark.createDataFrame(
        [(1, "a", T0, 0.9, "x"), (2, "b", T0, 0.8, "x")],
        "id long, user_id string, analyze_time timestamp_ntz, sentiment_score double, sentiment_label string",
    )
    got = rows(history.user_series(posts, sentiment).select("user_id", "score", "origin"), "user_id")
    assert got == [("a", 0.1, "history"), ("b", 0.8, "points")]


# --- upserts -----------------------------------------------------------------------------

POST = "source_post_id string, id long, content string, post_time timestamp_ntz, update_time timestamp_ntz"


def test_post_upsert(spark):
    t = [T0 + dt.timedelta(hours=i) for i in range(4)]
    stored = spark.createDataFrame([("a", 1, "old", t[0], t[0]), ("b", 2, "old", t[0], t[0])], POST)
    batch = spark.createDataFrame(
        [("a", 9, "new", t[2], t[2], 2), ("a", 8, "new", t[1], t[1], 1), ("c", 7, "first", t[1], t[1], 1), ("c", 6, "second", t[3], t[3], 2)],
        POST + ", seq int",
    )
    want = [("a", 1, "old", t[2], t[2]), ("b", 2, "old", t[0], t[0]), ("c", 7, "first", t[3], t[3])]
    once = upsert.upsert_posts(stored, batch)
    assert rows(once, "source_post_id") == want
    assert rows(upsert.upsert_posts(once, batch), "source_post_id") == want


def test_profile_upsert_keeps_absent_users(spark):
    schema = "user_id string, avg_sentiment double, update_time timestamp_ntz"
    old = spark.createDataFrame([("a", 0.1, T0), ("b", 0.2, T0)], schema)
    new = spark.createDataFrame([("b", 0.9, T0), ("c", 0.3, T0)], schema)
    assert [r[:2] for r in rows(upsert.upsert_profiles(old, new), "user_id")] == [("a", 0.1), ("b", 0.9), ("c", 0.3)]


def test_upsert_overwrites_with_null(spark):
    schema = "user_id string, avg_sentiment double, update_time timestamp_ntz"
    old = spark.createDataFrame([("a", 0.1, T0)], schema)
    new = spark.createDataFrame([("a", None, None)], schema)
    assert rows(upsert.upsert_profiles(old, new), "user_id") == [("a", None, None)]


# --- states, retention, constraints --------------------------------------------------------


def test_states_move_once(spark):
    raw = spark.createDataFrame([(i, f"u{i}", f"<b>t{i}</b>" if i != 2 else None, T0) for i in range(4)], "id long, user_id string, content string, update_time timestamp_ntz")
    clean = status.clean_batch(status.pending_posts(raw, spark.createDataFrame([(3,)], "id long")), T0)
    assert rows(clean.select("id", "clean_content"), "id") == [(0, "t0"), (1, "t1"), (2, "")]
    none = spark.createDataFrame([], "id long, sentiment_score double, sentiment_label string, update_time timestamp_ntz")
    ready = status.scorable_posts(raw, clean, none)
    assert rows(ready, "id") == [(0, "u0", "t0"), (1, "u1", "t1")]
    scored = status.scored_batch(ready.withColumns({"sentiment_score": F.lit(0.5), "sentiment_label": F.lit("中立")}).where("id = 0"), T0)
    assert rows(status.scorable_posts(raw, clean, scored), "id") == [(1, "u1", "t1")]
    counts = status.status_counts(status.posts_with_status(raw, clean, scored))
    assert rows(counts, "process_status") == [(0, 1), (1, 2), (2, 1)]


def test_retention_cutoff_is_kept(spark):
    cut = retention.cutoff(T0)
    data = [(1, cut), (2, cut - dt.timedelta(microseconds=1))]
    posts = spark.createDataFrame(data, "id long, create_time timestamp_ntz")
    assert [r["id"] for r in retention.prune_posts(posts, T0).collect()] == [1]
    assert retention.prune_summary(posts, T0).first() == (1, 1)


def test_dirty_report(spark):
    data = [(i, "1234567" if i < 15 else "12345678", "c" * 40) for i in range(20)]
    posts = spark.createDataFrame(data, "id long, source_post_id string, content string")
    assert retention.dirty_summary(posts).first() == (15, 5)
    sample = retention.dirty_sample(posts).collect()
    assert len(sample) == 10 and tuple(sample[0]) == ("1234567", 7, "c" * 30)
    assert retention.purge_dirty_ids(posts).count() == 5


def test_constraints(spark):
    posts = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, key string")
    child = spark.createDataFrame([(1,), (9,), (9,), (None,)], "ref long")
    report = constraints.violation_report(
        constraints.unique_violations(posts, "key", "unique"),
        constraints.orphan_violations(child, "ref", posts, "id", "exists"),
        constraints.null_violations(posts, ["id", "key"], "posts"),
    )
    assert rows(report, "constraint_name") == [("exists", 2), ("posts.id", 0), ("posts.key", 1), ("unique", 1)]


def test_defaults(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "id long, max_drawdown double")
    got = constraints.with_defaults(df, constraints.product_defaults())
    assert rows(got, "id") == [(1, 0.0, 0.0), (2, 3.0, 0.0)]
    stamped = constraints.with_defaults(df, constraints.post_defaults(T0))
    assert stamped.first()["process_status"] == 0 and stamped.first()["create_time"] == T0


# --- catalogue, labels, scorer ---------------------------------------------------------------


def test_catalog_order(spark):
    listing = catalog.catalog_listing(products_of(spark, [(HIGH, 1.0, 0.0, 0.0), (LOW, 5.0, 0.0, 0.0), (LOW, 2.0, 0.0, 0.0), (MID, 9.0, 0.0, 0.0)]))
    assert [r["product_id"] for r in listing.collect()] == [2, 1, 3, 0]


@pytest.mark.parametrize(
    "names,want",
    [
        (["LABEL_0", "LABEL_1", "LABEL_2"], (2, 1, 0, ["悲观", "中立", "乐观"])),
        (["pos", "neg"], (0, 1, 1, ["乐观", "悲观"])),
        (["x", "y"], (1, 0, 0, ["悲观", "乐观"])),
        (["z"], (0, 0, 0, ["中立"])),
        (["Bullish", "positive", "neutral", "bearish"], (0, 2, 3, ["乐观", "乐观", "中立", "悲观"])),
    ],
)
def test_label_mapping(spark, names, want):
    data = [("m", len(names), i, n) for i, n in enumerate(names)]
    got = labels.label_mapping(spark.createDataFrame(data, "model_id string, num_labels int, label_index int, raw_label string")).orderBy("label_index").collect()
    assert (got[0]["positive_index"], got[0]["neutral_index"], got[0]["negative_index"]) == want[:3]
    assert [r["label"] for r in got] == want[3]


def test_model_and_word_lists_agree(spark):
    posts = spark.createDataFrame([(1, "good good bad"), (2, "bad"), (3, ""), (4, "good")], "id long, clean_content string")

    def load():
        def model(texts):
            assert len(texts) <= 2
            return [[t.split().count("bad"), 1.0, t.split().count("good")] for t in texts]

        return model

    columns = ["id", "sentiment_score", "sentiment_label"]
    by_model = scorer.score_with_model(posts, load, batch_size=2).select(columns)
    by_words = scorer.score_with_lexicon(posts, ["good"], ["bad"]).select(columns)
    a, b = rows(by_model, "id"), rows(by_words, "id")
    assert [r[0::2] for r in a] == [r[0::2] for r in b]
    assert [r[1] for r in a] == pytest.approx([r[1] for r in b])
    assert all(0 <= r[1] <= 1 for r in a)


def test_hashed_words_count_each_word():
    weights = np.arange(14.0).reshape(7, 2)
    texts = ["a b  a\n\tlong", "", None, " ", "b " * 5000]
    model = word_model.HashedWords(weights, scale=2.0)

    def slow(words):
        chosen = [weights[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 7] for w in words]
        return list(2.0 * sum(chosen) / len(chosen)) if chosen else [0.0, 0.0]

    assert model(texts) == [slow((t or "").split()) for t in texts]
    short = word_model.HashedWords(weights, scale=2.0, max_tokens=2)
    assert short(texts) == [slow((t or "").split()[:2]) for t in texts] and model([]) == []


def test_labels_reach_the_scorer(spark):
    named = spark.createDataFrame(
        [(7, 3, 0, "POSITIVE"), (7, 3, 1, "neg"), (7, 3, 2, "neutral"), (8, 2, 0, "LABEL_0"), (8, 2, 1, "LABEL_1")],
        "model_id int, num_labels int, label_index int, raw_label string",
    )
    swapped = labels.classes_of(named, 7)
    assert (swapped.count, swapped.positive) == (3, 0)
    assert labels.classes_of(named, 8) == labels.Classes(2, 1, 0, {0: "悲观", 1: "乐观"})
    with pytest.raises(ValueError):
        labels.classes_of(named, 9)
    posts = spark.createDataFrame([(1, "x")], "id int, clean_content string")
    scored = scorer.score_with_model(posts, lambda: lambda texts: [[3.0, 0.0, 0.0]] * len(texts), swapped).first()
    assert scored["sentiment_label"] == "乐观" and scored["sentiment_score"] > 0.9
