"""The registered queries: (spark, sf_dir) to a DataFrame over the whole given tables.

Means and scores are rounded once, to nine places, for comparison between engines.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide import session
from moodtide.fixed_values import CLEAN_CONTENT_CHARS
from moodtide.functions import risk
from moodtide.functions import sentiment as sent
from moodtide.functions.ids import is_valid_post_id
from moodtide.functions.text import clean_text
from moodtide.functions.times import ntz, parse_post_time, visible_time
from moodtide.operators import (
    catalog,
    constraints,
    dashboard,
    history,
    labels,
    pages,
    profile,
    recommend,
    retention,
    scorer,
    status,
    trend,
    upsert,
    word_model,
)
from moodtide.schemas import TABLES
from moodtide.sources import views
from moodtide.sources.tables import LAYOUT, Tables
from moodtide.sources.views import AS_OF
from moodtide.streaming import jobs, rounds

REGISTRY = {}
DIGITS = 9

POSITIVE_LEXICON = ["the", "und", "les", "que", "and"]
NEGATIVE_LEXICON = ["of", "der", "le", "de", "die"]


def query(run):
    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(session.use_utc(spark), sf_dir)

    in_utc.__name__ = run.__name__
    in_utc.__doc__ = run.__doc__
    REGISTRY[run.__name__] = in_utc
    return in_utc


def r(column: str | Column, digits: int = DIGITS) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r(c) for c in columns})


# --- text ------------------------------------------------------------------------------


@query
def clean_documents(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", clean_text(F.col("text")).alias("clean"))


@query
def clean_limited(spark, sf_dir):
    """The limit for posts, asked for openly."""
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", clean_text(F.col("text"), CLEAN_CONTENT_CHARS).alias("clean"))


@query
def clean_pages(spark, sf_dir):
    text = F.concat("html", F.lit(" see "), "url", F.lit("  end"))
    return views.real_pages(spark, sf_dir).select("page_id", clean_text(text).alias("clean"))


@query
def clean_conversations(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", clean_text(F.col("text")).alias("clean"))


@query
def clean_posts(spark, sf_dir):
    """Cleaning write-back: the rows the cleaned table would gain."""
    pending = status.pending_by_status(views.posts(spark, sf_dir))
    return status.clean_batch(pending, AS_OF, CLEAN_CONTENT_CHARS)


# --- sentiment -------------------------------------------------------------------------


def _probabilities(spark, sf_dir):
    logits = views.logits(spark, sf_dir)
    names = ["p_negative", "p_neutral", "p_positive"]
    p = sent.softmax([F.col(f"z{i}") for i in range(3)])
    return logits.select("vec_id", *[c.alias(n) for n, c in zip(names, p)])


@query
def softmax_probabilities(spark, sf_dir):
    return rounded(_probabilities(spark, sf_dir), "p_negative", "p_neutral", "p_positive")


@query
def sentiment_score(spark, sf_dir):
    score = sent.polarised_score(F.col("p_positive"), F.col("p_negative"))
    return _probabilities(spark, sf_dir).select("vec_id", r(score, 6).alias("score"))


@query
def sentiment_label(spark, sf_dir):
    p = [F.col(n) for n in ("p_negative", "p_neutral", "p_positive")]
    return _probabilities(spark, sf_dir).select("vec_id", sent.predicted_label(p).alias("label"))


@query
def label_mapping(spark, sf_dir):
    return labels.label_mapping(views.model_labels(spark, sf_dir))


@query
def label_classes(spark, sf_dir):
    """What a label's own wording says, before any default."""
    named = views.model_labels(spark, sf_dir).select(
        "model_id",
        "label_index",
        sent.normalised_label(F.col("raw_label")).alias("name"),
        sent.label_from_words(F.col("raw_label")).alias("class_label"),
    )
    return named


@query
def lexicon_sentiment(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scorer.score_with_lexicon(docs, POSITIVE_LEXICON, NEGATIVE_LEXICON, "text")
    return scored.select("doc_id", r("sentiment_score", 6).alias("score"), "sentiment_label")


def _count_model():
    """A model by the same word counts, in Python: stands where a trained one would."""
    good, bad = set(POSITIVE_LEXICON), set(NEGATIVE_LEXICON)

    def logits(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            out.append(
                [sum(w in bad for w in words), 1.0, sum(w in good for w in words)]
            )
        return out

    return logits


@query
def model_sentiment(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scorer.score_with_model(docs, _count_model, text="text")
    return scored.select("doc_id", r("sentiment_score", 6).alias("score"), "sentiment_label")


WORD_BUCKETS = 1024


def _word_model():
    """Weights by a rule, in sixteenths, so that sums of them are exact."""
    bucket, output = np.arange(WORD_BUCKETS)[:, None], np.arange(3)[None, :]
    return word_model.HashedWords(((bucket * (2 * output + 3) + 5 * output) % 17 - 8) / 16, scale=8.0)


@query
def hashed_sentiment(spark, sf_dir):
    """A linear model over hashed words; its first label list of three says what its outputs mean."""
    named = views.model_labels(spark, sf_dir)
    model_id = named.where(F.col("num_labels") == 3).agg(F.min("model_id")).first()[0]
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = labels.classes_of(named, model_id)
    scored = scorer.score_with_model(docs, _word_model, classes, text="text")
    return scored.select("doc_id", r("sentiment_score", 6).alias("score"), "sentiment_label")


# --- scans, states, filters ------------------------------------------------------------


@query
def pending_posts(spark, sf_dir):
    raw, clean, _ = views.stage_tables(views.posts(spark, sf_dir))
    return status.pending_posts(raw, clean)


@query
def scorable_posts(spark, sf_dir):
    return status.scorable_posts(*views.stage_tables(views.posts(spark, sf_dir)))


@query
def status_counts(spark, sf_dir):
    stages = views.stage_tables(views.posts(spark, sf_dir))
    return status.status_counts(status.posts_with_status(*stages))


@query
def score_details(spark, sf_dir):
    return profile.score_details(views.posts(spark, sf_dir))


@query
def score_writeback(spark, sf_dir):
    """Rows for the scored table, from posts scored by word lists."""
    ready = status.scorable_by_status(views.posts(spark, sf_dir))
    scored = scorer.score_with_lexicon(ready, ["purchase", "error"], ["view", "signup"])
    return rounded(status.scored_batch(scored, AS_OF), "sentiment_score")


@query
def sentiment_writeback(spark, sf_dir):
    """The same results as ``user_sentiment`` rows."""
    ready = status.scorable_by_status(views.posts(spark, sf_dir))
    scored = scorer.score_with_lexicon(ready, ["purchase", "error"], ["view", "signup"])
    return rounded(status.sentiment_rows(scored, AS_OF), "sentiment_score")


@query
def posts_in_range(spark, sf_dir):
    posts = views.posts(spark, sf_dir).select("id", "post_time", "sentiment_score")
    day = trend.posts_between(posts, *trend.trend_bounds(AS_OF))
    return day.where(F.col("sentiment_score").isNotNull())


@query
def products_of_level(spark, sf_dir):
    products = views.catalog(spark, sf_dir)
    return products.where(F.col("risk_rating") == recommend.RISK_LEVELS[1]).select(
        "product_id", "product_name", "annual_yield"
    )


@query
def valid_post_ids(spark, sf_dir):
    posts = views.posts(spark, sf_dir)
    return posts.select(
        "id", "source_post_id", is_valid_post_id(F.col("source_post_id")).alias("valid")
    )


# --- profiles and dashboard ------------------------------------------------------------


def _profiles(spark, sf_dir):
    return profile.risk_profiles(views.posts(spark, sf_dir))


@query
def risk_profiles(spark, sf_dir):
    return rounded(_profiles(spark, sf_dir), "avg_sentiment", "volatility")


@query
def missing_profiles(spark, sf_dir):
    asked = views.posts(spark, sf_dir).select("user_id")
    return profile.missing_profiles(asked, _profiles(spark, sf_dir))


@query
def known_profiles(spark, sf_dir):
    """Profiles of requested users: those who posted an error."""
    asked = views.posts(spark, sf_dir).where(F.col("topic") == "error").select("user_id")
    known = profile.known_profiles(asked, _profiles(spark, sf_dir))
    return known.select("user_id", "post_count", "risk_level")


@query
def risk_distribution(spark, sf_dir):
    return rounded(dashboard.risk_distribution(_profiles(spark, sf_dir)), "user_share")


@query
def global_sentiment(spark, sf_dir):
    return rounded(dashboard.global_sentiment(_profiles(spark, sf_dir)), "global_avg_sentiment")


# --- trends ----------------------------------------------------------------------------

EXACT = {"digits_in": None, "digits_out": None}


@query
def global_post_score(spark, sf_dir):
    return rounded(trend.global_score(views.posts(spark, sf_dir), None), "global_score")


@query
def hourly_sentiment(spark, sf_dir):
    return rounded(trend.hourly_sentiment(views.posts(spark, sf_dir), digits=None), "avg_score")


@query
def trend_24h(spark, sf_dir):
    return rounded(trend.trend_global(views.posts(spark, sf_dir), AS_OF, **EXACT), "value")


@query
def trend_24h_by_user(spark, sf_dir):
    posts = views.posts(spark, sf_dir, by_day=False)
    users = posts.select("user_id").distinct()
    return rounded(trend.trend_by_series(posts, users, AS_OF, **EXACT), "value")


@query
def trend_deviation(spark, sf_dir):
    posts = views.posts(spark, sf_dir)
    filled = trend.trend_global(posts, AS_OF, **EXACT)
    out = trend.with_deviation(filled, _profiles(spark, sf_dir), None)
    return rounded(out, "value", "deviation", "real_value", "filled_value")


@query
def trend_summary(spark, sf_dir):
    filled = trend.trend_global(views.posts(spark, sf_dir), AS_OF, **EXACT)
    return rounded(trend.trend_summary(filled), "mean_value")


# --- recommendation --------------------------------------------------------------------


def best_products(spark, sf_dir) -> DataFrame:
    cells = recommend.build_cells(views.catalog(spark, sf_dir))
    return recommend.best_products(_profiles(spark, sf_dir), cells)


@query
def recommend_top3(spark, sf_dir):
    best = best_products(spark, sf_dir)
    return best.select(
        "user_id",
        "risk_level",
        "rank",
        "product_id",
        "product_name",
        "product_type",
        "annual_yield",
        "max_drawdown",
        "sharpe_ratio",
        r("score").alias("score"),
        "purchase_url",
    )


@query
def recommend_reason(spark, sf_dir):
    best = best_products(spark, sf_dir)
    code = risk.reason_code(F.col("avg_sentiment"), F.col("volatility"), F.col("annual_yield"))
    return best.select("user_id", "rank", "product_id", code.alias("reason_code"))


@query
def recommend_bands(spark, sf_dir):
    return recommend.recommendation_bands(best_products(spark, sf_dir))


@query
def recommend_answer(spark, sf_dir):
    """The answer as shown, with the text made of the rounded numbers."""
    best = best_products(spark, sf_dir)
    shown = recommend.recommendations(best).join(best.select("user_id", "rank", "score"), ["user_id", "rank"])
    return shown.select(
        "user_id",
        "rank",
        "product_id",
        "product_name",
        "risk_rating",
        "reason_code",
        (F.length("recommend_reason") > 0).alias("has_text"),
        (F.col("recommendation_score") == F.round("recommendation_score", 2)).alias("two_places"),
        (F.abs(F.col("recommendation_score") - F.col("score")) <= 0.005 + 1e-9).alias("near_score"),
        F.array_join("tags", "|").alias("tags"),
        "purchase_url",
    )


@query
def product_scores(spark, sf_dir):
    """Every product's score at a volatility of 0.25."""
    score = risk.product_score(
        F.col("annual_yield"), F.col("sharpe_ratio"), F.col("max_drawdown"), F.lit(0.25)
    )
    return views.catalog(spark, sf_dir).select("product_id", r(score).alias("score"))


@query
def catalog_listing(spark, sf_dir):
    return catalog.catalog_listing(views.catalog(spark, sf_dir))


@query
def catalog_tags(spark, sf_dir):
    tags = catalog.catalog_tags(views.catalog(spark, sf_dir))
    return tags.select(
        "product_id",
        F.array_join("tags", "|").alias("tags"),
        F.array_join("shown_tags", "|").alias("shown_tags"),
    )


@query
def catalog_reload(spark, sf_dir):
    """Replace the stored catalogue twice, then count what is there."""
    tables = Tables(spark, session.fresh_dir(spark, "catalog"))
    products = views.catalog(spark, sf_dir)
    tables.replace("products", products)
    tables.replace("products", products)
    stored = tables.read("products")
    return stored.groupBy("risk_rating").agg(F.count(F.lit(1)).alias("products"))


@query
def table_inventory(spark, sf_dir):
    """Columns and rows of all tables, with cleaned posts and the catalogue stored and the others absent."""
    tables = Tables(spark, session.fresh_dir(spark, "inventory"))
    posts = views.posts(spark, sf_dir)
    tables.append("posts_clean", status.clean_batch(status.pending_by_status(posts), AS_OF), 0)
    tables.replace("products", views.catalog(spark, sf_dir))
    counted = []
    for name in ("raw_data", "user_sentiment", "risk_profile", "products", "posts_clean", "posts_scored"):
        if name in LAYOUT:
            rows = tables.stored(name)
        else:
            rows = tables.appended(name) if name.startswith("posts_") else tables.read(name)
        columns = F.lit(len(TABLES[name].fields)).alias("columns")
        counted.append(rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), columns, "rows"))
    return reduce(DataFrame.unionByName, counted)


@query
def catalog_defaults(spark, sf_dir):
    key = F.col("product_id")
    holes = views.catalog(spark, sf_dir).select(
        "product_id",
        F.when(key % 5 != 0, F.col("max_drawdown")).alias("max_drawdown"),
        F.when(key % 11 != 0, F.col("sharpe_ratio")).alias("sharpe_ratio"),
    )
    return rounded(constraints.with_defaults(holes, constraints.product_defaults()), "max_drawdown")


# --- history ---------------------------------------------------------------------------


@query
def user_history_10(spark, sf_dir):
    return history.user_history(views.posts(spark, sf_dir, by_day=False))


@query
def user_trend_10(spark, sf_dir):
    return history.user_trend(views.sentiment(views.posts(spark, sf_dir, by_day=False)))


@query
def user_series(spark, sf_dir):
    """Posts older than the retention are gone, their sentiment rows are not."""
    posts = views.posts(spark, sf_dir)
    return history.user_series(retention.prune_posts(posts, AS_OF), views.sentiment(posts))


# --- upserts, retention, constraints -----------------------------------------------------


def _recrawl(posts: DataFrame) -> DataFrame:
    """A second crawl: every third post twice with later times, and as many new ones."""
    again = posts.where(F.col("id") % 3 == 0).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    later = F.make_dt_interval(F.lit(0), F.col("n"))
    again = again.select(
        (F.col("id") + F.col("n") * 1_000_000_000).alias("id"),
        F.when(F.col("id") % 2 == 0, F.col("source_post_id"))
        .otherwise(F.concat(F.lit("new-"), "source_post_id"))
        .alias("source_post_id"),
        "user_id",
        F.concat("topic", F.lit("-"), F.col("n").cast("string")).alias("topic"),
        "sentiment_score",
        (F.col("post_time") + later).alias("post_time"),
        "create_time",
        (F.col("update_time") + later).alias("update_time"),
        F.col("n").alias("seq"),
    )
    return again


UPSERT_COLUMNS = [
    "id", "source_post_id", "user_id", "topic", "sentiment_score", "post_time", "create_time",
    "update_time",
]


@query
def upsert_posts(spark, sf_dir):
    posts = views.posts(spark, sf_dir)
    return upsert.upsert_posts(posts.select(*UPSERT_COLUMNS), _recrawl(posts))


@query
def upsert_sentiment(spark, sf_dir):
    stored = views.sentiment(views.posts(spark, sf_dir))
    again = stored.where(F.col("raw_data_id") % 4 == 0).withColumn(
        "seq", F.explode(F.array(F.lit(1), F.lit(2)))
    )
    shift = F.col("seq") * 1_000_000_000
    again = again.select(
        (F.col("id") + shift).alias("id"),
        F.when(F.col("raw_data_id") % 8 == 0, F.col("raw_data_id"))
        .otherwise(F.col("raw_data_id") + 1_000_000_000)
        .alias("raw_data_id"),
        "user_id",
        "clean_content",
        (F.lit(1.0) - F.col("sentiment_score") / F.col("seq")).alias("sentiment_score"),
        "sentiment_label",
        F.lit(AS_OF).cast("timestamp_ntz").alias("analyze_time"),
        "seq",
    )
    return rounded(upsert.upsert_sentiment(stored, again), "sentiment_score")


@query
def upsert_profiles(spark, sf_dir):
    """Profiles up to the cutoff, then those of the posts after it."""
    posts = views.posts(spark, sf_dir, by_day=False)
    cut = ntz(retention.cutoff(AS_OF))
    old = profile.risk_profiles(posts.where(F.col("post_time") < cut)).withColumn(
        "update_time", cut
    )
    new = profile.risk_profiles(posts.where(F.col("post_time") >= cut)).withColumn(
        "update_time", ntz(AS_OF)
    )
    return rounded(upsert.upsert_profiles(old, new), "avg_sentiment", "volatility")


@query
def prune_posts(spark, sf_dir):
    posts = views.posts(spark, sf_dir).select("id", "source_post_id", "create_time")
    return retention.prune_posts(posts, AS_OF)


@query
def prune_summary(spark, sf_dir):
    return retention.prune_summary(views.posts(spark, sf_dir), AS_OF)


@query
def purge_dirty_ids(spark, sf_dir):
    return retention.purge_dirty_ids(views.posts(spark, sf_dir)).select("id", "source_post_id")


@query
def dirty_summary(spark, sf_dir):
    return retention.dirty_summary(views.posts(spark, sf_dir))


@query
def dirty_sample(spark, sf_dir):
    return retention.dirty_sample(views.posts(spark, sf_dir))


@query
def constraint_violations(spark, sf_dir):
    """Posts with repeated ids, scores without a post, and missing values."""
    posts = views.posts(spark, sf_dir)
    doubled = posts.withColumn(
        "source_post_id",
        F.when(F.col("id") % 10 == 0, F.lit("00000000")).otherwise(F.col("source_post_id")),
    )
    scores = views.sentiment(posts).withColumn(
        "raw_data_id",
        F.when(F.col("id") % 9 == 0, F.lit(-1)).otherwise(F.col("raw_data_id")),
    )
    return constraints.violation_report(
        constraints.unique_violations(doubled, "source_post_id", "raw_data.source_post_id unique"),
        constraints.unique_violations(scores, "raw_data_id", "user_sentiment.raw_data_id unique"),
        constraints.orphan_violations(
            scores, "raw_data_id", posts, "id", "user_sentiment.raw_data_id exists"
        ),
        constraints.null_violations(
            posts, ["user_id", "clean_content", "sentiment_score"], "raw_data"
        ),
    )


@query
def constraint_report(spark, sf_dir):
    """All unique keys and required columns of the four tables, with faults put into each table."""

    def spoilt(df, column, number, by, value):
        return df.withColumn(column, F.when(F.col(number) % by == 0, F.lit(value)).otherwise(F.col(column)))

    posts = views.posts(spark, sf_dir)
    scores = spoilt(views.sentiment(posts), "sentiment_label", "raw_data_id", 13, None)
    profiles = profile.risk_profiles(posts).withColumn("risk_level", F.when(F.col("post_count") != 3, F.col("risk_level")))
    return constraints.table_violations(
        {
            "raw_data": spoilt(spoilt(posts, "source_post_id", "id", 10, "00000000"), "user_id", "id", 11, None),
            "user_sentiment": spoilt(scores, "raw_data_id", "raw_data_id", 9, -1),
            "risk_profile": spoilt(profiles, "user_id", "post_count", 5, "twice"),
            "products": spoilt(views.catalog(spark, sf_dir), "product_name", "product_id", 7, "same name"),
        }
    )


@query
def restamped_posts(spark, sf_dir):
    """Update time moved where a post changed."""
    posts = views.posts(spark, sf_dir).select("id", "update_time", "process_status")
    return constraints.restamped(posts, F.col("process_status") == 0, AS_OF)


# --- pages -----------------------------------------------------------------------------


@query
def page_scan(spark, sf_dir):
    real = views.real_pages(spark, sf_dir)
    return real.select("page_id", "url", F.length("html").alias("chars"))


@query
def page_backfill(spark, sf_dir):
    """A backfill from page 1 to the middle of what has landed."""
    landed = views.real_pages(spark, sf_dir)
    middle = landed.agg((F.max("page_id") / 2).alias("m")).scalar()
    return pages.page_range(landed, 1, middle).select("page_id", "url")


@query
def page_links(spark, sf_dir):
    return pages.page_links(views.real_pages(spark, sf_dir))


@query
def parse_post_times(spark, sf_dir):
    texts = views.time_texts(spark, sf_dir)
    return texts.select(
        "event_id", parse_post_time(F.col("time_text"), ntz(AS_OF)).alias("post_time")
    )


@query
def visible_times(spark, sf_dir):
    texts = views.time_texts(spark, sf_dir)
    return texts.select("event_id", visible_time(F.col("time_text")).alias("found"))


@query
def page_posts(spark, sf_dir):
    found = pages.page_posts(views.list_pages(spark, sf_dir), AS_OF)
    return found.drop("pos")


@query
def ingest_counters(spark, sf_dir):
    landed = views.list_pages(spark, sf_dir)
    return pages.ingest_counters(landed, pages.page_posts(landed, AS_OF))


# --- streams ---------------------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = views.table(spark, sf_dir, "events").schema
    return jobs.file_stream(spark, sf_dir, schema, only="events.parquet")


def _landed_stream(spark, df: DataFrame, by: str, files: int = 3) -> DataFrame:
    """The rows of ``df`` landed as a few files that stream in one by one."""
    path = session.fresh_dir(spark, "landed")
    df.repartitionByRange(files, by).write.parquet(path)
    return jobs.file_stream(spark, path, df.schema, per_batch=1)


@query
def stream_hourly(spark, sf_dir):
    out = session.fresh_dir(spark, "stream-hourly")
    stream = jobs.hourly_stream(views.posts_from(_event_stream(spark, sf_dir)))
    jobs.run_to_files(stream, out)
    return rounded(spark.read.schema(stream.schema).parquet(out), "avg_score")


@query
def stream_dedup(spark, sf_dir):
    """Every post polled twice."""
    out = session.fresh_dir(spark, "stream-dedup")
    posts = views.posts_from(_event_stream(spark, sf_dir)).select("id", "source_post_id", "post_time")
    polled = posts.withColumn("_poll", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_poll")
    stream = jobs.dedup_stream(polled)
    jobs.run_to_files(stream, out)
    return spark.read.schema(stream.schema).parquet(out)


def _cleaned_rounds(spark, sf_dir) -> str:
    """Posts landed as three files and cleaned as they come; the folder of the clean ones."""
    out = session.fresh_dir(spark, "stream-clean")
    posts = views.posts(spark, sf_dir).select("id", "source_post_id", "user_id", "content")
    rounds.clean_landed(spark, _landed_stream(spark, posts, "id"), out, AS_OF)
    return out


@query
def stream_clean(spark, sf_dir):
    return spark.read.schema(rounds.CLEANED).parquet(_cleaned_rounds(spark, sf_dir))


@query
def stream_score(spark, sf_dir):
    """The second stream of the chain: it reads what the first has finished."""

    def by_words(posts):
        return scorer.score_with_lexicon(posts, ["purchase", "error"], ["view", "signup"])

    cleaned, out = _cleaned_rounds(spark, sf_dir), session.fresh_dir(spark, "stream-score")
    return rounded(rounds.score_cleaned(spark, cleaned, out, by_words, AS_OF), "sentiment_score")


@query
def stream_hourly_all(spark, sf_dir):
    """Posts in an order that has nothing to do with their time; every one counts."""
    root = session.fresh_dir(spark, "stream-hourly-all")
    tables = Tables(spark, root)
    posts = views.posts(spark, sf_dir).select("id", "post_time", "sentiment_score", F.hash("id").alias("order"))
    rounds.hourly_sums_stream(_landed_stream(spark, posts, "order"), tables, f"{root}-checkpoint")
    return rounded(rounds.hourly_from_sums(tables.appended("hourly_sums")), "avg_score")


@query
def stream_profiles(spark, sf_dir):
    root = session.fresh_dir(spark, "stream-profiles")
    tables = Tables(spark, root)
    events = _landed_stream(spark, views.table(spark, sf_dir, "events"), "event_id")
    rounds.user_stats_stream(views.posts_from(events), tables, f"{root}-checkpoint")
    stats = rounds.latest_stats(tables.appended("user_stats_changed"))
    return rounded(jobs.profiles_from_stats(stats), "avg_sentiment", "volatility")


@query
def stream_ingest(spark, sf_dir):
    root = session.fresh_dir(spark, "stream-ingest")
    tables = Tables(spark, root)
    landed = _landed_stream(spark, views.list_pages(spark, sf_dir), "page_id", files=2)
    jobs.ingest_stream(landed, tables, AS_OF, f"{root}-checkpoint")
    return tables.posts().select(
        "id", "source_post_id", "user_id", "content", "post_time", "create_time", "process_status"
    )


@query
def stream_counters(spark, sf_dir):
    """The counters of the same ingest, micro-batch by micro-batch."""
    root = session.fresh_dir(spark, "stream-counters")
    tables = Tables(spark, root)
    landed = _landed_stream(spark, views.list_pages(spark, sf_dir), "page_id", files=3)
    jobs.ingest_stream(landed, tables, AS_OF, f"{root}-checkpoint")
    return jobs.stream_counters(tables)


@query
def stream_correction(spark, sf_dir):
    """Every seventh post turns out to be two hours younger."""
    root = session.fresh_dir(spark, "stream-correction")
    tables = Tables(spark, root)
    posts = views.posts(spark, sf_dir).select(*UPSERT_COLUMNS)
    tables.replace("posts", posts, 0)
    start = trend.hourly_sentiment(tables.read("posts"), digits=None)
    tables.replace("hourly", start, 0)
    late = posts.where(F.col("id") % 7 == 0).select(
        *[c for c in UPSERT_COLUMNS if c != "post_time"],
        (F.col("post_time") + F.expr("interval 2 hours")).alias("post_time"),
        F.lit(1).alias("seq"),
    )
    stream = _landed_stream(spark, late, "id", files=2)
    jobs.correction_stream(stream, tables, f"{root}-checkpoint")
    return rounded(tables.read("hourly"), "avg_score")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per risk level."""
    return REGISTRY["risk_distribution"](spark, sf_dir)


