"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import (
    collocations, decontaminate, exact_dedup, language, lexical, line_dedup, minhash, packing, page_text, sharding, tokens,
    url_filter, warc,
)
from moodtide.llm.frames import table

URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=1000)
    found = warc.read_archives(manifest, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Labelled outcomes by number: bad is what is toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = page_outcomes(table(spark, sf_dir, "labels"))
    found = url_filter.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES, max_bad=0.25)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.line_tokens(table(spark, sf_dir, "documents"), tokens.Tokenizer(spark))


def packed(docs: DataFrame) -> DataFrame:
    tokenizer = tokens.Tokenizer(docs.sparkSession)
    lengths = docs.select("doc_id", tokens.count_tokens(F.col("text").cast("string"), tokenizer).alias("n_tokens"))
    return packing.best_fit(lengths)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, share=80, first=2000)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_decontaminate, op3_language, op4_near_dedup, op5_exact_dedup, op6_warc,
        op7_shards, op8_url_filter, op9_token_counts, op10_best_fit_packing, op11_lexical_search, op12_page_text,
        op13_collocations,
    )
}
