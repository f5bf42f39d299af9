"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; one JSON line out.

Each query runs once to warm up and then BENCH_RUNS times (default 3); the median counts.
Results go to the no-op sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moodtide.plans.queries import REGISTRY  # noqa: E402
from moodtide.session import local_session  # noqa: E402

HEADLINE = [
    "clean_documents",
    "clean_pages",
    "lexicon_sentiment",
    "model_sentiment",
    "sentiment_score",
    "label_mapping",
    "status_counts",
    "risk_profiles",
    "risk_distribution",
    "global_sentiment",
    "hourly_sentiment",
    "trend_24h",
    "trend_24h_by_user",
    "trend_summary",
    "recommend_top3",
    "recommend_reason",
    "user_history_10",
    "user_trend_10",
    "user_series",
    "upsert_posts",
    "upsert_sentiment",
    "upsert_profiles",
    "prune_posts",
    "dirty_summary",
    "constraint_violations",
    "parse_post_times",
    "page_links",
    "page_posts",
    "stream_hourly",
    "stream_profiles",
]


def timed(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(
            statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 4
        )
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
