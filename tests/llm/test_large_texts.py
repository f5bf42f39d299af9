"""Texts are large, so they are not sorted to meet the little that is known about them."""

from moodtide.llm import line_dedup


def test_texts_meet_their_dropped_lines_without_a_sort(spark):
    texts = [(1, "Same\nown a\n\nsame "), (2, "same\nown b"), (2, "same\nown b"), (3, None), (4, "own c"), (None, "SAME\nx")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        kept = line_dedup.dedup_lines(docs, min_docs=3)
        got = sorted((r[0] or 0, *r[1:]) for r in kept.collect())
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    assert got == [
        (0, 2, 1, "x"), (1, 4, 2, "own a\n"), (2, 2, 1, "own b"), (2, 2, 1, "own b"), (3, 1, 0, ""), (4, 1, 0, "own c"),
    ]
    final = plan.split("== Initial Plan ==")[0]
    assert "ShuffledHashJoin" in final and "SortMergeJoin" not in final.split("ShuffledHashJoin")[0]
