"""Small tables that every operator has to stand."""

BIG = 2**53 + 1
DOCS = "doc_id long, text string, lang string, source string, line string, kept string, node long"


def docs_of(spark, texts, langs=None):
    """Texts as documents 0, 1, ..., with extra columns of clashing names."""
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame(
        [(i, t, lang, "s", "x", "y", 1) for i, (t, lang) in enumerate(zip(texts, langs))], DOCS
    )


def awkward(spark):
    """Nulls in every column, an id that no double holds, empty and long texts, long runs, ties and repeated rows."""
    rows = [
        (1, None, None, None, None, None, None), (None, "one two three four five six", None, None, None, None, None),
        (2, "", "en", "s", "x", "y", 1), (3, "a\n" * 30_000, "en", "s", "x", "y", 1),
        (4, "same words here in both rows\n\ntail", "en", "s", "x", "y", 1),
        (4, "same words here in both rows\n\ntail", "en", "s", "x", "y", 1),
        (5, " \t\n", "fr", "s", "x", "y", 1), (6, "Ünïcode ß 文字 été 👍🏽", "fr", "s", "x", "y", 1),
        (7, "z" * 200_000, "de", "s", "x", "y", 1), (BIG, "one two three four five six", "en", "s", "x", "y", 1),
        (8, " " * 1_000_000, "en", "s", "x", "y", 1), (9, "a" + "\n" * 1_000_000 + "b", "en", "s", "x", "y", 1),
        (10, "again " * 100_000, "en", "s", "x", "y", 1),
    ]
    return spark.createDataFrame(rows, DOCS)
