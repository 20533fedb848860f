import pytest

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from here " * 12),
    (2, "the quick brown fox jumps over the lazy dog and runs away from here " * 12),
    (2, "the quick brown fox jumps over the lazy dog and runs away from here " * 12),
    (3, None), (4, ""), (5, " \n\t "), (6, "Zu viele Wörter für ein Ding, das niemand kennt: +1 (988) 555-2485"), (7, "x" * 3000), (8, "a b c " * 400), (None, "nobody's text"), (9, "\U0001f600 ‮ \x00 é"),
]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of small tables with nulls, repeats, long texts and clashing extra columns; and one of empty tables."""
    top = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame([(i, t, "en" if i != 6 else "de", "s", 0, "k", 1, "b") for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long, key string, h long, bands string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 0, 1), (5, None, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away from here"), (2, "das niemand kennt"), (3, None), (4, "!!")], "item_id long, text string")
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<article><p>One &amp; two words of a text that goes on, and on.</p><p>More of it, as is usual."), (4, "u", "<<<p class='>")], "page_id long, url string, html string")
    talks = spark.createDataFrame([(0, 0, "user", "a b"), (0, 1, "bot", None), (3, None, None, "c"), (3, 1, "user", "a b"), (3, 1, "user", "a b"), (None, 0, "user", "x"), (21, 0, "user", "long " * 20_000)], "conv_id long, turn long, role string, text string")
    talks = talks.selectExpr("*", "'k' AS key", "1 AS depth", "2 AS n_convs")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items), ("pages", pages), ("conversations", talks)):
        df.write.parquet(f"{top}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{top}/none/{name}.parquet")
    return top
