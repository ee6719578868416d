import pytest

CLASHING = ("chunk", "words", "row", "owner", "part", "fp", "key", "hash", "sig", "label", "n", "order", "value", "_key", "_live", "live", "rows")
LONG = "lorem ipsum 12 " * 30_000


def documents(spark, rows):
    """(doc_id, text, lang, source) rows as documents, with extra columns of clashing names."""
    df = spark.createDataFrame(
        [(*r, None if r[1] is None else len(r[1])) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING]).repartition(3)


EDGES = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, LONG, "en", "a"),
    (5, "same text here", "en", "b"), (5, "same text here", "en", "b"), (None, "an id is missing", "fr", None),
    (6, "same text here", "en", "c"), (7, "Ünïcödé 𝒳𝒴 ﬁ x", None, "a"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return documents(spark, EDGES).cache()
