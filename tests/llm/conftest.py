import pytest

pytest.importorskip("tradelanes.llm")

from tradelanes.llm.common import table  # noqa: E402

SMALL = "/root/testdata/sf0.001"

#: Missing values, empty and white texts, ties, repeated rows, a long text, and columns with the names operators use.
MESSY = [
    (1, "The quick brown fox jumps over the lazy dog.\nIt does so again.", "en", "a", 5, 7, "x"),
    (2, "The  quick brown fox\tjumps over the lazy dog.\nIt does so again.", "en", "a", 5, 7, "x"),
    (2, "The  quick brown fox\tjumps over the lazy dog.\nIt does so again.", "en", "a", 5, 7, "x"),
    (3, None, None, None, None, None, None),
    (4, "", "en", "b", 0, 1, "y"),
    (None, "only words without a number", "en", "b", 9, 1, "y"),
    (None, "only words without a number", "en", "b", 9, 1, "y"),
    (7, " \t\n ", "en", None, 4, 2, "z"),
    (8, "É voilà ß 你好 🙂🙂 x", "fr", "é", 12, 2, "z"),
    (9, "word " * 30_000, "en", "a", 150_000, 3, "w"),
    (9, "same number, other text", "en", "a", 20, 3, "w"),
    (10, "one", "en", "c", 3, 3, "w"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _size long, kept string"


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(MESSY, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, SMALL, "documents")


@pytest.fixture(scope="session")
def labels(spark):
    return table(spark, SMALL, "labels")
