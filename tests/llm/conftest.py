import pytest

#: Awkward rows: nulls in every column, empty, blank and symbol texts, ties, repeated rows, other scripts.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69, True),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69, False),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69, False),
    (3, None, "en", "b", None, None), (4, "", None, "b", 0, True), (5, " \n\t ", "de", None, 4, True), (6, "--- !!! ---", None, None, 11, None),
    (7, "Grüße aus Köln, über die Straße\nGrüße aus Köln, über die Straße", "de", "b", 63, True), (None, "a text without an id", None, "c", 20, True),
    (None, None, None, None, None, None), (9, "word " * 3000, "en", "c", 15000, True), (10, "日本語の文 и русский текст 123 😀", None, "c", 20, True), (-5, "x", "en", "a", 1, True),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size boolean"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(folder):
    """(doc_id, text) of the smallest table."""
    import pyarrow.parquet as pq
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))
