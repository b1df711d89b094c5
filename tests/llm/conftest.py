import pytest

TEXTS = [
    (1, "", "en"), (2, None, "en"), (3, "one", "en"), (4, "one", None), (None, "a b c d e f g h", "en"), (6, "a b c d e f g h", "fr"), (6, "a b c d e f g h", "fr"), (7, " \t\n", "xx"), (8, "É ñ ß " * 30, "de"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty texts, repeated rows, and additional columns with names that operators use."""
    rows = [(i, t, lang, "src", len(t or ""), *"xyz", 1, 2, "w", [3], "s") for i, t, lang in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _q string, chunk_id string, piece string, node long, row long, words string, tokens array<long>, label string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def texts(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
