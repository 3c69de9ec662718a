import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, fp double, label string, part string, root string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and blank texts, repeated rows, a very long text, columns that clash with inner names."""
    extra = ("x", 1, 0.5, "l", "p", "r")
    long = " ".join(f"wort{i} alpha" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 10, *extra),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 10, *extra),
        (2, None, "en", "b", 0, *extra),
        (3, "", None, None, None, *extra),
        (4, " \n\t\n ", "de", "b", 4, *extra),
        (None, "one two three four five six seven eight nine ten eleven", "en", None, 3, *extra),
        (None, None, None, None, None, None, None, None, None, None, None),
        (5, long, "en", "c", len(long), *extra),
        (6, "Ärger über Öl\nÄrger über Öl", "de", "c", 20, *extra),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
