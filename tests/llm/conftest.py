import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns whose names clash with results."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards box with jolly quartz judges near the vast dark river bank"
    rows = [
        (1, base, "en", "a", 100, 9, "x"),
        (2, base, "en", "a", 100, 9, "x"),
        (2, base, "en", "a", 100, 9, "x"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 1, ""),
        (None, "some words without an id but with enough length to be a window of its own, certainly", "en", None, 5, 2, "y"),
        (5, "   \n\t ", "de", "b", 5, 3, "z"),
        (6, " ".join(f"long{i % 977}" for i in range(60_000)), "de", "b", 7, 4, "w"),
        (7, "é" * 80 + " ünïcode 漢字 😀 " + base, "fr", None, 8, 5, "v"),
        (8, "one two", "fr", "c", 7, 6, "u"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, length int, sequence_id string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
