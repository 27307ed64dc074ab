import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in any column, empty and long texts, ties, repeats and columns that clash with internal names."""
    long_text = " ".join(f"Word{i % 97} und {i % 11}," for i in range(4000))
    rows = [
        (1, "Hello there, general text of some words", "en", "a", 10),
        (1, "Hello there, general text of some words", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, "   \n\t ", "de", None, 6),
        (None, "a row without an id", "en", "b", 19),
        (None, None, None, None, None),
        (5, long_text, "de", "b", len(long_text)),
        (6, "Hello there, general text of some words", "en", "c", 10),
        (7, "12345 ... !!!", "fr", "c", 13),
        (8, "x", "es", "c", 1),
    ]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, DOCS)
    clash = {c: F.lit(7) for c in ("size", "score", "fp", "unit", "n", "k", "component_id", "node", "root", "rate", "copies", "piece", "start", "length", "n_tokens", "part")}
    return docs.withColumns(clash)
