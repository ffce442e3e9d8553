import pytest
from pyspark.sql import functions as F

from tokenloom.llm.common import ready


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Nulls in every column, empty and very long texts, repeated rows, and clashing extra columns."""
    long = " ".join(f"word{i % 700}" for i in range(60_000))
    passage = " ".join(f"shared{i}" for i in range(30))
    rows = [
        (1, "The first text is plain and short enough", "en", "a"),
        (2, "", "en", "a"),
        (3, None, "en", None),
        (4, " \t\n\x0b ", None, "b"),
        (5, long, "en", "b"),
        (6, long, "en", "b"),
        (7, passage + " tail", "en", "c"),
        (8, "head " + passage, "fr", "c"),
        (9, "12345 --- !!!", None, "c"),
        (10, "Ça va très bien\nune ligne assez longue pour compter\nfin", "fr", "é"),
        (10, "Ça va très bien\nune ligne assez longue pour compter\nfin", "fr", "é"),
        (None, "a row without an id and some words", None, None),
    ]
    df = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {n: F.lit("x") for n in ("size", "key", "row", "id", "doc", "h", "n", "score_", "fp", "_x")}
    return df.withColumns(extra)
