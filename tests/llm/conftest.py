import pytest

#: Extra columns with the names that operators use inside.
HARD = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, h long, n long, body string, tie long"


@pytest.fixture
def hard(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"w{i * i % 7919}" for i in range(40_000))
    rows = [(1, "one two three four five six seven"), (2, "One two  three four five six seven"), (3, None), (4, ""), (5, "   \n\n "), (6, long), (7, long), (8, "x"), (8, "x"), (None, "one two three four five six seven"), (None, None)]
    return spark.createDataFrame([(i, t, None, "s" if (i or 0) % 2 else None, None, "a", None, 1, None, "b", 2) for i, t in rows], HARD)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], HARD)
