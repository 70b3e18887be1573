import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Null and empty values, repeated rows, ties and odd characters.
ODD = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, "   \n\t ", "en", "a", 6), (4, "!!! 123", None, "a", 7), (5, "one", "en", "b", 3),
    (5, "one", "en", "b", 3), (6, "one two", "en", None, 7), (7, "日本語 текст ΣΑΣ", "xx", "c", 12), (None, "no id here at all", "en", "c", 17),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(ODD)], SCHEMA + ", size int, _part string")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def long_text():
    return "a long text of many words that goes on " * 40_000
