import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tk string, _tk string, size string, words string, key string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old oak near our quiet river and nobody speaks"


def _row(i, text, source="a"):
    return (i, text, "en", source, len(text or ""), "x", "y", "z", "s", "w", "k")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in all columns, empty and blank and very long texts, repeated rows, an id with two texts, clashing column names."""
    long_text = " ".join(f"w{k * 7919 % 5003}" for k in range(60_000))
    rows = [
        _row(1, PROSE), _row(2, PROSE), _row(2, PROSE), _row(3, PROSE + " today"), _row(4, None), _row(5, ""), _row(6, " \n\t "), _row(7, "two words"),
        _row(None, "a text without an id that has some words in it to be kept here"), _row(8, "first text of the id eight with enough words to be kept"), _row(8, "second and other text of that same id eight, also long enough"),
        _row(9, long_text, None), _row(10, "Ünïcödé straße ТЕКСТ 文字 " * 3, "b"), (None,) * 11, (None,) * 11,
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
