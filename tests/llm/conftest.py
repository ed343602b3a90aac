import pytest

HARD_TEXTS = [
    None, "", " ", "\n\t ", "word", "Mixed CASE words, and ünïcödé 梦 😀.", "a  b   c \n\n d\t e", "x" * 20_000, "long tail " * 3000,
    "same text for many rows of the table " * 4, "same text for many rows of the table " * 4,
    'token = "0123456789abcdef0123456789abcdef01234567" and more words', "Released under the MIT License.", " leading and trailing ",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and repeated ids."""
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(HARD_TEXTS)]
    rows += [rows[4], rows[4], (7, "another text with the id of a long one", "de", "src1", 40), (None, "no id here", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
