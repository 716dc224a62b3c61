import pytest

#: Texts that every operator must bear: null, empty, blank, repeated, very long runs and odd characters.
ODD = [None, "", " \n\t\r\x0b\x0c ", "a", "é 😀\x00 ß", "x" * 50_000, "1 " * 8_000, "\n" * 500, "a@" * 3_000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, repeated rows, and columns that clash with inner names."""
    rows = [(i, t, "en", "s", 0, i, "k") for i, t in enumerate(ODD)]
    rows += [(100, "same words here again", None, None, None, None, None), (100, "same words here again", None, None, None, None, None)]
    rows += [(None, "no id at all", "en", None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, chunk string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
