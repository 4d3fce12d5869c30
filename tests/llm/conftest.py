import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text[, lang, source]) rows, with columns whose
    names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, keep_id string, size string, n string, copies string"

    def of(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), "x", "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, schema)

    return of


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, null ids and metadata."""
    long = "alpha beta gamma delta " * 20000
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (5, long), (6, long + " "), (None, "word two"),
            (7, "Ünï ćødé 日本語 \U0001F600 text", None, None), (8, "a b c a b c a b c", "fr", None), (9, "x" * 100_000)]
