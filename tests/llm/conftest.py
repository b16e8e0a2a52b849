import pytest


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def documents(spark):
    """A function that makes a documents table, with extra columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, n long, component string")

    return make
