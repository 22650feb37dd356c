import pytest


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def docs(spark):
    """Texts to a documents table with a few more columns whose names clash with inner ones."""
    def make(texts, ids=None, partitions=3):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", f"s{k % 2}", 1, "x", "y") for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, body string, runs string").repartition(partitions)
    return make
