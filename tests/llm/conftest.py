import public_tokenizers
import pytest

from evalspark.llm import bpe, token_counts


@pytest.fixture(scope="session")
def vocabulary(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.load(spark, path, public_tokenizers.PATTERN)


@pytest.fixture(scope="session")
def merges(spark):
    return token_counts.load(spark, public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture
def documents(spark):
    """A table of (doc_id, text) with columns whose names clash with results."""

    def make(rows):
        schema = "doc_id bigint, text string, kept string, out string, n_tokens string, node int"
        full = [(k, t, "k", "o", "n", 1) for k, t in rows]
        return spark.createDataFrame(full, schema)

    return make
