import pytest


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """A table of documents with awkward rows and clashing extra columns."""
    def make(texts, ids=None):
        ids = list(range(1, len(texts) + 1)) if ids is None else ids
        data = [(i, t, "en", "s", len(t or ""), "x", 7, "y") for i, t in zip(ids, texts)]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "kept string, component_id long, digest string")
    return make
