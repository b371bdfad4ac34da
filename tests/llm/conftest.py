import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of documents from texts or (doc_id, text) pairs."""

    def make(texts, partitions=3):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        full = [(d, t, "en", f"src{(d or 0) % 3}", len(t or "")) for d, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
