import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts, with sources by place and extra columns with clashing names."""
    def make(texts, sources=None, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}" if sources is None else sources[i], None if t is None else len(t)) for i, t in enumerate(texts)]
        frame = spark.createDataFrame(rows, DOCUMENTS)
        for name in ("kept", "n", "node", "size", "spans", "label", "id", "row", "hash"):
            frame = frame.selectExpr("*", f"'x' as {name}")
        return frame

    return make
