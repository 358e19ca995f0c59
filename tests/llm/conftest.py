import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a DataFrame over several partitions, so that no test depends on one."""
    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return make


@pytest.fixture(scope="session")
def docs(frame):
    """Documents from texts, with an extra column whose name operators use themselves."""
    def make(texts, **other):
        rows = [(i, t, other.get("lang", "en"), f"s{(i or 0) % 2}", len(t or ""), f"x{i}") for i, t in texts]
        return frame(rows, DOCS + ", id string")
    return make
