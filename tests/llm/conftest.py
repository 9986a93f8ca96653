import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from texts; ids are positions unless given, other columns null."""

    def make(texts, ids=None, langs=None, sources=None, parts=3):
        n = len(texts)
        ids, langs, sources = ids or list(range(n)), langs or [None] * n, sources or [None] * n
        rows = [(i, t, a, s, None if t is None else len(t)) for i, t, a, s in zip(ids, texts, langs, sources)]
        return spark.createDataFrame(rows, DOC).repartition(parts)

    return make


@pytest.fixture
def store(tmp_path):
    """A folder with a documents table, as queries read it."""

    def write(df, **others):
        for name, t in {"documents": df, **others}.items():
            t.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
