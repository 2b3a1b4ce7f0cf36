import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text[, source[, lang]]) rows."""

    def make(rows):
        rows = [(*r, *("src0", "en")[len(r) - 2 :]) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")

    return make


@pytest.fixture
def stored(tmp_path):
    """A folder with tables, for queries that read (spark, sf_dir)."""

    def make(**tables):
        for name, frame in tables.items():
            frame.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make
