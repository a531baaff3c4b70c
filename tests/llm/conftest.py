import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def table(spark, tmp_path):
    """Write rows as a table of a new data folder; returns the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, score string, rep string"


@pytest.fixture
def docs(table):
    """Documents with two further columns whose names operators use themselves."""

    def write(pairs):
        return table("documents", [(i, t, "en", "s", len(t or ""), "x", None, None) for i, t in pairs], DOCS)

    return write
