import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Rows of a documents-like table, with extra columns whose names clash with results."""
    def make(rows, extra=True):
        df = spark.createDataFrame(
            [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], DOCS)
        if extra:
            for c in ("_row", "fp", "key", "n_words", "score", "lang_pred", "bits", "host", "spans", "u"):
                df = df.selectExpr("*", f"'clash' as {c}")
        return df
    return make


@pytest.fixture
def table_dir(spark, tmp_path):
    """A folder of Parquet tables, as the queries read them."""
    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return put
