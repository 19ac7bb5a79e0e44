import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Rows of documents as a table of files: (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, extra=False, files=2):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that the operators use themselves
            df = df.selectExpr("*", "1 AS size", "'x' AS fp", "2 AS `key`", "'y' AS digest", "3 AS _row", "'z' AS score", "4 AS ids", "true AS kept")
        path = str(tmp_path_factory.mktemp("docs") / "t.parquet")
        df.repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make
