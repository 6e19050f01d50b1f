import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, or from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows, extra=True):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((r[0], r[1], None, r[2] if len(r) > 2 else "s", None))
        df = spark.createDataFrame(full, DOC)
        if extra:  # names that operators use inside
            for name in ("rank", "length", "c", "c64", "n", "row_key", "label", "size", "piece",
                         "base", "kept", "rule", "n_words", "lines", "copies", "block"):
                if name not in df.columns:
                    df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def rows_of():
    def make(df):
        return [r.asDict() for r in df.collect()]

    return make
