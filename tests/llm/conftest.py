import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, source[, lang]]) rows, with columns
    whose names clash with the operators' own."""

    def build(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", r[3] if len(r) > 3 else "en") for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, source string, lang string")
        if extra:
            for name in ("id", "key", "line", "pos", "component", "dropped", "_text", "host", "kept", "ids", "label", "Score"):
                df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return build
