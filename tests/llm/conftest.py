import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Builds a table of documents from (doc_id, text, lang, source) rows, with an extra column or two."""

    def make(rows, **extra):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([tuple(r) + (None,) * (4 - len(r)) for r in rows], "doc_id long, text string, lang string, source string")
        df = df.withColumn("n_chars", F.length("text").cast("long"))
        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty, blank, very long, tied and repeated rows, and columns whose names clash with results."""
    long_text = " ".join(f"w{k % 977}x{k}" for k in range(40_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, long_text, "en", "b"), (5, "one two three", None, None),
        (6, "one two three", "en", "a"), (6, "one two three", "en", "a"), (None, "no id here at all but five words", "en", "b"), (7, "x" * 3000, "de", "c"),
        (8, "日本語 \U0001f937 café\x1c\u0085", "fr", "c"), (9, long_text, "en", "b"), (10, "the same five words over and over the same five words over and over", "en", "a"),
    ]
    return frame(rows, score=1, SCORE2=2, ids=3, copies=4, n_lines=5, component_id=6, target=7, key=8, line=9, leaf=10)
