import pytest


@pytest.fixture
def texts(spark):
    """Frame of (doc_id, text) with extra columns whose names clash with internal ones."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string")
        return df.selectExpr("*", "1 as uid", "'x' as ids", "2 as label", "3 as dc_w", "4 as qr_n_words") if extra else df
    return make


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one two"), (5, "one two"), (None, "one two three four five six"),
        (7, "one two three four five six")]


@pytest.fixture
def edge_rows():
    return list(EDGE)
