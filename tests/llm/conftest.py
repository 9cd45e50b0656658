import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, repeated rows and ids, a very long text, and columns with clashing names."""
    long_text = " ".join(f"w{i % 977} q{i % 31}" for i in range(30_000))
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, None), (3, ""), (4, " \n\t "), (None, "lost id text"), (5, long_text),
            (6, "é" * 300), (7, "one line\none line\nanother line"), (8, "x")]
    return spark.createDataFrame([(k, t, "r", 0, "s", 1, 2, "z", 7, "c", [3]) for k, t in rows],
                                 "doc_id long, text string, row string, id int, score string, n int, fp long, __z string, __row long, "
                                 "c0 string, spans array<int>")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, id string")
