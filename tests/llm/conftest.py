import os

import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today"),
    (2, "the quick brown fox jumps over the lazy dog again and again today"),
    (3, None), (4, ""), (None, "a row without id that has enough words to count"), (5, "  \n\t "),
    (6, "long " * 30_000), (6, "long " * 30_000), (7, "naïve café ▁ 漢字 😀\n\nnext line"), (8, "one two"), (9, "One two"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, "en" if i != 4 else None, f"src{(i or 0) % 3}" if i != 5 else None, len(t or ""), 1, 2) for i, t in ROWS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size int, Score int"
    )


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    for d in ("/root/testdata/sf0.001", os.environ.get("BENCH_SF_DIR", "")):
        if os.path.isdir(d):
            return d
    pytest.skip("no test tables")
