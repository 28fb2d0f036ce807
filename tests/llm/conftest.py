import os

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

#: Columns that no operator may mind.
EXTRA = ["lang", "source", "n_chars", "hash", "key", "block", "score", "fp", "part", "tokens", "length"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) rows, with extra columns of names that operators use inside."""

    def make(rows, extra=EXTRA):
        schema = "doc_id long, text string" + "".join(f", `{name}` string" for name in extra)
        return spark.createDataFrame([(i, t, *("x" for _ in extra)) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
