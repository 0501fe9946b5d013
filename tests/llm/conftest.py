import os

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not there")
    return SF_DIR


@pytest.fixture
def documents(spark):
    """Rows as in ``documents``, with a column whose name clashes with those the operators use."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, comp string")

    return make
