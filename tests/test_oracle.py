"""Every registered query against its SQL twin on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from workload import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return f"decimal {value}" if isinstance(value, decimal.Decimal) else repr(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    have = sorted(tuple(_key(r[c]) for c in columns) for r in df.collect())
    twin = duck.sql(entry_points.oracle_sql()[name])
    assert sorted(twin.columns) == columns
    places = [twin.columns.index(c) for c in columns]
    want = sorted(tuple(_key(r[i]) for i in places) for r in twin.fetchall())
    assert have == want


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
