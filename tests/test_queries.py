"""Every registered query with an oracle against it, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(SF_DIR)):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toArrow()
    assert compare(got, con.sql(entry.oracle_sql()[name]).to_arrow_table()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() == 14
