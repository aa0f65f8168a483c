"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
import check_oracles  # noqa: E402
from tallyframe import oracles, queries  # noqa: E402

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check_oracles.tables(ROOT):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    text, _ = check_oracles.compare(spark, con, name, queries.QUERIES[name], oracles.oracle_sql()[name], ROOT)
    assert text.startswith("ok"), text


def test_flagship(spark):
    assert entry.entry(spark).columns[:2] == ["user_id", "total_income"]
