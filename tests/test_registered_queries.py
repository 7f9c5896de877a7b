"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", contract.QUERIES)
def test_query(spark, con, name):
    result = compare(spark, con, SF, name)
    assert result.startswith("ok"), result


def test_every_query_of_the_library_has_an_oracle():
    assert set(contract.QUERIES) == set(contract.ORACLES)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["block_id", "path", "hosts", "status"] and df.count() > 0
