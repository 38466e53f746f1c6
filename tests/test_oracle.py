"""Every registered key against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""

import pytest

from __spark_entry__ import oracle_sql, queries
from docdrift.plans import catalog
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_key_has_an_oracle():
    assert set(catalog.QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_key_matches_oracle(spark, con, key):
    r = compare(spark, con, SF, key, queries(), oracle_sql())
    assert r["rows_match"] and r["cols_match"] and r["hash_match"], r


def test_entry_runs(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() >= 0
    assert "change" in df.columns
