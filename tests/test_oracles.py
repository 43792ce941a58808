"""Every query with an oracle, against DuckDB on the same tables."""

import __spark_entry__ as entry
import pytest
from loomwell.plans.registry import ORACLES, QUERIES

from .oracle import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    got, want = spark_rows(QUERIES[name](spark, SF)), duck_rows(ORACLES[name], SF)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: (-r.score, r.slug))


def test_contract_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
