"""Every registered query against its DuckDB oracle (rows-only where no SQL exists)."""

import os

import pytest

import __spark_entry__ as E
from parity import compare, duck

SF = os.environ.get("RISKPANEL_TEST_SF", "/root/testdata/sf0.001")
#: The library's own queries; those of the training-data subpackage have tests of their own.
QUERIES = {name: q for name, q in E.queries().items() if name in E._registry()}
SQL = {name: q for name, q in E.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert res["ok"], res


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0
    assert len(df.columns) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 600
    assert set(df.columns) == {"score_name", "i", "threshold", "accepted", "accept_pct", "mean_measure"}


def test_every_key_has_inventory_ids():
    from riskpanel.plans.registry import REGISTRY
    for q in REGISTRY.values():
        assert q.ids.strip(), q.name
