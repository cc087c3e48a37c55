"""Every registered query against its SQL twin on the smallest data folder."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from remap import parity
from tests.compare import compare, open_duckdb

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return open_duckdb(SF_DIR)


def test_every_query_has_a_twin():
    assert set(parity.queries()) == set(parity.oracle_sql()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(parity.queries()))
def test_parity(spark, con, name):
    assert compare(spark, con, name, SF_DIR) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and df.columns[0] == "id"
