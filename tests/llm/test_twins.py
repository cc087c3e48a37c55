"""Queries against their SQL, and the outputs of those without SQL."""

from __future__ import annotations

import os

import pytest

from remap.llm.queries import oracle_sql, queries
from tests.compare import compare, open_duckdb

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, name):
    assert compare(spark, open_duckdb(SF_DIR), name, SF_DIR) is None


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 14))
