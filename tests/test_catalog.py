from __future__ import annotations

import glob
import os

import pytest
from check_oracles import compare, connect

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
CHECKED = sorted(n for n in contract.oracle_sql() if not n.startswith("op") and n != "pipeline")

pytestmark = pytest.mark.skipif(not glob.glob(f"{SF_DIR}/*.parquet"), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, con, name):
    assert compare(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name]) is None


def test_contract_is_consistent():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 90


def test_nothing_large_is_committed():
    root = os.path.dirname(SF_DIR and os.path.abspath(contract.__file__))
    assert not glob.glob(f"{root}/**/*.parquet", recursive=True)
