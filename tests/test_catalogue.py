"""Registered queries against their SQL; `python tests/check.py 0.01` runs them all."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
SOME = [
    "read_csv_export", "read_excel_export", "row_lineage", "schema_rules", "derive_keys", "file_profile", "decide_mapping",
    "infer_date_order", "link_entities", "suppress_pending_dates", "dedupe_open", "rollback", "run_stats", "activity_stream",
]


def test_every_query_has_a_check():
    assert set(contract.catalogue.QUERIES) == set(contract.catalogue.CHECKS)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_matches_its_sql(spark, name):
    assert compare(contract.queries()[name](spark, SF), connect(SF), contract.oracle_sql()[name]) == ""


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "natural_key" and df.count() > 0
