"""A few registered queries against DuckDB at the smallest scale; ``oracle.py`` runs them all."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from linkloom.plans.catalog import QUERIES
from linkloom.plans.oracle import ORACLE
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ["normalize_phone", "custody_verify", "entity_links_calls", "mail_links",
                                  "csv_call_rows", "risk_flagged_peer", "extract_identifiers", "hash_sync"])
def test_query(spark, con, name):
    rows, difference = compare(spark, con, SF, name, queries()[name], oracle_sql()[name])
    assert difference is None
    assert rows > 0


def test_every_query_has_a_statement():
    """Queries of the library itself all have one; each statement belongs to a registered query."""
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["case_id", "entity_id"] and df.count() > 0
