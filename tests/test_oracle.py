"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from check import compare
from corpusweave.plans.oracle import ORACLE_SQL
from corpusweave.plans.queries import QUERIES


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.oracle_sql().keys() >= ORACLE_SQL.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    got, want = compare(spark, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
