"""Every registered query against its SQL on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from registry import all_registries
from registry.check import compare, connect

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

QUERIES = {name: q for r in all_registries() for name, q in r.queries.items()}
SQL = {name: sql for r in all_registries() for name, sql in r.sql.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, problem = compare(spark, con, SF_DIR, QUERIES[name], SQL[name])
    assert problem is None, problem
    assert rows > 0


def test_entry_lists_them_all():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
