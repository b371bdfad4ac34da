"""Every registered query against its oracle SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from workload import check

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

# Queries whose answer over the smallest tables is empty.
EMPTY = {"snapshot_pick"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, detail = check.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok or (name in EMPTY and detail.startswith("0 rows,") and "no oracle" not in detail), detail


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
