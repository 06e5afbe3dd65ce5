"""Every query against its SQL twin on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from chatterlens.plans import registry
from parity import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_core_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.SQL) == set(registry.QUERIES) & set(entry.oracle_sql())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[0] == "program_id" and result.count() > 0


# Few events at this scale: no sentiment anomaly, no neutral row in the last hour.
MAY_BE_EMPTY = {"anomalies_sentiment", "range_label_filter"}


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_parity(spark, con, name):
    problems = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert problems == []
