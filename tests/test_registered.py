"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from tidemark.plans.registered import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    ok, note = compare(con, df, ORACLES.get(name))
    # At the smallest scale a filter may find nothing on both sides.
    assert ok or note == "0 rows", note


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_entry_runs(spark):
    rows = entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: (-r.score, r.event_id))
