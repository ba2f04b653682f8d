"""The registered queries of the operators on the smallest tables, against their SQL where there is any."""

import pytest

from __spark_entry__ import oracle_sql, queries
from check import compare, connect
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    ok, note = compare(connect(data), QUERIES[name](spark, data), ORACLES.get(name))
    assert ok, note


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_rules_read_a_stored_ledger(spark, data):
    for name in ("op3_quality_rules", "op3_rule_ablation"):
        files = QUERIES[name](spark, data).inputFiles()
        assert files and all("quality-ledger" in f for f in files), name
