import pytest
from pyspark.sql import functions as F

from tidemark.functions.json_text import struct_json
from tidemark.operators import filters
from tidemark.operators.filters import Clause, where

ROWS = """
SELECT * FROM VALUES
 ('orders', 0, 1L, 1000L, 'a', named_struct('status', 'paid', 'region', 'US_WEST', 'total', 100.0D, 'ok', true, 'code', '1', 'address', named_struct('city', 'Oslo'), 'items', array(named_struct('sku', 'x', 'qty', 1), named_struct('sku', 'y', 'qty', 5)))),
 ('orders', 0, 2L, 2000L, 'b', named_struct('status', 'paid', 'region', 'EU', 'total', 500.0D, 'ok', false, 'code', '2', 'address', named_struct('city', 'Rome'), 'items', array(named_struct('sku', 'z', 'qty', 2)))),
 ('clicks', 1, 3L, 3000L, NULL, named_struct('status', 'open', 'region', 'US_EAST', 'total', 500.5D, 'ok', true, 'code', '3', 'address', named_struct('city', 'Oslo'), 'items', array()))
AS t(topic, partition, offset, timestamp_ms, key, value)
"""


@pytest.fixture(params=["typed", "json"])
def events(request, spark):
    df = spark.sql(ROWS)
    return df if request.param == "typed" else df.select("*", struct_json(F.col("value")).alias("value_json")).drop("value")


def found(df):
    return sorted(r.offset for r in df.collect())


def test_clauses(events):
    assert found(where(events, clauses=[{"field": "status", "eq": "paid"}])) == [1, 2]
    assert found(where(events, clauses=[Clause("region", in_values=["US_WEST", "US_EAST"])])) == [1, 3]
    assert found(where(events, clauses=[Clause("total", gte=100, lte=500)])) == [1, 2]
    assert found(where(events, clauses=[Clause("value.address.city", eq="Oslo"), Clause("total", gte=200)])) == [3]
    assert found(where(events, clauses=[Clause("address.city", eq="Rome")])) == [2]
    assert found(where(events, clauses=[Clause("partition", eq=1)])) == [3]
    assert found(where(events, clauses=[Clause("ok", eq=True)])) == [1, 3]
    assert found(where(events, clauses=[Clause("nothing", eq="x")])) == []


def test_no_conversion_between_kinds(events):
    assert found(where(events, clauses=[Clause("code", eq=1)])) == []
    assert found(where(events, clauses=[Clause("code", eq="1")])) == [1]
    assert found(where(events, clauses=[Clause("total", eq="100.0")])) == []
    assert found(where(events, clauses=[Clause("ok", eq=1)])) == []
    assert found(where(events, clauses=[Clause("status", gte=0)])) == []


def test_any_element_of_an_array(spark):
    df = spark.sql(ROWS)
    assert found(where(df, clauses=[Clause("items.sku", eq="y")])) == [1]
    assert found(where(df, clauses=[Clause("items.qty", gte=2, lte=3)])) == [2]


def test_precedence(events):
    both = Clause("status", eq="open", in_values=["paid"])
    assert found(where(events, clauses=[both])) == [3]
    assert found(where(events, clauses=[Clause("total", in_values=[100.0], gte=400)])) == [1]


def test_clause_errors(events):
    with pytest.raises(ValueError):
        Clause("status")
    with pytest.raises(ValueError):
        where(events, clauses=[{"field": "a", "equals": 1}])
    with pytest.raises(ValueError):
        where(events, clauses=[Clause("a", eq=i) for i in range(11)])


def test_topics_and_allowlist(events):
    assert found(where(events, topic="clicks")) == [3]
    assert found(where(events, allowlist=["orders"])) == [1, 2]
    assert found(where(events, topic="clicks", allowlist=["orders"])) == []
    assert found(where(events)) == [1, 2, 3]


def test_lookback(events):
    now = 3000 + 120 * 60_000
    assert found(where(events, minutes=120, now_ms=now, max_minutes=120)) == [3]
    assert found(where(events, minutes=50_000, now_ms=now)) == [1, 2, 3]
    with pytest.raises(ValueError):
        where(events, minutes=10_000, now_ms=now, max_minutes=120)
    assert found(where(events, minutes=0, now_ms=2000 + 60_000)) == [2, 3]
    with pytest.raises(ValueError):
        where(events, minutes=5)


def test_lookback_reaches_the_scan(spark, data):
    from tidemark.sources import tables

    df = where(tables.events(spark, data), "click", 60, now_ms=1_706_659_200_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(ts" in pushed and "EqualTo(event_type,click)" in pushed


def test_membership_in_a_table(spark):
    df = spark.sql(ROWS)
    values = spark.createDataFrame([("EU",), ("EU",), ("LATAM",)], "v string")
    assert found(filters.where_in_table(df, "region", values)) == [2]


def test_names():
    assert [filters.resolve_name(n) for n in ("status", "topic", "timestamp_ms", "value.items.sku", "address.city")] == [
        "value.status", "topic", "timestamp_ms", "value.items.sku", "value.address.city"
    ]


def test_large_integers_and_decimals_compare_exactly(spark):
    big = 2**53
    rows = [(1, f'{{"n":{big}}}'), (2, f'{{"n":{big + 1}}}'), (3, '{"n":99.5}'), (4, '{"n":1e3}'), (5, '{"n":0.1}'), (6, '{"n":123456789012345678901234567890}'), (7, '{"n":"x"}')]
    df = spark.createDataFrame([("t", 0, o, 0, v) for o, v in rows], "topic string, partition int, offset long, timestamp_ms long, value_json string")
    hit = lambda **c: sorted(r.offset for r in where(df, clauses=[{"field": "n", **c}]).collect())
    assert hit(eq=big + 1) == [2] and hit(eq=big) == [1] and hit(in_values=[big, 99.5, 1000]) == [1, 3, 4]
    assert hit(eq=99) == [] and hit(eq=100) == [] and hit(eq=0.1) == [5]
    assert hit(gte=big + 1) == [2, 6] and hit(gte=99.5, lte=1000) == [3, 4] and hit(lte=0.1) == [5]
