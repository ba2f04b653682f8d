import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources import envelope, kafka, registry, tables

ORDER = {
    "type": "record", "name": "Line", "fields": [
        {"name": "l_orderkey", "type": "long"},
        {"name": "l_comment", "type": ["null", "string"], "default": None, "doc": "as typed by the clerk"},
        {"name": "l_shipmode", "type": {"type": "enum", "name": "Mode", "symbols": ["AIR", "RAIL", "SHIP"]}, "default": "RAIL"},
        {"name": "part", "type": {"type": "record", "name": "Part", "fields": [{"name": "p_size", "type": "int"}, {"name": "p_brand", "type": ["null", "string"]}]}},
        {"name": "flags", "type": {"type": "array", "items": "boolean"}},
        {"name": "stops", "type": {"type": "array", "items": {"type": "record", "name": "Stop", "fields": [{"name": "nationkey", "type": "int"}]}}},
        {"name": "extra", "type": ["null", "double", {"type": "map", "values": "string"}]},
        {"name": "l_shipdate", "type": {"type": "int", "logicalType": "date"}},
        {"name": "l_tax", "type": {"type": ["float"]}},
        {"name": ""},
        "junk",
    ],
}
FLAT = [
    ("l_orderkey", "long", False), ("l_comment", "string", True), ("l_shipmode", "enum<AIR,RAIL,SHIP>", False), ("part", "record<Part>", False),
    ("part.p_size", "int", False), ("part.p_brand", "string", True), ("flags", "array<boolean>", False),
    ("stops", "array<record<Stop>>", False), ("stops[].nationkey", "int", False), ("extra", "union<double,map>", True), ("l_shipdate", "int", False),
    ("l_tax", "unknown", False),
]


def registry_rows(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.REGISTRY)


def test_flatten(spark):
    df = registry.flatten(registry.latest(registry_rows(spark, ("orders-value", 3, 7, json.dumps(ORDER)), ("orders-value", 2, 6, "{}"))))
    rows = df.collect()
    assert [(r.name, r.type, r.nullable) for r in rows] == FLAT
    assert {r.topic for r in rows} == {"orders"}
    by_name = {r.name: r for r in rows}
    assert by_name["l_comment"].doc == "as typed by the clerk" and by_name["l_comment"].default_json is None
    assert by_name["l_shipmode"].default_json == '"RAIL"'


def test_flatten_needs_a_record(spark):
    rows = registry_rows(spark, ("a-value", 1, 1, '"string"'), ("b-value", 1, 2, "{bad"), ("c-value", 1, 3, None))
    assert registry.flatten(registry.latest(rows)).isEmpty()


def test_flatten_as_table_function(spark):
    registry.register_udtf(spark)
    registry_rows(spark, ("orders-value", 3, 7, json.dumps(ORDER))).createOrReplaceTempView("reg")
    rows = spark.sql("SELECT f.* FROM reg, LATERAL flatten_schema(schema_json) f").collect()
    assert [(r.name, r.type, r.nullable) for r in rows] == FLAT


def test_fingerprint_ignores_layout(spark):
    texts = [json.dumps(ORDER), json.dumps(ORDER, sort_keys=True, indent=2)]
    rows = registry_rows(spark, *[(f"t{i}-value", 1, i, t) for i, t in enumerate(texts)])
    a, b = [r.fingerprint for r in registry.latest(rows).collect()]
    assert a == b and len(a) == 64


def test_struct_flattening_uses_the_same_notation(spark, data):
    shape = tables.events(spark, data).schema["value"].dataType
    assert [(n, t) for n, t, _ in registry.flatten_struct(shape)] == [
        ("event_id", "long"), ("user_id", "long"), ("value", "double"), ("props", "record<anonymous>"), ("props.k", "long")
    ]


def raw(spark, rows):
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, key binary, value binary")
    return df.withColumn("timestamp", F.timestamp_millis(F.lit(5))).withColumn(
        "headers", F.lit(None).cast("array<struct<key:string,value:binary>>")
    )


def test_decode_splits_good_bad_and_tombstones(spark):
    frame = b"\x00\x00\x00\x00\x07"
    rows = [
        ("o", 0, 1, b"k", frame + b'{"a":1}'),
        ("o", 0, 2, b"\xff\x01", frame + b'{"a":'),
        ("o", 0, 3, None, None),
        ("o", 0, 4, None, b"\x01" + frame[1:] + b"{}"),
        ("o", 0, 5, None, b"\x00\x00\x00\x00\x63{}"),
        ("o", 0, 6, None, frame + b"[1]"),
        ("o", 0, 7, None, b"\x00"),
        ("o", 0, 8, None, frame + b'{"s":"\xff"}'),
    ]
    out = envelope.decode(raw(spark, rows), registry_rows(spark, ("o-value", 1, 7, "{}"))).persist()
    good = envelope.good(out).collect()
    assert [(r.offset, r.key, r.value_json, r.schema_id, r.timestamp_ms, r.headers) for r in good] == [(1, "k", '{"a":1}', 7, 5, {})]
    bad = {r.offset: (r.error, r.raw_key) for r in envelope.rejects(out).collect()}
    assert sorted(bad) == [2, 4, 5, 6, 7, 8]
    assert bad[5][0] == "unknown schema id 99" and bad[2][1] == b"\xff\x01"
    assert all(len(error) <= 500 for error, _ in bad.values())
    out.unpersist()


def test_dead_letter_shape(spark):
    bad = spark.createDataFrame(
        [("orders", 0, 42, b"k1", b"\x00\x01bad-avro", "boom")],
        "topic string, partition int, offset long, raw_key binary, raw_value binary, error string",
    )
    row = kafka.dead_letter_records(bad).first()
    assert row.value == b"\x00\x01bad-avro" and row.key == b"k1"
    assert {h.key: bytes(h.value).decode() for h in row.headers} == {
        "sc_origin_topic": "orders", "sc_origin_partition": "0", "sc_origin_offset": "42", "sc_error": "boom"
    }


def test_last_header_wins(spark):
    df = spark.sql("SELECT array(named_struct('key', 'a', 'value', X'31'), named_struct('key', 'b', 'value', X'FF'), named_struct('key', 'a', 'value', X'32')) h")
    assert df.select(envelope.decode_headers(F.col("h"))).first()[0] == {"a": "2", "b": "0xff"}


def test_security_options():
    assert kafka.security_options() == {}
    sasl = kafka.security_options("SASL_SSL", username="u", password='p"q', truststore="/ca.pem")
    assert sasl["kafka.security.protocol"] == "SASL_SSL" and sasl["kafka.sasl.mechanism"] == "PLAIN"
    assert 'password="p\\"q"' in sasl["kafka.sasl.jaas.config"] and sasl["kafka.ssl.truststore.location"] == "/ca.pem"
    assert "kafka.ssl.truststore.location" not in kafka.security_options("SASL_PLAINTEXT", "SCRAM-SHA-512", "u", "p")
    with pytest.raises(ValueError):
        kafka.security_options("TLS")
    assert kafka.registry_options("http://r", "u", "p") == {"url": "http://r", "basic.auth.user.info": "u:p"}


def test_source_options():
    options = kafka.source_options("b:9092", [" a ", "", "b"], "latest", 500)
    assert options["subscribe"] == "a,b" and options["startingOffsets"] == "latest" and options["maxOffsetsPerTrigger"] == "500"
    with pytest.raises(ValueError):
        kafka.source_options("b:9092", [" "])
    with pytest.raises(ValueError):
        kafka.source_options("b:9092", ["a"], "middle")


def test_flush_by_size_or_age():
    options = kafka.source_options("b:9092", ["a"], max_per_trigger=50_000, min_per_trigger=32, max_delay="1s")
    assert (options["minOffsetsPerTrigger"], options["maxTriggerDelay"], options["maxOffsetsPerTrigger"]) == ("32", "1s", "50000")
    assert not {"minOffsetsPerTrigger", "maxTriggerDelay"} & set(kafka.source_options("b:9092", ["a"]))
    for bad in ({"min_per_trigger": 5}, {"max_delay": "1s"}, {"min_per_trigger": 5, "max_delay": "1s", "max_per_trigger": 4}):
        with pytest.raises(ValueError):
            kafka.source_options("b:9092", ["a"], **bad)


def test_sampler_reads_only_the_newest_offsets(spark):
    known = spark.createDataFrame([("b", 0, 7), ("a", 1, 100), ("a", 0, 3)], "topic string, partition int, next_offset long")
    options = kafka.sample_options("b:9092", known, 5)
    assert json.loads(options["startingOffsets"]) == {"a": {"0": 0, "1": 95}, "b": {"0": 2}}
    assert json.loads(options["endingOffsets"]) == {"a": {"0": 3, "1": 100}, "b": {"0": 7}}
    assert json.loads(options["assign"]) == {"a": [0, 1], "b": [0]} and "subscribe" not in options
    spans = [(t, p, e - json.loads(options["startingOffsets"])[t][p]) for t, ps in json.loads(options["endingOffsets"]).items() for p, e in ps.items()]
    assert all(n <= 5 for _, _, n in spans)
    for bad in ((known, 0), (known.limit(0), 5)):
        with pytest.raises(ValueError):
            kafka.sample_options("b:9092", *bad)


def test_bounded_reads_do_not_change_their_start():
    with pytest.raises(ValueError):
        kafka.batch_options(kafka.source_options("b:9092", ["a"], "latest"))
    options = kafka.batch_options(kafka.source_options("b:9092", ["a"], min_per_trigger=1, max_delay="1s", max_per_trigger=9))
    assert options["startingOffsets"] == "earliest" and not any("Trigger" in k for k in options)


def read_rows(body, schema_json):
    """A stand-in for the codec: bodies are JSON, read by the fields of the schema."""
    fields = ", ".join(f"{f['name']} {'string' if f['type'] == 'string' else 'bigint'}" for f in json.loads(schema_json)["fields"])
    value = F.from_json(body.cast("string"), f"struct<{', '.join(x.replace(' ', ':', 1) for x in fields.split(', '))}>", {"mode": "PERMISSIVE"})
    return value


def test_bodies_are_read_by_their_own_schema(spark):
    def schema(**fields):
        return json.dumps({"type": "record", "name": "R", "fields": [{"name": n, "type": t} for n, t in fields.items()]})

    known = spark.createDataFrame([("a-value", 1, 1, schema(n="long")), ("a-value", 2, 2, schema(n="long", s="string")), ("b-value", 1, 3, schema(x="string"))], schemas.REGISTRY)
    records = [(1, b'{"n":4}'), (2, b'{"n":5,"s":"y"}'), (2, b"\xff\x00broken"), (9, b'{"n":4}'), (1, b'{"other":1}'), (2, b'{"n":null,"s":"z"}'), (3, b"")]
    raw = [("t", 0, i, datetime(2024, 1, 1), None, b"\x00" + n.to_bytes(4, "big") + b, []) for i, (n, b) in enumerate(records)]
    raw += [("t", 0, 90, datetime(2024, 1, 1), None, None, []), ("t", 0, 91, datetime(2024, 1, 1), None, b"\x01\x00", [])]
    out = envelope.decode(spark.createDataFrame(raw, schemas.RAW), known, envelope.avro_bodies(read_rows))
    got = {r.offset: r.value_json for r in envelope.good(out).collect()}
    assert {i: json.loads(v) for i, v in got.items()} == {0: {"n": 4}, 1: {"n": 5, "s": "y"}, 5: {"n": None, "s": "z"}}
    errors = {r.offset: r.error for r in envelope.rejects(out).collect()}
    assert errors.pop(3) == "unknown schema id 9" and errors.pop(91).startswith("record is not framed")
    assert set(errors) == {2, 4, 6} and set(errors.values()) == {"body does not fit its schema"}


def test_only_whole_json_objects_are_bodies(spark):
    good = ['{}', ' {"a": 1} ', '{"a":{"b":[1,2]}}', '{"é":"}"}']
    bad = ["", "x", "[1]", "3", "{'a':1}", '{"a":1} trailing', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}],[{"b":2}', '{"a":1}},"w":{"b":2}', '{"a":1,"a":2}', '{"a":"line\nbreak"}', '{"a":']
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = [r.ok for r in df.select(envelope.is_json_object(F.col("t")).alias("ok")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_newest_versions_are_found_without_their_schemas(spark):
    """Ties give one row, null versions count only where there is no other, and only the newest versions' texts are grouped."""
    rows = [("a-value", 1, 1, "{}"), ("a-value", 2, 2, '{"x":1}'), ("a-value", 2, 2, '{"x":1}'), ("a-value", None, 9, "{}"),
            ("b-value", None, 3, "{}"), ("c-key", 1, 4, "{}"), (None, 1, 5, "{}")]
    table = spark.createDataFrame(rows, "subject string, version int, schema_id int, schema_json string")
    newest = registry.latest(table)
    got = sorted((r.subject, r.version, r.schema_id, r.schema_json) for r in newest.collect())
    assert got == [("a-value", 2, 2, '{"x":1}'), ("b-value", None, None, None)]
    assert "LeftSemi" in newest._jdf.queryExecution().executedPlan().toString()
