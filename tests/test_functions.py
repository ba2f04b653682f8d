from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import coerce, ids, json_text, naming, privacy, timeparts, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_canonical_text_ignores_key_order(spark):
    texts = ['{"b":2,"a":1}', '{ "a": 1, "b": 2 }', '{"b":{"y":null,"x":"é"},"a":1.0}']
    got = [one(spark, json_text.canonical_json(F.lit(t))) for t in texts]
    assert got[0] == got[1] == '{"a":1,"b":2}'
    assert got[2] == '{"a":1,"b":{"x":"é","y":null}}'
    assert one(spark, json_text.canonical_json(F.lit("{nope"))) is None


def test_typed_and_text_values_have_one_canonical_form(spark):
    df = spark.sql("SELECT named_struct('b', 1.0D, 'a', CAST(NULL AS STRING)) AS value")
    typed = df.select(json_text.canonical_value(F.col("value"))).first()[0]
    assert typed == one(spark, json_text.canonical_json(F.lit('{"a": null, "b": 1}')))


def test_point_id_depends_on_coordinates_only(spark):
    df = spark.createDataFrame([("orders", 2, 99, 1), ("orders", 2, 99, 2), ("orders", 2, 100, 1)], "topic string, partition int, offset long, v int")
    a, b, c = [r.point_id for r in ids.with_ids(df).collect()]
    assert a == b != c
    assert [len(p) for p in a.split("-")] == [8, 4, 4, 4, 12]


def test_references(spark):
    cases = {
        "orders:0:42": ("orders", 0, 42),
        "payments-v2:7:99": ("payments-v2", 7, 99),
        "a:b:1:2": ("a:b", 1, 2),
        "not-a-ref": None,
        "orders:abc:1": None,
        "orders:-1:0": None,
        ":0:1": None,
        "orders:99999999999:1": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string").select("r", ids.parse_reference(F.col("r")).alias("p"))
    assert {row.r: tuple(row.p) if row.p else None for row in df.collect()} == cases


def test_mask_builtin_patterns(spark):
    text = "reach me at ada@example.com or 415-555-9999, card 4111 1111 1111 1111"
    masked = one(spark, privacy.mask_text(F.lit(text)))
    assert "ada@example.com" not in masked and "415-555-9999" not in masked
    assert masked.startswith("reach me at [redacted] or ")
    extra = one(spark, privacy.mask_text(F.lit("ticket INTERNAL-12345 raised by ada@example.com"), [r"INTERNAL-\d+"]))
    assert extra == "ticket [redacted] raised by [redacted]"
    assert one(spark, privacy.mask_text(F.lit("ssn 123-45-6789 card 4111111111111111"))) == "ssn [redacted] card [redacted]"
    assert one(spark, privacy.mask_text(F.lit("nothing here"))) == "nothing here"


def test_mask_skips_agree_with_plain_patterns(spark, data):
    """Skipping patterns that cannot match changes nothing, on all documents."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plain = F.col("text")
    for pattern in privacy.DEFAULT_PATTERNS:
        plain = F.regexp_replace(plain, "(?iU)" + pattern, privacy.MASK)
    assert docs.filter(privacy.mask_text(F.col("text")) != plain).isEmpty()
    assert not docs.filter(plain != F.col("text")).isEmpty()


def test_pattern_validation(spark):
    good, bad = privacy.usable_patterns([r"\d{3,4}", "(", "  ", "(?P<n>x)"], spark)
    assert good == [r"\d{3,4}"] and bad == ["(", "(?P<n>x)"]


NESTED = """named_struct('id', 1, 'email', 'a@b.co', 'profile', named_struct('phone', '1', 'name', 'Ada'),
  'history', array(named_struct('card_number', '4', 'x', 1)), 'tags', map('email', 'x', 'k', 'v'),
  'deep', map('m', named_struct('phone', '2', 'y', 2)))"""


def test_redact_typed_at_every_depth(spark):
    df = spark.sql(f"SELECT {NESTED} AS value")
    clean = privacy.redact(F.col("value"), df.schema["value"].dataType, ["email", "phone", "card_number"])
    text = df.select(F.to_json(clean)).first()[0]
    assert text == '{"id":1,"profile":{"name":"Ada"},"history":[{"x":1}],"tags":{"k":"v"},"deep":{"m":{"y":2}}}'


def test_redact_is_case_sensitive_and_keeps_nulls(spark):
    df = spark.sql("SELECT named_struct('Email', 'x', 's', CAST(NULL AS STRUCT<email: STRING, z: INT>)) AS value")
    row = df.select(privacy.redact(F.col("value"), df.schema["value"].dataType, ["email"]).alias("v")).first()
    assert row.v.Email == "x" and row.v.s is None


def test_redact_masks_string_leaves(spark):
    df = spark.sql("SELECT named_struct('n', 5551234567L, 'notes', array('call 415-555-9999', 'ok')) AS value")
    clean = privacy.redact(F.col("value"), df.schema["value"].dataType, mask=True)
    assert df.select(F.to_json(clean)).first()[0] == '{"n":5551234567,"notes":["call [redacted]","ok"]}'


def test_redact_json_equals_typed(spark):
    df = spark.sql(f"SELECT {NESTED} AS value")
    drop = ["email", "phone", "card_number"]
    typed = F.to_json(privacy.redact(F.col("value"), df.schema["value"].dataType, drop))
    loose = privacy.redact_json(F.to_json("value"), drop)
    row = df.select(typed.alias("a"), loose.alias("b")).first()
    assert row.a == row.b
    assert one(spark, privacy.redact_json(F.lit("[1]"))) == "{}"
    assert one(spark, privacy.redact_json(F.lit("{bad"))) == "{}"


def test_cosine_guards(spark):
    def cos(a, b):
        kind = "array<double>"
        return one(spark, vectors.cosine(F.lit(a).cast(kind), F.lit(b).cast(kind)))

    assert cos([1.0, 0.0], [1.0, 0.0]) == 1.0
    assert cos([1.0, 0.0], [0.0, 1.0]) == 0.0
    assert cos([], []) == 0.0
    assert cos([0.0, 0.0], [1.0, 1.0]) == 0.0
    assert cos([1.0], [1.0, 2.0]) == 0.0
    assert one(spark, vectors.cosine_to([0.0, 0.0], F.lit([1.0, 1.0]))) == 0.0
    assert one(spark, vectors.l2_normalize(F.lit([3.0, 4.0]))) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize(F.lit([0.0, 0.0]))) == [0.0, 0.0]


def test_confidence_and_status(spark):
    df = spark.createDataFrame([("1.7",), ("-2",), ("0.25",), ("x",), (None,), ("NaN",)], "c string")
    assert [r[0] for r in df.select(coerce.confidence(F.col("c"))).collect()] == [1.0, 0.0, 0.25, None, None, None]
    assert one(spark, coerce.status(F.lit("failed"))) == "failed"
    assert one(spark, coerce.status(F.lit("odd"))) == "pending"


def test_identifier_rules(spark):
    names = {"id": True, "uuid": True, "a.pk": True, "customer_id": True, "x.order_key": True, "amount": False, "identity": False, "A_UUID": True}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", naming.is_identifier(F.col("n"))).collect()} == names
    cases = [("orders", "order_id", True), ("orders", "orders_id", True), ("orders", "customer_id", False), ("x", "id", True), ("x", "a.id", False), ("Orders", "v.order_id", True)]
    df = spark.createDataFrame(cases, "t string, n string, w boolean")
    assert all(r[0] == r.w for r in df.select(naming.is_primary_identifier(F.col("t"), F.col("n")), "w").collect())


def test_descriptions(spark):
    names = F.array(*[F.lit(f"f{i}") for i in range(9, 0, -1)])
    assert one(spark, naming.synthesized_description(F.lit("t"), names)) == "Kafka topic 't' with fields: f1, f2, f3, f4, f5, f6, f7, f8."
    assert one(spark, naming.synthesized_description(F.lit("t"), F.lit(None).cast("array<string>"))) == "Kafka topic 't'."


def test_lenient_json(spark):
    for text in ('{"a":1}', '```json\n{"a":1}\n```', 'Sure: {"a":1} done'):
        assert one(spark, F.get_json_object(json_text.lenient_json(F.lit(text)), "$.a")) == "1"
    assert one(spark, json_text.lenient_json(F.lit("nope"))) is None


def test_scalars_only(spark):
    text = '{"a":{"b":7,"c":null,"l":[1]},"x.y":"dot"}'
    at = lambda p: one(spark, json_text.scalar_at(F.lit(text), p))
    assert at("a.b") == "7" and at("a") is None and at("a.c") is None and at("a.l") is None and at("zz") is None


def test_times_do_not_depend_on_the_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-31 23:59:59.9995' AS ts").select(
                timeparts.epoch_ms_ntz(F.col("ts")).alias("ms"),
                timeparts.utc_day(F.lit(1_706_745_599_999)).cast("string").alias("day"),
                (timeparts.ntz_of_ms(1_706_745_599_123)).cast("string").alias("back"),
            ).first()
            assert (row.ms, row.day, row.back) == (1_706_745_599_999, "2024-01-31", "2024-01-31 23:59:59.123")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_no_denied_key_survives_anywhere(spark):
    """Property: whatever the nesting, no denied name is left in the type."""
    inner = T.StructType([T.StructField("secret", T.StringType()), T.StructField("ok", T.IntegerType())])
    kinds = [inner, T.ArrayType(inner), T.MapType(T.StringType(), inner), T.ArrayType(T.ArrayType(inner)), T.StructType([T.StructField("n", inner)])]
    for kind in kinds:
        schema = T.StructType([T.StructField("value", T.StructType([T.StructField("v", kind), T.StructField("keep", T.StringType())]))])
        df = spark.createDataFrame([], schema)
        out = df.select(privacy.redact(F.col("value"), schema["value"].dataType, ["secret"]).alias("v"))
        assert "secret" not in out.schema.simpleString()
