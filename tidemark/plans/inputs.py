"""Inputs of the registered queries, derived from the given tables by Spark.

The tables hold no Kafka bytes, registry or catalog; these views give each row of a table the form
the operator under test expects, so every query still works on whole tables.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeparts import epoch_ms_ntz
from tidemark.sources import envelope, tables

#: Moment the look-back queries count from: 2024-01-31 00:00 UTC.
NOW_MS = 1_706_659_200_000
PART_TEMPLATE = {
    "type": "record",
    "name": "Part",
    "fields": [
        {"name": "part_id", "type": "long"},
        {"name": "name", "type": ["null", "string"], "default": None, "doc": "@name"},
        {"name": "size", "type": "int", "default": "@size"},
        {"name": "grade", "type": {"type": "enum", "name": "Grade", "symbols": ["@brand", "OTHER"]}},
        {
            "name": "maker",
            "type": {
                "type": "record",
                "name": "Maker",
                "fields": [
                    {"name": "uuid", "type": "string"},
                    {"name": "tags", "type": {"type": "array", "items": "string"}},
                ],
            },
        },
        {
            "name": "offers",
            "type": {
                "type": "array",
                "items": {"type": "record", "name": "Offer", "fields": [{"name": "supplier_id", "type": ["long", "null"]}]},
            },
        },
        {"name": "attrs", "type": {"type": "map", "values": "string"}},
        {"name": "code", "type": {"type": "fixed", "name": "Code", "size": 16}},
        {"name": "batch_key", "type": ["null", "string", "long"]},
        {"name": "made_at", "type": {"type": "long", "logicalType": "timestamp-millis"}},
    ],
}
#: (path, type, nullable, default, doc) the template flattens to; ``@`` marks a value of the row.
PART_FIELDS = (
    ("part_id", "long", False, None, None),
    ("name", "string", True, None, "@name"),
    ("size", "int", False, "@size", None),
    ("grade", "enum<@brand,OTHER>", False, None, None),
    ("maker", "record<Maker>", False, None, None),
    ("maker.uuid", "string", False, None, None),
    ("maker.tags", "array<string>", False, None, None),
    ("offers", "array<record<Offer>>", False, None, None),
    ("offers[].supplier_id", "long", True, None, None),
    ("attrs", "map<string>", False, None, None),
    ("code", "fixed<16>", False, None, None),
    ("batch_key", "union<string,long>", True, None, None),
    ("made_at", "long", False, None, None),
)


def part_schema_pieces(sort_keys: bool = False) -> list[str]:
    """The template's JSON cut at its row values: text, name, text, name, ..."""
    text = json.dumps(PART_TEMPLATE, sort_keys=sort_keys, separators=(",", ":")).replace('"@size"', "@size")
    pieces, rest = [], text
    while "@" in rest:
        before, _, after = rest.partition("@")
        name = next(n for n in ("name", "size", "brand") if after.startswith(n))
        pieces += [before, name]
        rest = after[len(name):]
    return [*pieces, rest]


def part_registry(spark: SparkSession, folder: str) -> DataFrame:
    """A registry with one schema version per part and one subject per brand and type."""
    part = tables.load(spark, folder, "part")
    columns = {"name": F.col("p_name"), "size": F.col("p_size").cast("string"), "brand": F.col("p_brand")}
    pieces = part_schema_pieces()
    text = F.concat(*[columns[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])
    return part.select(
        F.concat("p_brand", F.lit("/"), "p_type", F.lit("-value")).alias("subject"),
        F.col("p_partkey").cast("int").alias("version"),
        (F.col("p_partkey") + 1).cast("int").alias("schema_id"),
        text.alias("schema_json"),
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("topic"),
    )


def event_registry(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON-bodied schema per event type, numbered by the first letter of its name."""
    names = tables.load(spark, folder, "events").select("event_type").distinct()
    return names.select(
        F.concat("event_type", F.lit("-value")).alias("subject"),
        F.lit(1).alias("version"),
        F.ascii("event_type").alias("schema_id"),
        F.lit('{"type":"record","name":"E","fields":[{"name":"event_id","type":"long"}]}').alias("schema_json"),
    )


def raw_events(spark: SparkSession, folder: str, source: DataFrame | None = None) -> DataFrame:
    """``events`` as broker records: framed JSON bodies, byte keys, repeated headers.

    Small values are deletions (null body), keys of errors are not UTF-8, bodies of signups name an
    unknown schema, and bodies of views end early.
    """
    df = tables.load(spark, folder, "events") if source is None else source
    kind = F.col("event_type")
    text = F.to_json(F.struct("event_id", "user_id", "event_type", "props"))
    text = F.when(kind == "view", F.substring(text, 1, 20)).otherwise(text)
    number = F.when(kind == "signup", F.lit(9999)).otherwise(F.ascii(kind))
    framed = envelope.wrap_envelope(number, F.encode(text, "UTF-8"))
    user = F.encode(F.col("user_id").cast("string"), "UTF-8")

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.alias("value"))

    return df.select(
        kind.alias("topic"),
        (F.col("user_id") % tables.PARTITIONS).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.timestamp_millis(epoch_ms_ntz(F.col("ts"))).alias("timestamp"),
        F.when(kind == "error", F.concat(F.unhex(F.lit("FF")), user)).otherwise(user).alias("key"),
        F.when(F.col("value") >= 5, framed).alias("value"),
        F.array(
            header("trace", user),
            header("kind", F.encode(kind, "UTF-8")),
            header("trace", F.encode(F.col("event_id").cast("string"), "UTF-8")),
            header("bin", F.unhex(F.lit("FE01"))),
        ).alias("headers"),
    )


def usage_log(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` as model calls: the role is the provider, text lengths are token counts."""
    df = tables.load(spark, folder, "conversations")
    return df.select(
        "conv_id",
        "turn",
        F.col("role").alias("provider"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("conv_id") / 50).cast("int")).alias("day"),
        F.length("text").alias("input_tokens"),
        (F.col("turn") + 1).alias("output_tokens"),
    )


PRICES = {"user": (0.25, 1.25), "assistant": (3.0, 15.0)}
DEFAULT_PRICE = (1.0, 4.0)


def event_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog row per event type that starts with a letter before s, and one per region."""
    names = tables.load(spark, folder, "events").select(F.col("event_type").alias("name")).distinct()
    regions = tables.load(spark, folder, "region").select(F.lower("r_name").alias("name"))
    both = names.filter(F.col("name") < "s").unionByName(regions)
    return both.select(
        "name",
        F.concat(F.lit("about "), "name").alias("description"),
        (F.length("name") / F.lit(100.0)).alias("description_confidence"),
        F.when(F.col("name") == "click", F.lit("inferred")).otherwise(F.lit("odd")).alias("inference_status"),
    )
