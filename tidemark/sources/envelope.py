"""Decoding raw records: the registry envelope, keys, headers, tombstones, rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import broadcast_if_few

MAX_ERROR_CHARS = 500
#: One INT each: a few megabytes at most.
MAX_BROADCAST_IDS = 200_000


def decode_key(key: Column) -> Column:
    """UTF-8 text where the bytes are valid UTF-8, lower-case hex otherwise."""
    text = key.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.lower(F.hex(key)))


def decode_headers(headers: Column) -> Column:
    """Headers as a map; of a repeated name the last one wins, undecodable bytes become ``0x...``.

    Earlier duplicates are filtered out first, so the result does not depend on how the session
    is told to treat duplicate map keys.
    """
    def is_last(header: Column, position: Column) -> Column:
        later = F.slice(headers, position + F.lit(2), F.size(headers))
        return ~F.exists(later, lambda other: other["key"] == header["key"])

    def entry(header: Column) -> Column:
        text = header["value"].cast("string")
        shown = F.when(F.is_valid_utf8(text), text).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(header["value"]))))
        return F.struct(header["key"].alias("key"), shown.alias("value"))

    kept = F.filter(headers, is_last)
    return F.when(F.coalesce(F.size(headers), F.lit(0)) > 0, F.map_from_entries(F.transform(kept, entry))).otherwise(
        F.create_map().cast("map<string,string>")
    )


def split_envelope(value: Column) -> tuple[Column, Column, Column]:
    """(magic byte, schema id, body) of a registry-framed value."""
    magic = F.hex(F.substring(value, 1, 1))
    schema_id = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("int")
    body = F.substring(value, 6, 2_147_483_647)
    return magic, schema_id, body


def wrap_envelope(schema_id: Column, body: Column) -> Column:
    """Frame a body with magic byte zero and a four-byte schema id."""
    return F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(schema_id.cast("long")), 8, "0")), body)


def is_json_object(text: Column) -> Column:
    """Whether the whole text is one JSON object, by the parser that reads it later.

    That parser stops after the first value. As the first entry of an array that ends in the text's own MD5, which the text
    cannot hold, it is followed by nothing but that: one parse tells all.
    """
    mark = F.md5(text.cast("binary"))
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    alone = F.try_variant_get(listed, "$[1]", "string") == mark
    return F.coalesce(alone & F.btrim(text, F.lit(" \t\r\n")).startswith("{"), F.lit(False))


#: A decode strategy: framed records (value, schema_id, body, and the registry's ids joined) and the registry in, the
#: same with ``value_json`` and ``body_error`` out. Null errors are good bodies.
Bodies = Callable[[DataFrame, DataFrame], DataFrame]


def json_bodies(framed: DataFrame, registry: DataFrame) -> DataFrame:
    """Bodies that are JSON text."""
    text = F.col("body").cast("string")
    fits = F.coalesce(F.is_valid_utf8(text) & is_json_object(text), F.lit(False))
    return framed.withColumn("value_json", text).withColumn("body_error", F.when(~fits, F.lit("body is not a JSON object")))


def avro_bodies(reader: Callable[[Column, str], Column] | None = None) -> Bodies:
    """Bodies in Avro's binary form, one reader for every schema id that occurs in the batch.

    ``reader(body, schema_json)`` makes a struct column, null where a body does not fit; by default Spark's ``from_avro``, whose
    package must be on the class path. Each record runs through its own schema's reader only, and one that cannot be read becomes a reject.
    """

    def read(body: Column, schema_json: str) -> Column:
        from pyspark.sql.avro.functions import from_avro

        return from_avro(body, schema_json, {"mode": "PERMISSIVE"})

    def bodies(framed: DataFrame, registry: DataFrame) -> DataFrame:
        present = framed.filter(F.col("known_id").isNotNull()).select("schema_id").distinct()
        # One row per schema version in use, which is catalog metadata.
        wanted = registry.join(present, "schema_id", "left_semi").select("schema_id", "schema_json").distinct().orderBy("schema_id").collect()
        made = F.lit(None).cast("string")
        for row in wanted:
            value = (reader or read)(F.col("body"), row.schema_json)
            text = F.when(value.isNotNull(), F.to_json(value, {"ignoreNullFields": "false"}))
            made = F.when(F.col("schema_id") == row.schema_id, text).otherwise(made)
        out = framed.withColumn("value_json", made)
        # A body of nothing but nulls is what a permissive reader makes of bytes it cannot read.
        empty = F.col("value_json").isNull() | ~F.col("value_json").rlike(r":(?!null[,}])")
        return out.withColumn("body_error", F.when(empty, F.lit("body does not fit its schema")))

    return bodies


def decode(raw: DataFrame, registry: DataFrame, bodies: Bodies = json_bodies) -> DataFrame:
    """Decode framed records into events; nothing is lost.

    Tombstones (null values) are dropped. Every other record comes out with either ``value_json``
    or an ``error``; split the two with :func:`good` and :func:`rejects`. Of the registry only the
    ids are joined, broadcast when there are few enough of them, so records are not moved. ``bodies`` reads what
    stands behind the envelope.
    """
    magic, schema_id, body = split_envelope(F.col("value"))
    ids = registry.select(F.col("schema_id").alias("known_id")).distinct()
    known = broadcast_if_few(ids, MAX_BROADCAST_IDS)
    framed = raw.filter(F.col("value").isNotNull()).withColumns({"magic": magic, "schema_id": schema_id, "body": body})
    read = bodies(framed.join(known, F.col("schema_id") == F.col("known_id"), "left"), registry)
    error = (
        F.when((F.length("value") < 5) | (F.col("magic") != "00"), F.lit("record is not framed by a schema registry"))
        .when(F.col("known_id").isNull(), F.concat(F.lit("unknown schema id "), F.col("schema_id").cast("string")))
        .otherwise(F.col("body_error"))
    )
    return read.withColumn("error", error).select(
        "topic",
        "partition",
        "offset",
        F.unix_millis("timestamp").alias("timestamp_ms"),
        decode_key(F.col("key")).alias("key"),
        decode_headers(F.col("headers")).alias("headers"),
        "schema_id",
        F.when(F.col("error").isNull(), F.col("value_json")).alias("value_json"),
        F.substring("error", 1, MAX_ERROR_CHARS).alias("error"),
        F.col("key").alias("raw_key"),
        F.col("value").alias("raw_value"),
    )


def good(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error").isNull()).drop("error", "raw_key", "raw_value")


def rejects(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error").isNotNull()).select(
        "topic", "partition", "offset", "raw_key", "raw_value", "error"
    )
