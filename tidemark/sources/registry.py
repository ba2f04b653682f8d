"""Schema registry snapshots and the flattening of record schemas into field rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions.json_text import fingerprint
from tidemark.session import broadcast_if_few, local_rows

FIELD_ARRAY = "array<struct<name: string, type: string, nullable: boolean, default_json: string, doc: string>>"
SUBJECT_SUFFIX = "-value"
#: A name and a number each: a few dozen megabytes at most.
MAX_BROADCAST_SUBJECTS = 200_000


def latest(registry: DataFrame) -> DataFrame:
    """The newest version per topic's value subject, with its schema fingerprint; other subjects name no topic."""
    named = registry.filter(F.col("subject").endswith(SUBJECT_SUFFIX))
    # Versions are told apart without their schemas; only the newest ones' texts are grouped.
    last = named.groupBy("subject").agg(F.max("version").alias("version"))
    last = broadcast_if_few(last.select(F.col("subject").alias("_subject"), F.col("version").alias("_version")), MAX_BROADCAST_SUBJECTS)
    held = named.join(last, (F.col("subject") == F.col("_subject")) & F.col("version").eqNullSafe(F.col("_version")), "left_semi")
    newest = held.groupBy("subject").agg(
        F.max_by(F.struct("version", "schema_id", "schema_json"), F.col("version")).alias("s")
    )
    topic = F.regexp_replace("subject", SUBJECT_SUFFIX + "$", "")
    return newest.select(
        "subject",
        topic.alias("topic"),
        "s.version",
        "s.schema_id",
        "s.schema_json",
        fingerprint(F.col("s.schema_json")).alias("fingerprint"),
    )


class _Shape:
    """One schema node read as (label, may be null, nested record, suffix of the nested path)."""

    def __init__(self, node):
        members = node if isinstance(node, list) else [node]
        present = [m for m in members if m != "null"]
        self.nullable = isinstance(node, list) and len(present) < len(members)
        self.record, self.suffix = None, ""
        if isinstance(node, list) and len(present) != 1:
            self.label = "union<" + ",".join(map(self.word, present)) + ">"
        else:
            self.label = self.describe(present[0] if present else None)

    @staticmethod
    def word(node) -> str:
        if isinstance(node, dict):
            return str(node.get("type", "unknown"))
        return node if isinstance(node, str) else "unknown"

    @staticmethod
    def named(record: dict) -> str:
        return f"record<{record.get('name', 'anonymous')}>"

    def describe(self, node) -> str:
        kind = node.get("type") if isinstance(node, dict) else node
        if not isinstance(kind, str):
            return "unknown"
        if not isinstance(node, dict):
            return kind
        if kind == "record":
            self.record = node
            return self.named(node)
        if kind == "array":
            items = node.get("items")
            if isinstance(items, dict) and items.get("type") == "record":
                self.record, self.suffix = items, "[]"
                return f"array<{self.named(items)}>"
            return f"array<{self.word(items)}>"
        detail = {
            "map": lambda: self.word(node.get("values")),
            "enum": lambda: ",".join(node.get("symbols") or []),
            "fixed": lambda: str(node.get("size", 0)),
        }.get(kind)
        return f"{kind}<{detail()}>" if detail else kind


def _field_rows(schema_json: str | None) -> list[dict]:
    """Field rows of one schema in document order: dotted paths, ``[]`` below arrays of records."""
    try:
        root = json.loads(schema_json or "null")
    except ValueError:
        return []
    if not isinstance(root, dict) or root.get("type") != "record":
        return []

    def walk(record: dict, prefix: str) -> Iterator[dict]:
        for field in record.get("fields") or []:
            if not isinstance(field, dict) or not field.get("name"):
                continue
            path = prefix + str(field["name"])
            shape = _Shape(field.get("type"))
            default, doc = field.get("default"), field.get("doc")
            yield {
                "name": path,
                "type": shape.label,
                "nullable": shape.nullable,
                "default_json": None if default is None else json.dumps(default),
                "doc": doc if isinstance(doc, str) else None,
            }
            if shape.record is not None:
                yield from walk(shape.record, f"{path}{shape.suffix}.")

    return list(walk(root, ""))


def flatten_column(schema_json: Column) -> Column:
    """All field rows of a schema as an array; each different text of a batch is parsed once."""
    text, flag = pa.string(), pa.bool_()
    row = pa.struct([("name", text), ("type", text), ("nullable", flag), ("default_json", text), ("doc", text)])

    @F.arrow_udf(FIELD_ARRAY)
    def flatten_batch(batch: pa.Array) -> pa.Array:
        coded = batch.dictionary_encode(null_encoding="encode")
        parsed = pa.array([_field_rows(t) for t in coded.dictionary.to_pylist()], type=pa.list_(row))
        return parsed.take(coded.indices)

    return flatten_batch(schema_json)


def flatten(schemas_df: DataFrame, by: str = "topic") -> DataFrame:
    """Field rows for a table of schemas, without an exchange."""
    return schemas_df.select(by, flatten_column(F.col("schema_json")).alias("f")).select(by, F.inline("f"))


def register_udtf(spark: SparkSession, name: str = "flatten_schema") -> None:
    """The flattener as a table function for SQL: ``FROM registry, LATERAL flatten_schema(schema_json)``."""
    row = FIELD_ARRAY.removeprefix("array<struct<").removesuffix(">>").replace(": ", " ")

    @F.udtf(returnType=row)
    class Flatten:
        def eval(self, schema_json: str):
            for field in _field_rows(schema_json):
                yield tuple(field.values())

    spark.udtf.register(name, Flatten)


# The word used for each column type.
_WORDS = {
    T.StringType: "string", T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int",
    T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean",
    T.BinaryType: "bytes", T.DecimalType: "bytes", T.DateType: "int", T.TimestampType: "long",
    T.TimestampNTZType: "long",
}


def type_word(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "record<anonymous>"
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        return f"array<{type_word(inner) if isinstance(inner, T.StructType) else type_word(inner).split('<')[0]}>"
    if isinstance(kind, T.MapType):
        return f"map<{type_word(kind.valueType).split('<')[0]}>"
    return _WORDS.get(type(kind), "unknown")


def flatten_struct(schema: T.StructType, prefix: str = "") -> list[tuple[str, str, bool]]:
    """(path, type, nullable) rows of a DataFrame schema, in the same notation."""
    rows = []
    for field in schema:
        path = prefix + field.name
        rows.append((path, type_word(field.dataType), field.nullable))
        kind, suffix = field.dataType, "."
        if isinstance(kind, T.ArrayType):
            kind, suffix = kind.elementType, "[]."
        if isinstance(kind, T.StructType):
            rows += flatten_struct(kind, path + suffix)
    return rows


def fields_of(spark: SparkSession, topics: dict[str, T.StructType]) -> DataFrame:
    """The ``fields`` table for typed topics; its size is the number of columns, not of rows."""
    rows = [
        (topic, name, label, nullable, None, None)
        for topic, schema in sorted(topics.items())
        for name, label, nullable in flatten_struct(schema)
    ]
    return local_rows(spark, rows, schemas.FIELDS)
