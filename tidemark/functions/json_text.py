"""Canonical JSON text and tolerant JSON reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """One text per JSON value: keys sorted at every level, compact, nulls and non-ASCII kept.

    Numbers are normalised (``1.0`` becomes ``1``). Text that is not JSON gives null.
    """
    return F.to_json(F.try_parse_json(text))


def struct_json(value: Column) -> Column:
    """A typed value as JSON with its null fields kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def canonical_value(value: Column) -> Column:
    """Canonical text of a typed struct, equal to that of the same value held as JSON text."""
    return canonical_json(struct_json(value))


def fingerprint(schema_json: Column) -> Column:
    """SHA-256 of the canonical schema JSON."""
    return F.sha2(canonical_json(schema_json), 256)


def lenient_json(response: Column) -> Column:
    """The JSON object in a model response, as text.

    A surrounding code fence is stripped; when the rest is not JSON, the span from the first
    opening to the last closing brace is tried. Null when neither parses.
    """
    body = F.regexp_replace(F.trim(response), r"^```[a-zA-Z]*\n", "")
    body = F.regexp_replace(body, r"\n```$", "")
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    whole_ok = F.try_parse_json(body).isNotNull()
    inner_ok = F.try_parse_json(inner).isNotNull()
    return F.when(whole_ok, body).when(inner_ok, inner)


def json_path(dotted: str) -> str:
    """``a.b`` as the JSON path ``$['a']['b']`` (safe for any key text)."""
    return "$" + "".join("['" + part.replace("'", "\\'") + "']" for part in dotted.split("."))


def leaf_kind(variant: Column, path: str) -> Column:
    """The type word of a leaf: STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, VOID, ..."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def scalar_at(text: Column, dotted: str) -> Column:
    """A scalar at a dotted path as text; null for a missing path, null, object or array."""
    variant = F.try_parse_json(text)
    path = json_path(dotted)
    kind = leaf_kind(variant, path)
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(~nested, F.try_variant_get(variant, path, "string"))


def question(about: str, answer: str) -> str:
    """What stands before the JSON of a prompt: the type that the answer is read with, and what it is about."""
    return f"Return one value of type {answer}, as JSON, for {about}:\n"
