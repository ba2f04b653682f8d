"""Removing denied fields and masking personal data.

Typed values are rewritten by an expression built from their schema, so the work stays in the
JVM. Values that are only known as JSON text go through one Arrow-batched function.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The built-in patterns, applied in this order, and the mask they leave.
DEFAULT_PATTERNS = (
    r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    r"\b(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{3}\)?[\s-]?)?\d{3}[\s-]?\d{4}\b",
    r"\b\d{13,19}\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
)
MASK = "[redacted]"


def usable_patterns(extra: Iterable[str] = (), spark: SparkSession | None = None) -> tuple[list[str], list[str]]:
    """Split user patterns into (usable, rejected); blank ones are dropped silently.

    A pattern must compile for Python tasks and, with a session at hand, for the JVM as well.
    """
    good, bad = [], []
    for pattern in extra:
        if not pattern or not pattern.strip():
            continue
        try:
            re.compile(pattern)
            if spark is not None:
                spark.range(1).select(F.regexp_replace(F.lit("x"), pattern, "")).collect()
        except (re.error, PySparkException):
            bad.append(pattern)
        else:
            good.append(pattern)
    return good, bad


def mask_text(text: Column, extra: Sequence[str] = (), unicode: bool = True) -> Column:
    """Replace every match of every pattern; case-insensitive, Unicode-aware unless told otherwise.

    The built-in patterns are skipped where they cannot match: the first needs an ``@``, the others
    three digits in a row. Most text has neither, and looking for those is far cheaper.
    """
    flags = "(?iU)" if unicode else "(?i)"

    def mask(column: Column, *patterns: str) -> Column:
        for pattern in patterns:
            column = F.regexp_replace(column, flags + pattern, MASK)
        return column

    address, *numbers = DEFAULT_PATTERNS
    out = F.when(text.contains("@"), mask(text, address)).otherwise(text)
    out = F.when(text.rlike(flags + r"\d{3}"), mask(out, *numbers)).otherwise(out)
    return mask(out, *extra)


def redact(
    value: Column,
    dtype: T.DataType,
    drop: Iterable[str] = (),
    mask: bool = False,
    extra: Sequence[str] = (),
    unicode: bool = True,
) -> Column:
    """Drop denied fields at every depth and, on request, mask every string leaf.

    Names match case-sensitively. Structs lose the field from their type, maps lose the entry.
    """
    denied = frozenset(drop)

    def leaf(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [leaf(column.getField(f.name), f.dataType).alias(f.name) for f in kind if f.name not in denied]
            return F.when(column.isNotNull(), F.struct(*kept))
        if isinstance(kind, T.ArrayType):
            if not touches(kind.elementType):
                return column
            return F.transform(column, lambda x: leaf(x, kind.elementType))
        if isinstance(kind, T.MapType):
            if denied and isinstance(kind.keyType, T.StringType):
                column = F.map_filter(column, lambda k, _: ~k.isin(*sorted(denied)))
            if touches(kind.valueType):
                column = F.transform_values(column, lambda _, v: leaf(v, kind.valueType))
            return column
        if mask and isinstance(kind, T.StringType):
            return mask_text(column, extra, unicode)
        return column

    def touches(kind: T.DataType) -> bool:
        return isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) or (mask and isinstance(kind, T.StringType))

    return leaf(value, dtype)


def redact_json(
    text: Column,
    drop: Iterable[str] = (),
    mask: bool = False,
    extra: Sequence[str] = (),
) -> Column:
    """The same rewrite for JSON text of unknown shape; a value that is no object becomes ``{}``."""
    denied = frozenset(drop)
    patterns = [re.compile(p, re.IGNORECASE) for p in (*DEFAULT_PATTERNS, *extra)] if mask else []

    def clean(node):
        if isinstance(node, dict):
            return {name: clean(child) for name, child in node.items() if name not in denied}
        if isinstance(node, list):
            return [clean(child) for child in node]
        if isinstance(node, str):
            for pattern in patterns:
                node = pattern.sub(MASK, node)
        return node

    def rewrite(raw):
        if raw is None:
            return None
        try:
            node = json.loads(raw)
        except ValueError:
            return "{}"
        return json.dumps(clean(node), ensure_ascii=False, separators=(",", ":")) if isinstance(node, dict) else "{}"

    @F.pandas_udf("string")
    def rewrite_batch(batch: pd.Series) -> pd.Series:
        return batch.map(rewrite)

    return rewrite_batch(text)


def redact_samples(
    samples: DataFrame,
    drop: Iterable[str] = (),
    extra: Sequence[str] = (),
    redact_keys: bool = True,
) -> DataFrame:
    """Clean sampled records before anything is stored or sent to a model."""
    out = samples.withColumn("value_json", redact_json(F.col("value_json"), drop, True, extra))
    return out.withColumn("key", mask_text(F.col("key"), extra)) if redact_keys else out
