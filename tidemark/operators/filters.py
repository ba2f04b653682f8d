"""Predicates over events: field clauses, topics, look-back windows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import timeparts
from tidemark.functions.json_text import json_path, leaf_kind
from tidemark.schemas import CORE_COLUMNS

MAX_CLAUSES = 10
_NUMERIC = "^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL.*)$"
_BINARY = "^(FLOAT|DOUBLE)$"
#: Whole and decimal leaves are compared in this type, doubles as doubles.
_EXACT = "decimal(38,18)"


@dataclass(frozen=True)
class Clause:
    """One condition on a field: ``eq`` wins over ``in_values``, which wins over ``gte``/``lte``."""

    field: str
    eq: Any = None
    in_values: Sequence[Any] | None = None
    gte: float | None = None
    lte: float | None = None

    def __post_init__(self):
        if all(v is None for v in (self.eq, self.in_values, self.gte, self.lte)):
            raise ValueError(f"clause on {self.field!r} needs one of eq, in_values, gte, lte")

    @classmethod
    def of(cls, spec: Clause | Mapping[str, Any]) -> Clause:
        if isinstance(spec, cls):
            return spec
        unknown = set(spec) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown clause keys: {sorted(unknown)}")
        return cls(**spec)


def resolve_name(field: str) -> str:
    """The full path of a field: core columns as they are, anything else below ``value``."""
    if field in CORE_COLUMNS or field.startswith(("value.", "headers.")):
        return field
    return f"value.{field}"


def _exact_literal(value: Any) -> Column:
    """A number as the decimal its shortest text says; one that does not fit the exact type stays a double."""
    number = Decimal(value) if isinstance(value, (int, Decimal)) else Decimal(repr(value))
    fits = number.is_finite() and number.copy_abs() < 10**20 and number.as_tuple().exponent >= -18
    return F.lit(f"{number:f}").cast(_EXACT) if fits else F.lit(float(value))


class _Leaf:
    """A resolved field on which typed comparisons can be built."""

    def __init__(self, df: DataFrame, field: str):
        path = resolve_name(field)
        root, _, rest = path.partition(".")
        names = df.columns
        self.variant = self.kind = None
        self.repeated = False
        if not rest:
            self.column, self.dtype = F.col(root), df.schema[root].dataType
        elif root == "headers":
            self.column, self.dtype = F.col("headers").getItem(rest), T.StringType()
        elif "value" in names and isinstance(df.schema["value"].dataType, T.StructType):
            self.column, self.dtype = self._typed(F.col("value"), df.schema["value"].dataType, rest.split("."))
        else:
            self.variant = F.try_parse_json("value_json")
            self.where = json_path(rest)
            self.kind = leaf_kind(self.variant, self.where)

    def _typed(self, column: Column, dtype: T.DataType, parts: list[str]):
        """Follow a dotted path through structs; below an array the leaf becomes an array of leaves."""
        for part in parts:
            part = part.removesuffix("[]")
            inner = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
            if not isinstance(inner, T.StructType) or part not in inner.fieldNames():
                return F.lit(None), T.NullType()
            if isinstance(dtype, T.ArrayType):
                self.repeated = True
            column = column.getField(part)
            dtype = inner[part].dataType
            if self.repeated:
                if isinstance(dtype, T.ArrayType):
                    column = F.flatten(column)
                    dtype = dtype.elementType
                dtype = T.ArrayType(dtype)
        if isinstance(dtype, T.ArrayType):
            self.repeated = True
            return column, dtype.elementType
        return column, dtype

    def _any(self, test) -> Column:
        return F.exists(self.column, test) if self.repeated else test(self.column)

    @staticmethod
    def _same_kind(dtype: T.DataType, value: Any) -> bool:
        if isinstance(value, bool):
            return isinstance(dtype, T.BooleanType)
        if isinstance(value, str):
            return isinstance(dtype, T.StringType)
        return isinstance(dtype, T.NumericType)

    def equals(self, values: Sequence[Any]) -> Column:
        """Membership without conversion between text, numbers and booleans."""
        if self.variant is None:
            fit = [v for v in values if self._same_kind(self.dtype, v)]
            if not fit:
                return F.lit(False)
            return self._any(lambda c: c == fit[0] if len(fit) == 1 else c.isin(fit))
        tests = []
        for pattern, cast, member in (
            ("^STRING$", "string", lambda v: isinstance(v, str)),
            ("^BOOLEAN$", "boolean", lambda v: isinstance(v, bool)),
        ):
            chosen = [v for v in values if member(v)]
            if chosen:
                leaf = F.try_variant_get(self.variant, self.where, cast)
                tests.append(self.kind.rlike(pattern) & leaf.isin(chosen))
        numbers = [v for v in values if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)]
        if numbers:
            tests.append(self._number(lambda leaf, literal: reduce(or_, [leaf == literal(v) for v in numbers])))
        return F.coalesce(reduce(or_, tests), F.lit(False)) if tests else F.lit(False)

    def _number(self, test: Callable[[Column, Callable[[Any], Column]], Column]) -> Column:
        """A test of a numeric leaf: exact for whole and decimal numbers, as doubles for doubles.

        Integers beyond 2^53 stay apart, which a comparison of doubles would not do. A leaf too large for the exact type is
        compared as a double.
        """
        binary = F.try_variant_get(self.variant, self.where, "double")
        exact = F.try_variant_get(self.variant, self.where, _EXACT)
        as_double = test(binary, lambda v: F.lit(float(v)))
        as_exact = F.when(exact.isNull(), as_double).otherwise(test(exact, _exact_literal))
        return self.kind.rlike(_NUMERIC) & F.when(self.kind.rlike(_BINARY), as_double).otherwise(as_exact)

    def between(self, gte: float | None, lte: float | None) -> Column:
        def bounds(c: Column, literal: Callable[[Any], Any]) -> Column:
            tests = ([] if gte is None else [c >= literal(gte)]) + ([] if lte is None else [c <= literal(lte)])
            return reduce(and_, tests)

        if self.variant is None:
            return self._any(lambda c: bounds(c, lambda v: v)) if isinstance(self.dtype, T.NumericType) else F.lit(False)
        return F.coalesce(self._number(bounds), F.lit(False))


def clause_predicate(df: DataFrame, spec: Clause | Mapping[str, Any]) -> Column:
    clause = Clause.of(spec)
    leaf = _Leaf(df, clause.field)
    if clause.eq is not None:
        return leaf.equals([clause.eq])
    if clause.in_values is not None:
        return leaf.equals(list(clause.in_values))
    return leaf.between(clause.gte, clause.lte)


def topic_predicate(topic: str | None, allowlist: Iterable[str] = ()) -> Column | None:
    """A topic off the allowlist matches nothing; no topic means every allowed one."""
    allowed = sorted(set(allowlist))
    if topic is None:
        return F.col("topic").isin(allowed) if allowed else None
    if allowed and topic not in allowed:
        return F.lit(False)
    return F.col("topic") == topic


def lookback_predicate(
    df: DataFrame, minutes: int, now_ms: int, max_minutes: int | None = None
) -> Column:
    """Events of the last ``minutes`` (one at least). A longer look-back than ``max_minutes`` is an error.

    Where the source's own ``event_time`` column is present the filter is put on it, which is
    equivalent for whole-millisecond cut-offs and can be pushed into the scan. Where the day is a column of its own (the event
    table's top folder) it is bounded as well, so folders of earlier days are not read.
    """
    if max_minutes is not None and minutes > max_minutes:
        raise ValueError(f"a look-back of {minutes} minutes exceeds the maximum of {max_minutes}")
    cutoff = int(now_ms) - max(1, int(minutes)) * 60_000
    if "event_time" in df.columns and isinstance(df.schema["event_time"].dataType, T.TimestampNTZType):
        return F.col("event_time") >= timeparts.ntz_of_ms(cutoff)
    recent = F.col("timestamp_ms") >= cutoff
    if "event_date" in df.columns:
        recent = recent & (F.col("event_date") >= F.lit(datetime.fromtimestamp(cutoff / 1000, timezone.utc).date()))
    return recent


def where(
    df: DataFrame,
    topic: str | None = None,
    minutes: int | None = None,
    clauses: Sequence[Clause | Mapping[str, Any]] = (),
    allowlist: Iterable[str] = (),
    now_ms: int | None = None,
    max_minutes: int | None = None,
) -> DataFrame:
    """The conjunction of all given conditions; with none the input comes back unchanged."""
    if len(clauses) > MAX_CLAUSES:
        raise ValueError(f"at most {MAX_CLAUSES} clauses")
    tests = []
    by_topic = topic_predicate(topic, allowlist)
    if by_topic is not None:
        tests.append(by_topic)
    if minutes is not None:
        if now_ms is None:
            raise ValueError("a look-back needs now_ms")
        tests.append(lookback_predicate(df, minutes, now_ms, max_minutes))
    tests += [clause_predicate(df, c) for c in clauses]
    return df.filter(reduce(and_, tests)) if tests else df


def where_in_table(df: DataFrame, field: str, values: DataFrame) -> DataFrame:
    """Membership in a column of another table, for value lists too long for a literal list."""
    leaf = _Leaf(df, field)
    if leaf.variant is not None or leaf.repeated:
        raise ValueError("needs a typed, single-valued field")
    keyed = df.withColumn("_k", leaf.column)
    return keyed.join(values.toDF("_k").dropDuplicates(), "_k", "left_semi").drop("_k")
