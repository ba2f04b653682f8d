"""Vector arithmetic on ``array<float>`` columns, computed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when either is null or empty, lengths differ, or a norm is zero."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    scale = norm(a) * norm(b)
    return F.when(usable & (scale > 0), F.try_divide(dot(a, b), scale)).otherwise(F.lit(0.0))


def cosine_to(vector: Sequence[float], column: Column) -> Column:
    """Cosine of a column against one fixed vector, whose norm is folded in on the driver."""
    values = [float(x) for x in vector]
    length = sum(x * x for x in values) ** 0.5
    if not values or length <= 0.0:
        return F.lit(0.0)
    unit = literal([x / length for x in values])
    size = norm(column)
    usable = (F.size(column) == len(values)) & (size > 0)
    return F.when(usable, F.try_divide(dot(column, unit), size)).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: F.try_divide(x.cast("double"), size))).otherwise(
        F.transform(a, lambda x: x.cast("double"))
    )
