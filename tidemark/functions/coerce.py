"""Turning loosely typed answers into catalog values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The states of an annotation and the kinds of relationship.
STATUSES = ("pending", "inferred", "disabled", "failed")
RELATIONSHIP_TYPES = ("shared_key", "foreign_reference", "event_chain", "semantic")


def confidence(value: Column) -> Column:
    """A number clamped to [0, 1]; null for anything that is not a number."""
    number = value.try_cast("double")
    return F.when(
        number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    )


def status(value: Column) -> Column:
    return F.when(value.isin(*STATUSES), value).otherwise(F.lit("pending"))


def relationship_type(value: Column) -> Column:
    return F.when(value.isin(*RELATIONSHIP_TYPES), value).otherwise(F.lit("semantic"))
