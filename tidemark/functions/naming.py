"""Rules over field names, type labels and topic names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names and suffixes that mark an identifier, and the texts shown to readers.
ID_NAMES = ("id", "uuid", "pk")
ID_SUFFIXES = ("_id", "_uuid", "_key")
RATIONALE = "Field '%s' matches in both topics with type %s; sample overlap ratio %.2f."
DESCRIPTION_WITH_FIELDS = "Kafka topic '%s' with fields: %s."
DESCRIPTION_BARE = "Kafka topic '%s'."
UNSAMPLED_CONFIDENCE = 0.4
MAX_CONFIDENCE = 0.95
BASE_CONFIDENCE = 0.55


def last_segment(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def is_identifier(path: Column) -> Column:
    return last_segment(path).rlike(f"^({'|'.join(ID_NAMES)})$|({'|'.join(ID_SUFFIXES)})$")


def base_type(label: Column) -> Column:
    """The label up to its first ``<``: two labels are compatible when their base types agree."""
    return F.substring_index(label, "<", 1)


def is_primary_identifier(topic: Column, path: Column) -> Column:
    """Whether the field names the topic itself: ``id``-like, ``<topic>_id`` or its singular form."""
    name = F.lower(topic)
    leaf = last_segment(path)
    return (
        path.isin(*ID_NAMES)
        | (leaf == F.concat(name, F.lit("_id")))
        | (name.endswith("s") & (leaf == F.concat(F.regexp_replace(name, "s$", ""), F.lit("_id"))))
    )


def overlap_ratio(shared: Column, left: Column, right: Column) -> Column:
    """|A and B| over the smaller of |A| and |B|; null when a side has no values."""
    return F.when((left > 0) & (right > 0), F.try_divide(shared.cast("double"), F.least(left, right)))


def edge_confidence(overlap: Column) -> Column:
    scored = F.least(F.lit(MAX_CONFIDENCE), F.lit(BASE_CONFIDENCE) + overlap / 2)
    return F.when(overlap.isNull(), F.lit(UNSAMPLED_CONFIDENCE)).otherwise(scored)


def edge_rationale(path: Column, label: Column, overlap: Column) -> Column:
    return F.format_string(RATIONALE, path, label, F.coalesce(overlap, F.lit(0.0)))


def synthesized_description(topic: Column, names: Column) -> Column:
    """A stand-in description from the topic name and its first eight field names."""
    listing = F.array_join(F.slice(F.array_sort(names), 1, 8), ", ")
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.format_string(DESCRIPTION_WITH_FIELDS, topic, listing)).otherwise(
        F.format_string(DESCRIPTION_BARE, topic)
    )
