"""Reading the catalog: listings, descriptions, field explanations, purpose search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import coerce, naming, vectors
from tidemark.operators import activity, sampling
from tidemark.operators.embedding import embed_column
from tidemark.operators.search import SCORE_DECIMALS, clamp_limit, results


def allowed_topics(topics: DataFrame, allowlist: Iterable[str] = ()) -> DataFrame:
    names = sorted(set(allowlist))
    return topics.filter(F.col("name").isin(names)) if names else topics


def list_names(topics: DataFrame) -> DataFrame:
    return topics.select("name").orderBy("name")


def raw_schema(topics: DataFrame, name: str) -> DataFrame:
    return topics.filter(F.col("name") == name).select("raw_schema_json")


def catalog_view(topics: DataFrame, fields: DataFrame, samples: DataFrame, profile: DataFrame) -> DataFrame:
    """One row per topic with its fields (by name), samples (newest first) and activity nested.

    The lists hold catalog rows: columns of a schema and the few kept samples.
    """
    listed = fields.groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("name", "type", "nullable", "default_json", "doc"))).alias("fields")
    )
    newest = F.array_sort(
        F.collect_list(F.struct((-F.col("timestamp_ms")).alias("age"), "partition", "offset", "timestamp_ms", "key", "value_json"))
    )
    kept = samples.groupBy("topic").agg(F.transform(newest, lambda s: s.dropFields("age")).alias("samples"))
    key = F.col("name").alias("topic")
    return (
        topics.withColumn("inference_status", coerce.status(F.col("inference_status")))
        .select(key, *[c for c in topics.columns if c != "name"])
        .join(listed, "topic", "left")
        .join(kept, "topic", "left")
        .join(profile, "topic", "left")
    )


def schema_overlay(declared: DataFrame, catalog_fields: DataFrame, annotations: DataFrame) -> DataFrame:
    """Registry fields with catalog meaning laid over: (topic, subject, version, schema_id, name, ...).

    ``declared`` has one row per registry field. For topics the registry does not know, the
    catalog's own fields are the schema.
    """
    known = catalog_fields.join(annotations, ["topic", "name"], "left")
    mine = known.select(
        "topic", "name", F.col("nullable").alias("_nullable"), F.col("doc").alias("_doc"), "inferred_meaning", "inferred_confidence"
    )
    laid = declared.join(mine, ["topic", "name"], "left").select(
        "topic", "subject", "version", "schema_id", "name", "type",
        (F.coalesce("nullable", F.lit(False)) | F.coalesce("_nullable", F.lit(False))).alias("nullable"),
        F.coalesce("doc", "_doc").alias("doc"), "inferred_meaning", "inferred_confidence",
    )
    orphans = known.join(declared.select("topic").distinct(), "topic", "left_anti").select(
        "topic", F.concat("topic", F.lit("-value")).alias("subject"),
        F.lit(None).cast("int").alias("version"), F.lit(None).cast("int").alias("schema_id"),
        "name", "type", "nullable", "doc", "inferred_meaning", "inferred_confidence",
    )
    return laid.unionByName(orphans)


def describe_topics(
    events: DataFrame,
    catalog: DataFrame,
    schema: DataFrame,
    sample_size: int = 5,
    allowlist: Iterable[str] = (),
    value_cap: int = 8192,
) -> DataFrame:
    """Count, window, description, schema and newest samples of every allowed topic."""
    names = sorted(set(allowlist))
    if names:
        events = events.filter(F.col("topic").isin(names))
        schema = schema.filter(F.col("topic").isin(names))
    listed = activity.list_topics(events, catalog, names)
    shape = schema.groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("name", "type", "nullable", "doc", "inferred_meaning", "inferred_confidence"))).alias("fields")
    )
    newest = results(sampling.newest_per_topic(events, sample_size), value_cap, None, "sample_rank")
    kept = newest.groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("sample_rank", "event_id", "timestamp_ms", "key", "value_json", "value_truncated"))).alias("samples")
    )
    status = catalog.select(F.col("name").alias("topic"), coerce.status(F.col("inference_status")).alias("inference_status"))
    return listed.join(shape, "topic", "left").join(kept, "topic", "left").join(status, "topic", "left")


def describe_topic(name: str, *tables: DataFrame, allowlist: Iterable[str] = (), **options) -> DataFrame:
    """:func:`describe_topics` for one name; off the allowlist only an empty shell comes back."""
    allowed = set(allowlist)
    events, catalog, schema = tables
    if allowed and name not in allowed:
        events, catalog, schema = (t.filter(F.lit(False)) for t in tables)
    return describe_topics(events, catalog, schema, allowlist=[name], **options)


def explain_fields(
    fields: DataFrame, annotations: DataFrame, samples: DataFrame, field: str, count: int = 5, topic: str | None = None
) -> DataFrame:
    """A field's entry, meaning and example values in the topics that have it."""
    entry = fields.filter(F.col("name") == field)
    if topic is not None:
        entry, samples = entry.filter(F.col("topic") == topic), samples.filter(F.col("topic") == topic)
    examples = sampling.example_values_of(samples, field, count)
    listed = examples.groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("example_rank", "example"))), lambda e: e["example"]).alias("example_values")
    )
    return entry.join(annotations, ["topic", "name"], "left").join(listed, "topic", "left")


def purpose_texts(topics: DataFrame, fields: DataFrame) -> DataFrame:
    """(name, purpose, description_source): the inferred description, else one made from field names."""
    listed = fields.groupBy("topic").agg(F.collect_list("name").alias("names"))
    joined = topics.join(listed, topics["name"] == listed["topic"], "left")
    given = F.coalesce(F.length("description") > 0, F.lit(False))
    made = naming.synthesized_description(F.col("name"), F.col("names"))
    return joined.select(
        "name", "description", "description_confidence",
        F.when(given, F.col("description")).otherwise(made).alias("purpose"),
        F.when(given, F.lit("inferred")).otherwise(F.lit("synthesized")).alias("description_source"),
    )


def topics_by_purpose(
    topics: DataFrame, fields: DataFrame, purpose: str, embedder, limit: int = 5, allowlist: Iterable[str] = ()
) -> DataFrame:
    """The topics whose description lies closest to a purpose, ties by name."""
    k, _ = clamp_limit(limit)
    described = purpose_texts(allowed_topics(topics, allowlist), fields)
    if not purpose or not purpose.strip():
        described = described.filter(F.lit(False))
        vector = [0.0] * embedder.dim
    else:
        [vector] = embedder.embed([purpose])
    scored = described.withColumn("embedding", embed_column(embedder, F.col("purpose")))
    score = F.round(vectors.cosine_to(vector, F.col("embedding")), SCORE_DECIMALS)
    return (
        scored.withColumn("score", score)
        .select("name", "score", "description", "description_confidence", "description_source")
        .orderBy(F.desc("score"), "name")
        .limit(k)
    )
