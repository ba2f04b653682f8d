"""All registered queries and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.json_text import canonical_value
from tidemark.operators import search
from tidemark.operators.embedding import HashingEmbedder, embed_column
from tidemark.plans import inputs, queries_catalog, queries_events, queries_relations, queries_search
from tidemark.sources import tables

FAMILIES = (queries_events, queries_search, queries_catalog, queries_relations)
QUERIES = {name: fn for family in FAMILIES for name, fn in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    embedder = HashingEmbedder(64)
    events = tables.events(spark, folder)
    embedded = events.withColumn("embedding", embed_column(embedder, canonical_value(F.col("value"))))
    return search.search_text(
        embedded, "purchase value 42", embedder, limit=20, minutes=10_080, now_ms=inputs.NOW_MS,
        clauses=[{"field": "value.value", "gte": 5}], threshold=0.0,
    )
