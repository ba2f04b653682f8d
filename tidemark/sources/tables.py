"""Relational tables read as topics of events.

Identity is taken from the rows' own keys: an offset only has to be unique and increasing inside
its (topic, partition), so no numbering window is needed and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeparts import epoch_ms_ntz

PARTITIONS = 4


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _as_events(df: DataFrame, topic, partition_key, offset, time_ms, key, value: Column, *more: Column) -> DataFrame:
    return df.select(
        topic.alias("topic"),
        (partition_key % PARTITIONS).cast("int").alias("partition"),
        offset.cast("long").alias("offset"),
        time_ms.alias("timestamp_ms"),
        key.cast("string").alias("key"),
        value.alias("value"),
        *more,
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """``events``: one topic per event type. ``event_time`` stays as read, so time filters reach the scan."""
    df = load(spark, folder, "events")
    return _as_events(
        df,
        F.col("event_type"),
        F.col("user_id"),
        F.col("event_id"),
        epoch_ms_ntz(F.col("ts")),
        F.col("user_id"),
        F.struct("event_id", "user_id", "value", F.from_json("props", "k BIGINT").alias("props")),
        F.col("ts").alias("event_time"),
    )


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations``: one topic per role; the offset packs (conversation, turn)."""
    df = load(spark, folder, "conversations")
    return _as_events(
        df,
        F.col("role"),
        F.col("conv_id"),
        F.shiftleft("conv_id", 20) + F.col("turn"),
        (F.lit(1_704_067_200_000) + F.col("conv_id") * 60_000 + F.col("turn") * 1_000),
        F.col("conv_id"),
        F.struct("conv_id", "turn", "text"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``documents``: one topic per language."""
    df = load(spark, folder, "documents")
    return _as_events(
        df,
        F.col("lang"),
        F.col("doc_id"),
        F.col("doc_id"),
        F.lit(1_704_067_200_000) + F.col("doc_id"),
        F.col("source"),
        F.struct("doc_id", "text", "lang", "source", "n_chars"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as stored events with their vector: one topic per label."""
    df = load(spark, folder, "embeddings")
    return _as_events(
        df,
        F.concat(F.lit("label"), F.col("label").cast("string")),
        F.col("vec_id"),
        F.col("vec_id"),
        F.lit(1_704_067_200_000) + F.col("vec_id") * 60_000,
        F.col("vec_id"),
        F.struct("vec_id", "label"),
        F.col("embedding"),
    )


def relational(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Eight topics whose shared identifiers carry the same name, as producers would name them."""
    t = {n: load(spark, folder, n) for n in ("customer", "supplier", "part", "orders", "lineitem", "documents", "labels", "nation")}
    return {
        "customers": t["customer"].select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
            F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment"),
        ),
        "suppliers": t["supplier"].select(
            F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation_id"),
        ),
        "parts": t["part"].select(
            F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        ),
        "orders": t["orders"].select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"),
        ),
        "lineitems": t["lineitem"].select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("supplier_id"), F.col("l_quantity").alias("quantity"),
        ),
        "documents": t["documents"].select("doc_id", "lang", "source"),
        "labels": t["labels"].select("doc_id", "quality", "toxic"),
        "nations": t["nation"].select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("name")),
    }
