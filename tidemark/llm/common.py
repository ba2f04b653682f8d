"""Helpers of the operators: tables, the shared folder, and state that lives as long as a Python worker."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python kernel handles at once; bounds a worker's memory.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder that driver and executors both see: below ``spark.checkpoint.dir``.

    Only a single-process session without that setting (tests, a laptop) gets a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, and a lost executor costs a file read."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_state(key: tuple, build: Callable[[], Any]) -> Any:
    """What ``build`` returns, made once per Python worker and key, and kept for its later tasks.

    Workers outlive the stages of a pipeline, so one state is kept at a time: the caches of a stage that is over make room
    for those of the next.
    """
    kept = sys.__dict__.setdefault("_tidemark_llm_state", {})
    if key not in kept:
        kept.clear()
        kept[key] = build()
    return kept[key]


def byte_column(column: pa.Array) -> pa.Array:
    """A string column as bytes, without copying the text."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again in slices of about ``most`` bytes of text (a longer text is a slice of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def n_bytes(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


class Recent:
    """A bounded cache in two generations: what was not used while ``size`` new entries came in is forgotten."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def fill(self, keys: set, make: Callable[[list], list]) -> dict:
        """A dict that holds all of ``keys``; values not cached are made by ``make`` from a list of keys."""
        missing = keys.difference(self.young)
        if len(self.young) + len(missing) > self.size:
            self.old, self.young = self.young, {}
            missing = keys
        if missing and self.old:
            known = missing.intersection(self.old)
            self.young.update((k, self.old[k]) for k in known)
            missing = missing.difference(known)
        if missing:
            new = list(missing)
            self.young.update(zip(new, make(new)))
        return self.young
