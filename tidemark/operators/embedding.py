"""Embedders and the jobs that apply them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import null_safe_join


class Embedder(Protocol):
    """Texts in, vectors of one fixed length out."""

    dim: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class HashingEmbedder:
    """A model-free embedder: signed word counts hashed into ``dim`` buckets, unit length.

    A word's bucket is the first four hex digits of its MD5 modulo ``dim``; the fifth digit gives
    the sign. The JVM splits and hashes whole texts; only five digits per word cross to Python, where
    a batch is counted in one vectorised step.
    """

    words = r"[\p{L}\p{N}]+"

    def __init__(self, dim: int = 64):
        if dim < 1:
            raise ValueError("dim must be positive")
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        rows = []
        for text in texts:
            counts = np.zeros(self.dim)
            for word in re.findall(r"[^\W_]+", text.lower()):
                digest = hashlib.md5(word.encode()).hexdigest()
                counts[int(digest[:4], 16) % self.dim] += 1.0 if digest[4] < "8" else -1.0
            size = np.sqrt(counts @ counts)
            rows.append((counts / size if size > 0 else counts).tolist())
        return rows

    def column(self, text: Column) -> Column:
        dim = self.dim
        found = F.regexp_extract_all(F.lower(text), F.lit(self.words), F.lit(0))
        digests = F.transform(found, lambda w: F.substring(F.md5(w), 1, 5))
        digit = np.zeros(256, np.int64)
        for i, c in enumerate(b"0123456789abcdef"):
            digit[c] = i

        @F.arrow_udf("array<double>")
        def count_words(batch: pa.Array) -> pa.Array:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch), 0))
            rows = np.repeat(np.arange(len(batch)), sizes)
            flat = batch.flatten().cast(pa.binary(5))
            hexes = np.frombuffer(flat.buffers()[1], np.uint8) if len(flat) else np.empty(0, np.uint8)
            parts = digit[hexes[flat.offset * 5 : (flat.offset + len(flat)) * 5].reshape(-1, 5)]
            bucket = (parts[:, :4] @ np.array([4096, 256, 16, 1])) % dim
            sign = np.where(parts[:, 4] < 8, 1.0, -1.0)
            counts = np.bincount(rows * dim + bucket, weights=sign, minlength=len(batch) * dim).astype(np.float64)
            counts = counts.reshape(len(batch), dim)
            size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            np.divide(counts, size, out=counts, where=size > 0)
            offsets = np.arange(0, (len(batch) + 1) * dim, dim, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel()))

        return count_words(digests)


def model_column(factory: Callable[[], Embedder], text: Column) -> Column:
    """Apply any embedder; the factory runs once per Python worker, batches arrive by Arrow."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            vectors_out = model.embed(batch.fillna("").tolist())
            yield pd.Series([list(map(float, v)) for v in vectors_out])

    return run(text)


def embed_column(embedder: Embedder | Callable[[], Embedder], text: Column) -> Column:
    """An embedder that offers an expression of its own is used as one, others run in Python."""
    if hasattr(embedder, "column"):
        return embedder.column(text)  # type: ignore[union-attr]
    return model_column(embedder if callable(embedder) else (lambda: embedder), text)


def require_dim(found: int, wanted: int) -> None:
    if found != wanted:
        raise ValueError(f"embedder produces vectors of length {found}, the event table holds length {wanted}")


def probe_dim(embedder: Embedder, wanted: int) -> None:
    """Embed one probe text and compare its length before any data is touched."""
    [probe] = embedder.embed(["dimension probe"])
    require_dim(len(probe), wanted)


def assert_dim(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Fail the write when a vector of another length turns up."""
    ok = F.size(column) == dim
    message = F.concat(F.lit(f"expected vectors of length {dim}, got "), F.size(column).cast("string"))
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(message)))


def embed_distinct(
    df: DataFrame,
    embedder: Embedder | Callable[[], Embedder],
    cache: DataFrame | None = None,
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Embed each different text once, reusing a cache table ``(text_hash, embedding)``.

    Returns (rows with ``embedding``, new cache rows). Repeats collapse map-side before the model
    runs, so a text held by a third of all rows costs one call; the way back is a hash-keyed join
    that adaptive execution splits when one text is hot.
    """
    hashed = df.withColumn("text_hash", F.sha2(F.col(text), 256))
    todo = hashed.select("text_hash", text).filter(F.col(text).isNotNull()).dropDuplicates(["text_hash"])
    if cache is not None:
        todo = todo.join(cache.select("text_hash"), "text_hash", "left_anti")
    fresh = todo.select("text_hash", embed_column(embedder, F.col(text)).alias("embedding"))
    known = fresh if cache is None else cache.select("text_hash", "embedding").unionByName(fresh)
    return hashed.join(known, "text_hash", "left").drop("text_hash"), fresh


def reuse_counts(df: DataFrame, by: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """How many texts per group were repeats (hits) and how many were new (misses).

    A text is new where its first occurrence in ``order`` lies; the first occurrence per text is
    found with one combining aggregate, not a window, so a hot text costs one row per map task.
    """
    first = df.filter(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("h")).agg(
        F.min_by(F.struct(*by), F.struct(*order)).alias("g"), F.count(F.lit(1)).alias("n")
    )
    misses = first.groupBy("g").agg(F.count(F.lit(1)).alias("misses")).select("g.*", "misses")
    totals = df.filter(F.col(text).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("texts"))
    joined = null_safe_join(totals, misses, list(by), "left").withColumn("misses", F.coalesce("misses", F.lit(0)))
    return joined.select(*by, "texts", "misses", (F.col("texts") - F.col("misses")).alias("hits"))


def unit_floats(column: Column) -> Column:
    """Vectors at unit length as ``array<float>``, the form that is stored; zero vectors stay zero, nulls null."""

    @F.arrow_udf("array<float>")
    def scale(batch: pa.Array) -> pa.Array:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(batch), 0))
        flat = np.asarray(batch.flatten().cast(pa.float64()), dtype=np.float64)
        row = np.repeat(np.arange(len(batch)), lengths)
        size = np.sqrt(np.bincount(row, flat * flat, len(batch)))[row]
        unit = np.divide(flat, size, out=flat.copy(), where=size > 0).astype(np.float32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit), mask=pc.is_null(batch))

    return scale(column)


def normalized(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit-length vectors, so that later scoring is a dot product."""
    return df.withColumn(column, unit_floats(F.col(column)))
