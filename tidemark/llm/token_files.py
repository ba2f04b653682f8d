"""Token-ID output (operator 6): ORC files of ids in ascending document order, and reading them back.

A file holds whole documents of one range of ids: ``doc_id``, ``n_tokens``, ``part`` (rank of the file's range),
``at`` (ids of earlier documents in the same part) and ``ids``. ORC stores the id lists with its integer
run-length encoding; row indexes and Bloom filters on ``doc_id`` let a lookup skip stripes and row groups, and a
scan is split by stripes. ``part`` totals come from the narrow columns alone, so the position of a document in
the whole stream needs no pass over the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, id_and_text
from tidemark.llm.word_bpe import encoder

#: Bytes of text that are encoded at once: the more, the fewer pieces of them are distinct.
BLOCK_BYTES = 6 << 20
#: Rows of (part, first id) that may be broadcast: 16 MB.
BROADCAST_PARTS = 1_000_000
ORC_OPTIONS = {
    "compression": "snappy", "orc.stripe.size": str(8 << 20), "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, at = encoder(path), np.asarray([end_id], "<u4").tobytes(), 0
        part = TaskContext.get().partitionId()
        for batch in blocks(batches, most=BLOCK_BYTES):
            packed = [ids + end for ids in coder.encode(batch.column(1).to_pylist())]
            n = np.asarray([len(p) >> 2 for p in packed], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(at + offsets[:-1]), ids],
                ["doc_id", "n_tokens", "part", "at", "ids"],
            )
            at += int(offsets[-1])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes the files.

    Null or empty text: the end id alone. Null ids come first; rows of one id follow each other in any order, which
    is fixed when the files are written.
    """
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encoded = ordered.mapInArrow(_encode(tokenizer, end_id), "doc_id long, n_tokens long, part int, at long, ids array<int>")
    encoded.write.options(**ORC_OPTIONS).orc(folder)


FILE_COLUMNS = "doc_id long, n_tokens long, part int, at long, ids array<int>"


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    """part and base (ids of all earlier parts): one row per file, from the narrow columns alone."""
    totals = spark.read.schema(FILE_COLUMNS).orc(folder).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    base = _starts(spark, folder)
    few = base.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS
    files = spark.read.schema(FILE_COLUMNS).orc(folder)
    return files.join(F.broadcast(base) if few else base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents; the condition reaches the ORC reader's indexes and Bloom filters."""
    files = spark.read.schema(FILE_COLUMNS).orc(folder)
    return files.where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids (as little-endian unsigned 32-bit integers) of every document in files.

    Ids are checked where they are read; only the narrow rows meet the parts' starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat, cuts = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B"), lists.offsets.to_pylist()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
            n = np.diff(np.asarray(cuts, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(FILE_COLUMNS).orc(folder).mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(_starts(spark, folder), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
