"""The corpus pipeline: documents that pass the quality rules, one of each group of near copies, without repeated
passages, without benchmark texts, as token ids.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, near_dedup, quality_rules, repeats, sentence_pieces
from tidemark.llm.common import table, written
from tidemark.llm.queries import PIECE_MODEL


def rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the default policy."""
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near copies."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier; ``n_chars`` follows. A document of which nothing but white space is left goes."""
    return repeats.without_repeats(docs)


def benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text they decode to."""
    return sentence_pieces.digests(sentence_pieces.round_trip(docs, PIECE_MODEL))


STAGES = [
    ("quality rules", rule_filter),
    ("near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("decontamination", benchmark_texts),
    ("sentence pieces", token_ids),
]

#: SQL has no SentencePiece; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
