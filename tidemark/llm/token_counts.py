"""Token counts (operator 1): lengths of frequent pieces from a broadcast table, the rest from worker caches.

Two tiers, and no pre-token is ever shuffled:

1. Frequent pieces. Each task feeds the white-space separated pieces of all texts to a frequent-items sketch
   (``approx_top_k_accumulate``); sketches are merged in two levels. The most frequent ``TABLE_PIECES`` come to
   the driver, their token counts are looked up once, and the table of lengths is broadcast. Its size is bounded
   by that parameter whatever the corpus holds. The table only saves work: no count depends on what is in it.
2. Misses are encoded in batches by the tokenizer in the worker and kept in the worker's bounded cache.

Texts are cut at ASCII white space, where no token goes across. Pieces of plain characters are looked up in lower case; other
pieces are looked up as they stand, and where they are missing the library encodes each once. Only texts with a special
token's string go through the library as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Recent, blocks, id_and_text, n_bytes, worker_state
from tidemark.llm.word_bpe import WordBpe

#: Entries of the broadcast table (under 2 MB), items a sketch tracks, and sketches merged at the second level.
TABLE_PIECES = 16_384
TRACKED = 65_536
GROUPS = 64
#: Other pieces in a generation of a worker's cache.
CACHE_PIECES = 160_000
#: Characters of a piece that is no plain one, up to which it is kept (text without white space has pieces of any length).
LONGEST_KEPT = 64
#: Between the white space of both Python and the tokenizer, and of ``frequent_pieces``.
_PIECE = re.compile("[^ \t\n\x0b\x0c\r]+")


def frequent_pieces(docs: DataFrame, size: int = TABLE_PIECES) -> list[str]:
    """About the ``size`` most frequent lower-case pieces of all texts, at most 64 characters each."""
    pieces = docs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("piece"), (F.spark_partition_id() % GROUPS).alias("part"))
    sketches = (
        pieces.where(F.length("piece").between(1, 64)).groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(piece, {TRACKED})").alias("sketch"))
    )
    # Grouped, so that an empty table gives no row.
    top = sketches.groupBy((F.col("part") * 0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {size})").alias("top"))
    return [r.item for row in top.collect() for r in row.top or [] if r.item is not None]


def _split(coder: WordBpe, text: str) -> tuple[list[str], list[str]] | None:
    """Plain pieces of a text in lower case and its other pieces as they stand; None if it has a special token's string."""
    lowered = text.lower()
    # Some plain letters are no longer plain in lower case.
    if coder.is_plain(text) and coder.is_plain(lowered):
        return lowered.split(), []
    if any(s in text for s in coder.special):
        return None
    plain, other = [], []
    for piece in _PIECE.findall(text):
        lowered = piece.lower()
        if coder.is_plain(piece) and coder.is_plain(lowered):
            plain += lowered.split()
        else:
            other.append(piece)
    return plain, other


def _counts(path: str, shared, over: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, rest = worker_state(("counts", path), lambda: (WordBpe(path, CACHE_PIECES), Recent(CACHE_PIECES)))
        frequent = shared.value
        lengths = lambda pieces: [len(ids) >> 2 for ids in coder.encode_pieces(pieces)]
        one_by_one = lambda pieces: [len(coder.library(p)) >> 2 for p in pieces]
        for batch in blocks(batches):
            texts = batch.column(1).to_pylist()
            split = [_split(coder, t) if t else ([], []) for t in texts]
            distinct = set().union(*(s[0] for s in split if s))
            others = set().union(*(s[1] for s in split if s))
            known = rest.fill(distinct.difference(frequent), lengths)
            known = {p: known[p] if p in known else frequent[p] for p in distinct}
            short = {p for p in others if len(p) <= LONGEST_KEPT}
            found = rest.fill(short.difference(frequent), one_by_one)
            known.update((p, found[p] if p in found else frequent[p]) for p in short)
            long = list(others - short)
            known.update(zip(long, one_by_one(long)))
            get = known.__getitem__
            counts = [sum(map(get, s[0])) + sum(map(get, s[1])) if s is not None else len(coder.library(t)) >> 2 for s, t in zip(split, texts)]
            n = np.asarray(counts, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > over)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row.

    Null or empty text: 0 bytes, 0 tokens. Rows with a null id and repeated rows keep their rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    pieces = frequent_pieces(rows)
    lengths = {}
    if pieces:
        coder = WordBpe(tokenizer)
        pieces = list(dict.fromkeys(pieces))
        plain = [p for p in pieces if coder.is_plain(p) and p.split() == [p]]
        lengths = {p: len(coder.library(p)) >> 2 for p in pieces if not coder.is_plain(p)}
        lengths |= {p: len(ids) >> 2 for p, ids in zip(plain, coder.encode_pieces(plain))}
    shared = docs.sparkSession.sparkContext.broadcast(lengths)
    return rows.withColumn("n_bytes", n_bytes(F.col("text"))).mapInArrow(
        _counts(tokenizer, shared, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
