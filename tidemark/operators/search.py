"""Similarity search over stored events.

Scores are cosine similarities rounded to nine decimals before ranking and ties are broken by
``event_id``: the same rows come back however the table is split into tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ids import event_id
from tidemark.functions.json_text import struct_json
from tidemark.operators.filters import Clause, where

SCORE_DECIMALS = 9
VALUE_CAP = 8192
PREVIEW_RESERVE = 128
MMR_LAMBDA = 0.7
MMR_POOL = 3
#: Vectors of the corpus that meet in one group of a batch search, and query vectors in one block.
GROUP_BYTES = 64 << 20
QUERY_BLOCK_BYTES = 4 << 20
#: Rows of one packed piece of the corpus.
PIECE_ROWS = 4096
#: Scores a task holds at a time (16 MB).
SCORES_AT_ONCE = 2_000_000
#: Cell of vectors that have no angle to a pivot: null, all zeros, or of another length. They score zero.
NO_CELL = -1


class EventNotFound(LookupError):
    """A referenced event is missing, off the allowlist or holds no vector."""


def clamp_limit(limit: int, max_results: int | None = None) -> tuple[int, bool]:
    """(limit within [1, max], whether the maximum cut it). Without a maximum no limit is too large."""
    wanted = max(1, int(limit))
    clamped = wanted if max_results is None else min(wanted, max_results)
    return clamped, clamped < wanted


def flagged(found: DataFrame, max_results: int | None, cut: bool) -> DataFrame:
    """A caller that sets a maximum gets ``truncated``: whether fewer rows were looked for than asked."""
    return found if max_results is None else found.withColumn("truncated", F.lit(cut))


def cap_value(value_json: Column, cap: int = VALUE_CAP) -> tuple[Column, Column]:
    """(value or stub, flag). Sizes are counted in characters; a cap of zero or less disables it."""
    if cap <= 0:
        return value_json, F.lit(False)
    too_long = F.coalesce(F.length(value_json) > cap, F.lit(False))
    # The stub's keys.
    stub = F.struct(
        F.lit(True).alias("_truncated"),
        F.length(value_json).alias("_size_bytes"),
        F.substring(value_json, 1, max(0, cap - PREVIEW_RESERVE)).alias("_preview"),
    )
    return F.when(too_long, F.to_json(stub)).otherwise(value_json), too_long


def value_text(df: DataFrame) -> Column:
    """The value column as JSON text; anything that is no object shows as ``{}``."""
    if "value_json" in df.columns:
        is_object = F.col("value_json").rlike(r"^\s*\{")
        return F.when(is_object, F.col("value_json")).otherwise(F.lit("{}"))
    return F.coalesce(struct_json(F.col("value")), F.lit("{}"))


def results(df: DataFrame, value_cap: int = VALUE_CAP, score: Column | None = None, *more: str) -> DataFrame:
    """Rows as readers see them: coordinates, score, key text, capped value."""
    value, truncated = cap_value(value_text(df), value_cap)
    return df.select(
        event_id().alias("event_id"),
        F.coalesce("topic", F.lit("")).alias("topic"),
        F.coalesce("partition", F.lit(0)).alias("partition"),
        F.coalesce("offset", F.lit(0)).alias("offset"),
        F.coalesce("timestamp_ms", F.lit(0)).alias("timestamp_ms"),
        (F.lit(0.0) if score is None else score).alias("score"),
        F.col("key").cast("string").alias("key"),
        value.alias("value_json"),
        truncated.alias("value_truncated"),
        *more,
    )


def score_to(vector: Sequence[float], column: Column) -> Column:
    """Rounded cosine of a column against one vector, a batch at a time; 0.0 where a vector is null, zero or of another length."""
    query = np.asarray([float(x) for x in vector])
    size = np.sqrt(query @ query)
    if not len(query) or size <= 0:
        return F.lit(0.0)
    unit = query / size

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        rows = as_matrix(batch, len(unit))
        length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        return pa.array(np.round(np.divide(rows @ unit, length, out=np.zeros(len(rows)), where=length > 0), SCORE_DECIMALS))

    return score(column)


def _top(df: DataFrame, vector: Sequence[float], k: int, threshold: float | None = None, identity: Column | None = None) -> DataFrame:
    """The best ``k`` rows. A threshold gives the same rows after the limit as before it, and there
    it does not make Spark evaluate the vector column a second time."""
    scored = df.withColumn("score", score_to(vector, F.col("embedding")))
    best = scored.orderBy(F.desc("score"), event_id() if identity is None else identity).limit(k)
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def search(
    df: DataFrame,
    vector: Sequence[float],
    limit: int = 10,
    topic: str | None = None,
    minutes: int | None = None,
    threshold: float | None = None,
    clauses: Sequence[Clause | Mapping[str, Any]] = (),
    diverse: bool = False,
    allowlist: Iterable[str] = (),
    now_ms: int | None = None,
    max_results: int | None = None,
    value_cap: int = VALUE_CAP,
) -> DataFrame:
    """The ``limit`` events closest to a query vector, filtered before they are scored.

    Only the surviving rows' vectors are read; each task keeps its best ``limit`` rows and those
    alone are merged. ``diverse`` reranks a pool three times as large for variety and adds ``rank``.
    """
    k, cut = clamp_limit(limit, max_results)
    kept = where(df, topic, minutes, clauses, allowlist, now_ms)
    pool = _top(kept, vector, k * MMR_POOL if diverse else k, threshold)
    if not diverse:
        return flagged(results(pool, value_cap, F.col("score")), max_results, cut)
    shown = results(pool, value_cap, F.col("score"), "embedding")
    columns = [c for c in shown.columns if c != "embedding"]
    ranked = diversify(shown.withColumn("query_id", F.lit(0)), k, keep=columns).orderBy("rank").select(*columns, "rank")
    return flagged(ranked, max_results, cut)


def search_text(df: DataFrame, query: str, embedder, **options: Any) -> DataFrame:
    """Embed a query text and search; a blank query finds nothing."""
    if not query or not query.strip():
        return search(df.filter(F.lit(False)), [0.0] * embedder.dim, **options)
    [vector] = embedder.embed([query])
    return search(df, vector, **options)


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one batch as a matrix; a null or a vector of another length becomes zeros."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), width), False))
    matrix = np.zeros((len(column), width))
    matrix[fits] = np.asarray(column.filter(pa.array(fits)).flatten(), dtype=np.float64).reshape(-1, width)
    return matrix


class _BestPerQuery:
    """The running top-k of every query over the pieces of one group."""

    def __init__(self, k: int, n: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.query, self.row = np.empty(0, np.int64), np.empty(0, np.int64)
        self.score, self.ids = np.empty(0), np.empty(0, np.str_)

    def add(self, ids: np.ndarray, scores: np.ndarray, first_row: int) -> None:
        """``scores`` is (rows, queries). Ties stay in until they are broken by id."""
        floor = self.floor
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=0)[-self.k])
        rows, cols = np.nonzero(scores >= floor)
        query, score = np.concatenate([self.query, cols]), np.concatenate([self.score, scores[rows, cols]])
        found, row = np.concatenate([self.ids, ids[rows]]), np.concatenate([self.row, rows + first_row])
        order = np.lexsort((found, -score, query))
        query, score, found, row = query[order], score[order], found[order], row[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        keep = place < self.k
        self.query, self.score, self.ids, self.row = query[keep], score[keep], found[keep], row[keep]
        full = place == self.k - 1
        self.floor[query[full]] = score[full]


def _packed(rows: DataFrame, dim: int, kind: int, piece_rows: int, id_type: str, groups: int) -> DataFrame:
    """(group, kind, ids, vectors as bytes) with up to ``piece_rows`` rows of columns ``id`` and ``v`` in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, piece_rows):
                part = batch.slice(at, piece_rows)
                ids, matrix = part.column(0), as_matrix(part.column(1), dim)
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), listed, pa.array([matrix.tobytes()], pa.binary())], ["kind", "ids", "vectors"])

    made = rows.select("id", "v").mapInArrow(run, f"kind int, ids array<{id_type}>, vectors binary")
    if kind:  # Every block of queries meets every group.
        return made.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "*")
    return made.select(F.pmod(F.xxhash64("vectors", F.element_at("ids", 1)), F.lit(groups)).cast("int").alias("group"), "*")


def search_batch(
    df: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    query_id: str = "query_id",
    vector: str = "vector",
    max_results: int | None = None,
    exclude_self: bool = False,
    with_vectors: bool = False,
) -> DataFrame:
    """The best ``limit`` events for each of many query vectors: (query_id, event_id, score, rank), ``embedding`` if asked.

    Both sides are packed into pieces of many vectors. The corpus is dealt into groups of ``GROUP_BYTES``, each piece once; blocks of
    queries go to every group. A task holds one group and takes the blocks of queries one after the other: a matrix product
    each, of which at most ``limit`` rows a query go on. Spark keeps the best per query of a task before the exchange, then of
    all. Nothing of either side passes through the driver, whatever their number. Null query vectors find nothing.
    With ``max_results`` the rows carry ``truncated``. ``exclude_self`` drops the event whose id equals the query's.
    """
    k, cut = clamp_limit(limit, max_results)
    wanted = k + 1 if exclude_self else k
    asked = queries.select(F.col(query_id).alias("id"), F.col(vector).alias("v")).filter(F.size("v") > 0)
    # Two numbers: the vectors' length, and how many groups the corpus makes.
    dim = asked.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
    groups = max(1, math.ceil(df.count() * dim * 8 / GROUP_BYTES))
    id_type = queries.schema[query_id].dataType
    corpus = _packed(df.select(event_id().alias("id"), F.col("embedding").alias("v")), dim, 0, PIECE_ROWS, "string", groups)
    blocks = _packed(asked, dim, 1, max(1, QUERY_BLOCK_BYTES // (8 * dim)), id_type.simpleString(), groups)
    both = corpus.withColumnRenamed("ids", "events").unionByName(blocks.withColumnRenamed("ids", "queries"), allowMissingColumns=True)
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("event_id", T.StringType()), T.StructField("score", T.DoubleType())])
    if with_vectors:
        schema = schema.add("embedding", T.ArrayType(T.DoubleType()))
    found = both.select("group", "kind", "events", "queries", "vectors").repartition("group").sortWithinPartitions("group", "kind").mapInArrow(
        _score_groups(dim, wanted, with_vectors), schema
    )
    if exclude_self:
        found = found.filter(F.col("event_id") != F.col("query_id").cast("string"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "event_id")
    return flagged(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), max_results, cut)


def _score_groups(dim: int, k: int, with_vectors: bool):
    """Rows sorted by group, pieces of the corpus before blocks of queries: the pieces are held, the blocks pass."""

    def matrix_of(value) -> np.ndarray:
        return np.frombuffer(value.as_buffer(), np.float64).reshape(-1, dim)

    def units(rows: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)

    def scored(held: list[tuple[np.ndarray, np.ndarray]], names: pa.Array, queries: np.ndarray) -> pa.RecordBatch | None:
        best, first = _BestPerQuery(k, len(queries)), 0
        unit = units(queries)
        for ids, rows in held:
            step = max(1, SCORES_AT_ONCE // len(unit))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                length = np.linalg.norm(part, axis=1, keepdims=True)
                scores = np.divide(part @ unit.T, length, out=np.zeros((len(part), len(unit))), where=length > 0)
                best.add(ids[at : at + step], np.round(scores, SCORE_DECIMALS), first + at)
            first += len(rows)
        if not len(best.ids):
            return None
        columns = {"query_id": names.take(pa.array(best.query)), "event_id": pa.array(best.ids.tolist(), pa.string()), "score": pa.array(best.score)}
        if with_vectors:
            whole = np.concatenate([rows for _, rows in held])[best.row]
            offsets = np.arange(0, (len(whole) + 1) * dim, dim, dtype=np.int32)
            columns["embedding"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole.ravel()))
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                number, kind = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if number != group:
                    group, held = number, []
                matrix = matrix_of(batch.column(4)[i])
                if kind == 0:
                    held.append((np.asarray(batch.column(2)[i].values.to_pylist(), dtype=np.str_), matrix))
                elif held and (out := scored(held, batch.column(3)[i].values, matrix)) is not None:
                    yield out

    return run


def diversify(
    pool: DataFrame,
    limit: int,
    weight: float = MMR_LAMBDA,
    keep: Sequence[str] = ("event_id", "score"),
) -> DataFrame:
    """Maximal marginal relevance per ``query_id``: (query_id, kept columns, rank).

    The pool of a query is three times its limit.
    Candidates arrive best first; the earliest of equal candidates is taken. One without a vector
    competes with its plain relevance and repels nobody.
    """
    kept = ["query_id", *keep]
    schema = T.StructType([pool.schema[c] for c in kept]).add("rank", T.IntegerType())

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "event_id"], ascending=[False, True], kind="stable")
        relevance = group["score"].to_numpy(float)
        present = group["embedding"].notna().to_numpy()
        width = max((len(v) for v in group["embedding"][present]), default=0)
        units = np.zeros((len(group), width))
        for i in np.flatnonzero(present):
            v = np.asarray(group["embedding"].iloc[i], dtype=float)
            size = np.sqrt(v @ v)
            if size > 0 and len(v) == width:
                units[i] = v / size
        closest = np.zeros(len(group))
        repelled, taken = False, []
        open_ = np.ones(len(group), bool)
        for _ in range(min(limit, len(group))):
            gain = np.where(present, weight * relevance - (1 - weight) * closest, relevance)
            best = int(np.argmax(np.where(open_, gain, -np.inf)))
            taken.append(best)
            open_[best] = False
            if present[best]:
                likeness = units @ units[best]
                closest = np.maximum(closest, likeness) if repelled else likeness
                repelled = True
        out = group.iloc[taken][kept].copy()
        out["rank"] = np.arange(1, len(taken) + 1, dtype=np.int32)
        return out

    return pool.select(*kept, "embedding").groupBy("query_id").applyInPandas(pick, schema)


def search_batch_diverse(df: DataFrame, queries: DataFrame, limit: int = 10, **options: Any) -> DataFrame:
    """Diverse results for many queries: a pool by :func:`search_batch` that carries its vectors, reranked."""
    k, _ = clamp_limit(limit)
    return diversify(search_batch(df, queries, k * MMR_POOL, with_vectors=True, **options), k)


def split_reference(reference: str) -> tuple[str, int, int]:
    """``topic:partition:offset`` read from the right, or :class:`EventNotFound`."""
    topic, *numbers = (reference or "").rsplit(":", 2)
    if not topic or len(numbers) != 2 or not all(n.isascii() and n.isdigit() for n in numbers):
        raise EventNotFound(f"not a topic:partition:offset reference: {reference!r}")
    return topic, int(numbers[0]), int(numbers[1])


def lookup(df: DataFrame, reference: str) -> DataFrame:
    """The one event at a reference; the topic and offset conditions prune the scan."""
    topic, partition, offset = split_reference(reference)
    return df.filter((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") == offset))


def similar(
    df: DataFrame,
    reference: str,
    limit: int = 10,
    allowlist: Iterable[str] = (),
    max_results: int | None = None,
    value_cap: int = VALUE_CAP,
) -> DataFrame:
    """Events most like a stored one, without the event itself."""
    allowed = set(allowlist)
    topic, partition, offset = split_reference(reference)
    if allowed and topic not in allowed:
        raise EventNotFound(reference)
    row = lookup(df, reference).select("embedding").first()
    if row is None or row.embedding is None:
        raise EventNotFound(reference)
    others = df.filter(
        ~((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") == offset))
    )
    return search(others, row.embedding, limit, allowlist=allowed, max_results=max_results, value_cap=value_cap)


def similar_batch(df: DataFrame, references: DataFrame, limit: int = 10) -> DataFrame:
    """More-like-this for a table of ``event_id`` references; unknown ones give no rows."""
    wanted = references.select("event_id").dropDuplicates()
    known = df.select(event_id().alias("event_id"), "embedding").join(wanted, "event_id", "left_semi")
    queries = known.filter(F.col("embedding").isNotNull()).select(
        F.col("event_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    return search_batch(df, queries, limit, exclude_self=True)


# -- pruned search: fewer rows scored, same answer -------------------------------------------------


def choose_pivots(df: DataFrame, count: int = 16) -> list[list[float]]:
    """A fixed number of stored vectors to measure others against, picked by hash order."""
    usable = df.filter(F.col("embedding").isNotNull()).select(event_id().alias("event_id"), "embedding")
    rows = usable.orderBy(F.xxhash64("event_id"), "event_id").limit(count).collect()
    return [[float(x) for x in row.embedding] for row in rows]


def assign_cells(df: DataFrame, pivots: Sequence[Sequence[float]]) -> DataFrame:
    """Add the nearest pivot (``cell``) and the angle to it (``radius``); ``NO_CELL`` for vectors that have no angle.

    Write the result partitioned by ``cell`` and sorted by ``radius``: the conditions of
    :func:`pruned_top` then skip whole folders and row groups.
    """
    matrix = np.asarray(pivots, dtype=np.float64)
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    @F.arrow_udf("struct<cell: int, radius: double>")
    def place(batch: pa.Array) -> pa.Array:
        rows = as_matrix(batch, matrix.shape[1])
        size = np.linalg.norm(rows, axis=1, keepdims=True)
        cosines = np.divide(rows @ matrix.T, size, out=np.zeros((len(rows), len(matrix))), where=size > 0)
        cell = np.argmax(cosines, axis=1)
        angle = np.arccos(np.clip(cosines[np.arange(len(rows)), cell], -1.0, 1.0))
        none = size[:, 0] <= 0
        cell[none], angle[none] = NO_CELL, 0.0
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle)], ["cell", "radius"])

    return df.withColumn("_p", place("embedding")).withColumns(
        {"cell": F.col("_p.cell"), "radius": F.col("_p.radius")}
    ).drop("_p")


def pruned_top(
    celled: DataFrame, pivots: Sequence[Sequence[float]], vector: Sequence[float], k: int, probes: int | None = None, identity: Column | None = None
) -> DataFrame:
    """The best ``k`` rows and their ``score``, without those that the triangle inequality rules out.

    The nearest cells give a first top-k and with it the score to beat. Any better row must lie
    within that angle of the query, so its angle to its own pivot is at least the query's less that, and, its pivot being
    the nearest, at most the query's angle to its nearest pivot and that: one range per cell, none for cells too far off. Vectors without an angle cannot beat a positive score. With ``probes`` only that
    many of the nearest cells are looked at (and the rows without an angle are not): approximate.
    """
    query = np.asarray(vector, dtype=np.float64)
    matrix = np.asarray(pivots, dtype=np.float64)
    scale = np.linalg.norm(matrix, axis=1) * np.linalg.norm(query)
    angles = np.arccos(np.clip(np.divide(matrix @ query, scale, out=np.zeros(len(matrix)), where=scale > 0), -1.0, 1.0))
    order = np.argsort(angles)
    if probes is not None:
        return _top(celled.filter(F.col("cell").isin([int(c) for c in order[:probes]])), vector, k, identity=identity)
    near, width = [], 1
    while len(near) < k and width < 2 * len(order):
        cells = [int(c) for c in order[:width]]
        near = _top(celled.filter(F.col("cell").isin(cells)), vector, k, identity=identity).select("score").collect()  # k numbers
        width *= 2
    # With fewer rows than asked for, nothing can be ruled out: the reach is half a turn.
    floor = min((row.score for row in near), default=-1.0) if len(near) >= k else -1.0
    reach = float(np.arccos(np.clip(floor, -1.0, 1.0))) + 1e-6
    furthest = float(angles.min()) + reach
    bounds = [
        (F.col("cell") == int(c)) & F.col("radius").between(float(angles[c]) - reach, furthest)
        for c in range(len(matrix)) if angles[c] - reach <= furthest
    ]
    if floor <= 0.0:
        bounds.append(F.col("cell") == NO_CELL)
    return _top(celled.filter(reduce(or_, bounds)), vector, k, identity=identity)


def search_pruned(
    celled: DataFrame,
    pivots: Sequence[Sequence[float]],
    vector: Sequence[float],
    limit: int = 10,
    max_results: int | None = None,
    value_cap: int = VALUE_CAP,
) -> DataFrame:
    """Exact top-k over rows with their cells; :mod:`tidemark.plans.vector_index` keeps these beside the event table."""
    k, cut = clamp_limit(limit, max_results)
    return flagged(results(pruned_top(celled, pivots, vector, k), value_cap, F.col("score")), max_results, cut)
