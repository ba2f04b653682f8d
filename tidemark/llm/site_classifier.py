"""Quality classifier (operator 7): evidence of a document, shrunk and shifted by its host and path.

Document evidence comes from two logistic regressions (quality and toxicity) over hashed words, weighted by rarity, and a few shares of
the text, with a ridge chosen by folds, fitted on at most ``TRAIN_ROWS`` labelled rows (those of least hash, so the choice is the same every time). All
documents are scored.

The scores are then taken per path, per host and over all, as sums in one grouped aggregation each. Hierarchical empirical
Bayes: a host's mean is shrunk toward the global mean, a path's toward its host's, each by a strength that the
aggregates themselves give (variance inside groups over variance between them): a path with few documents says
little, one with many speaks for itself. A document's posterior log-odds are its evidence plus what its path's
prior odds differ from the global ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, byte_column, worker_state, written

BUCKETS = 1 << 16
TRAIN_ROWS = 6000
STEPS = 150
#: Steps of the runs that only choose the ridge.
TRIAL_STEPS = 60
RIDGES = (1e-5, 1e-4, 1e-3, 1e-2)
FOLDS = 3
#: Training rows a bucket must occur in to get a weight.
LEAST_ROWS = 4
#: Shares of a text that single words do not show: symbols, capitals, digits, word repeats, words with a symbol.
SHARES = 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>!")] = True


class Features:
    """Hashed distinct words and shares of texts; buckets of words are kept in the worker."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def _buckets(self, words: set[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        missing = words.difference(self.known)
        if len(self.known) + len(missing) > self.limit:
            self.known.clear()
            missing = words
        self.known.update((w, xxh3_64_intdigest(w) % BUCKETS) for w in missing)
        return np.unique(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct buckets, and the shares (zero for a text without words)."""
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.int32), np.zeros(SHARES, np.float32)
        distinct = set(words)
        data = np.frombuffer(text, np.uint8)
        shares = np.asarray([
            min(1.0, _SYMBOLS[data].sum() / len(words)), ((data >= 65) & (data <= 90)).mean(), ((data >= 48) & (data <= 57)).mean(),
            1 - len(distinct) / len(words), min(1.0, 50 / len(words)),
        ], np.float32)
        return self._buckets(distinct), shares


@dataclass(frozen=True)
class Model:
    """Weights of buckets and shares (one column per target), the intercepts, and what a bucket's presence counts for."""

    words: np.ndarray
    shares: np.ndarray
    bias: np.ndarray
    idf: np.ndarray

    def score(self, buckets: np.ndarray, shares: np.ndarray) -> np.ndarray:
        value = self.idf[buckets]
        return value @ self.words[buckets] / np.sqrt(1.0 + value @ value) + shares @ self.shares + self.bias


def _descend(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray, target: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression of one target by accelerated gradient steps of one length for all weights, so that a weight
    grows with its evidence: words of few rows stay small."""
    rate = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    # Both classes weigh the same, so a rare class is learned too.
    weight = np.where(target == 1, 0.5 / rate, 0.5 / (1 - rate)) / len(target)
    size = np.bincount(doc, value * value, len(target)) + (dense * dense).sum(axis=1) + 1
    step = 1 / (0.25 * float((weight * size).sum()) + ridge)
    now = [np.zeros(BUCKETS), np.zeros(SHARES), np.zeros(1)]
    ahead = now
    for k in range(1, steps + 1):
        z = np.bincount(doc, value * ahead[0][bucket], len(target)) + dense @ ahead[1] + ahead[2]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grads = [np.bincount(bucket, value * error[doc], BUCKETS) + ridge * ahead[0], dense.T @ error + ridge * ahead[1], error.sum(keepdims=True)]
        new = [x - step * g for x, g in zip(ahead, grads)]
        ahead = [x + k / (k + 3) * (x - y) for x, y in zip(new, now)]
        now = new
    return now[0], now[1], float(now[2][0])


def _loss(z: np.ndarray, target: np.ndarray) -> float:
    rate = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    weight = np.where(target == 1, 0.5 / rate, 0.5 / (1 - rate))
    return float((weight * np.logaddexp(0, np.where(target == 1, -z, z))).mean())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray) -> Model:
    """A logistic regression for each target, with the ridge of ``RIDGES`` that does best over ``FOLDS`` folds of the rows.

    Words weigh by the log of their rarity among the rows, relative to the text's norm. Without rows all scores are zero.
    """
    k = targets.shape[1] if len(rows) else 2
    words, shares, bias = np.zeros((BUCKETS, k)), np.zeros((SHARES, k)), np.zeros(k)
    if not len(rows):
        return Model(words, shares, bias, np.zeros(BUCKETS))
    # Buckets of a few rows say nothing beyond these.
    seen = np.bincount(np.concatenate([b for b, _ in rows]), minlength=BUCKETS)
    idf = np.where(seen >= LEAST_ROWS, np.log1p(len(rows) / np.maximum(seen, 1)), 0.0)
    lengths = np.asarray([len(b) for b, _ in rows])
    doc, bucket = np.repeat(np.arange(len(rows)), lengths), np.concatenate([b for b, _ in rows])
    doc, bucket = doc[idf[bucket] > 0], bucket[idf[bucket] > 0]
    norm = np.sqrt(1.0 + np.bincount(doc, idf[bucket] ** 2, len(rows)))
    value, dense, fold = idf[bucket] / norm[doc], np.asarray([s for _, s in rows], float), np.arange(len(rows)) % FOLDS
    for j in range(k):
        target, losses = targets[:, j], []
        for ridge in RIDGES:
            total = 0.0
            for f in range(FOLDS):
                inside, use = fold != f, fold[doc] != f
                if not inside.any() or inside.all():
                    continue
                place = np.cumsum(inside) - 1
                w, s, b = _descend(place[doc[use]], bucket[use], value[use], dense[inside], target[inside], ridge, TRIAL_STEPS)
                z = np.bincount(doc[~use], value[~use] * w[bucket[~use]], len(rows)) + dense @ s + b
                total += _loss(z[~inside], target[~inside])
            losses.append(total)
        words[:, j], shares[:, j], bias[j] = _descend(doc, bucket, value, dense, target, RIDGES[int(np.argmin(losses))], STEPS)
    return Model(words, shares, bias, idf)


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = worker_state(("features",), Features)
        for batch in blocks(batches):
            made = [maker.of(t) for t in byte_column(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.tolist() for b, _ in made], pa.list_(pa.int32())), pa.array([s.tolist() for _, s in made], pa.list_(pa.float32())), *batch.columns[2:]],
                ["buckets", "shares", "quality", "toxic"],
            )

    return rows.select("doc_id", "text", "quality", "toxic").mapInArrow(run, "buckets array<int>, shares array<float>, quality int, toxic int")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of at most ``rows`` labelled documents; labels without a class, a document or a text are left out."""
    marks = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")
    ).dropna().dropDuplicates(["doc_id"])
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).dropna()
    some = _featured(texts.join(chosen, "doc_id")).toArrow()
    made = [(np.asarray(b, np.int32), np.asarray(s, np.float32)) for b, s in zip(some["buckets"].to_pylist(), some["shares"].to_pylist())]
    return fit(made, np.stack([some["quality"].to_numpy(), some["toxic"].to_numpy()], axis=1).astype(float) if made else np.empty((0, 2)))


def evidence(docs: DataFrame, model: Model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path, and log-odds ``z_quality`` and ``z_toxic`` of every row by its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.words.astype(np.float32), model.shares, model.bias, model.idf.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = worker_state(("features",), Features)
        known = shared.value
        for batch in blocks(batches):
            z = np.asarray([known.score(*maker.of(t)) for t in byte_column(batch.column(1)).to_pylist()], float).reshape(-1, 2)
            z = np.round(np.clip(z, -30, 30), 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(z[:, 0]), pa.array(z[:, 1])], ["doc_id", "host", "path", "z_quality", "z_toxic"]
            )

    chosen = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
    )
    return chosen.mapInArrow(run, "doc_id long, host string, path string, z_quality double, z_toxic double")


def _odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, total: str) -> Column:
    """Documents a prior is worth: variance inside groups over variance of the group means (method of moments)."""
    mean = F.sum(f"s_{total}") / F.sum("n")
    spread = F.sum(F.col("n") * F.pow(F.col(f"s_{total}") / F.col("n"), 2)) / F.sum("n") - F.pow(mean, 2)
    inside = F.sum(F.col(f"q_{total}")) / F.sum("n") - F.sum(F.col("n") * F.pow(F.col(f"s_{total}") / F.col("n"), 2)) / F.sum("n")
    return F.least(F.greatest(inside, F.lit(1e-9)) / F.greatest(spread - inside * F.count("*") / F.sum("n"), F.lit(1e-6)), F.lit(1e6))


def site_priors(scored: DataFrame) -> DataFrame:
    """host, path, n, and for both targets the path's shift of log-odds against all documents."""
    p = scored.select("host", "path", *[(1 / (1 + F.exp(-F.col(f"z_{t}")))).alias(t) for t in ("quality", "toxic")])
    sums = [F.count("*").alias("n")] + [a for t in ("quality", "toxic") for a in (F.sum(t).alias(f"s_{t}"), F.sum(F.col(t) * F.col(t)).alias(f"q_{t}"))]
    paths = written(p.groupBy("host", "path").agg(*sums), "path-sums")
    again = [F.sum(c).alias(c) for c in ("n", "s_quality", "q_quality", "s_toxic", "q_toxic")]
    hosts = paths.groupBy("host").agg(*again)
    whole = hosts.agg(*[(F.sum(f"s_{t}") / F.sum("n")).alias(f"all_{t}") for t in ("quality", "toxic")], *[_strength(hosts, t).alias(f"h_{t}") for t in ("quality", "toxic")])
    inner = paths.agg(*[_strength(paths, t).alias(f"p_{t}") for t in ("quality", "toxic")])
    of_host, of_path = hosts.crossJoin(F.broadcast(whole)), None  # one row
    of_host = of_host.select("host", "all_quality", "all_toxic", *[
        ((F.col(f"s_{t}") + F.col(f"h_{t}") * F.col(f"all_{t}")) / (F.col("n") + F.col(f"h_{t}"))).alias(f"host_{t}") for t in ("quality", "toxic")
    ])
    of_path = paths.join(of_host, "host").crossJoin(F.broadcast(inner))  # one row
    return of_path.select("host", "path", "n", *[
        (_odds((F.col(f"s_{t}") + F.col(f"p_{t}") * F.col(f"host_{t}")) / (F.col("n") + F.col(f"p_{t}"))) - _odds(F.col(f"all_{t}"))).alias(f"shift_{t}")
        for t in ("quality", "toxic")
    ])


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, host, path, quality, toxic (posterior probabilities) and kept (quality over one half, toxic under it).

    Null or empty text: the scores of a text without words. Null hosts and paths form groups of their own. Rows with a null id
    and repeated rows keep their rows. Without labels all scores are one half, and nothing is kept.
    """
    model = train(docs, labels, train_rows, id_col, text_col)
    scored = written(evidence(docs, model, host, path, id_col, text_col), "evidence")
    both = scored.join(site_priors(scored), ["host", "path"])
    posterior = [F.round(1 / (1 + F.exp(-(F.col(f"z_{t}") + F.col(f"shift_{t}")))), 6).alias(t) for t in ("quality", "toxic")]
    return both.select("doc_id", "host", "path", *posterior).withColumn("kept", (F.col("quality") > 0.5) & (F.col("toxic") < 0.5))
