"""MinHash near-dedup (operator 2): fast similarity sketches, banding, exact verification, connected components.

Sketch. ``SKETCH`` coordinates are filled in rounds: in round i every shingle is thrown into the bin its i-th hash
names, with a value from the same hash; a bin keeps the least value of the first round that reached it. Rounds go on
until no bin is empty; from round ``SKETCH`` on, round ``SKETCH + j`` throws all shingles into bin j, so that every coordinate is
sure to fill. Two sketches agree in a coordinate with the probability of their sets' Jaccard similarity, with
concentration as for independent samples, and a large set needs one or two rounds instead of ``SKETCH`` hashes
per shingle.

Candidates. ``BANDS`` bands of ``ROWS`` coordinates: at similarity 0.75 a pair misses all bands with probability
(1 - 0.75^5)^48 = 2.3e-6.

Links. Documents of equal shingle sets form a class; only one representative goes on. Candidates are verified on
the full sets, never on sketches:

1. star: every member of a bucket against the bucket's smallest member; verified links give components;
2. rest: in buckets whose members are still in different components, every member outside the first one's component
   against all members of other components that are large and small enough, in tiles of at most ``TILE`` by ``TILE`` members, a pair that
   meets in several buckets in the first of them only.

Which buckets these are, a combining aggregate over the components of their members tells, so a bucket of very many copies is no single task.
Pairs known to be connected are not compared again: the component of a large group of near copies is found by
comparisons with a few members, and no pair is given up. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, byte_column, id_and_text, worker_state, written
from tidemark.llm.components import components

SHINGLE = 5
ROWS, BANDS = 5, 48
SKETCH = ROWS * BANDS
TILE = 512
CACHE_WORDS = 300_000
#: Bytes of text that are split into words at once: each word is an object of some fifty bytes.
BLOCK = 1 << 20
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingles:
    """Sets of 64-bit shingle hashes of texts; hashes of words are kept in the worker."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.words: dict[bytes, int] = {}
        powers = [1]
        for _ in range(size):
            powers.append(powers[-1] * 0xD6E8FEB86659FD93 % 2**64)
        self.powers = np.asarray(powers, _U)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.words
        missing = set(words).difference(known)
        if missing:
            if len(known) + len(missing) > CACHE_WORDS:
                known.clear()
                missing = set(words)
            known.update((w, xxh3_64_intdigest(w)) for w in missing)
        return np.fromiter(map(known.__getitem__, words), _U, len(words))

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text (white-space words, A-Z lowered)."""
        split = [t.lower().split() if t else [] for t in texts]
        flat = self._hashes([w for words in split for w in words])
        out, at = [], 0
        for words in split:
            h = flat[at : at + len(words)]
            at += len(words)
            k = min(self.size, len(h))
            if not k:
                out.append(np.empty(0, _U))
                continue
            n = len(h) - k + 1
            total = np.full(n, k, _U)
            for j in range(k):
                total = total + mix(h[j : j + n] + _U(j)) * self.powers[j + 1]
            out.append(np.unique(mix(total)))
        return out


def sketch(items: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes: one 64-bit value per coordinate."""
    out = np.zeros(size, _U)
    empty = np.ones(size, bool)
    done = 0
    at_once = max(1, min(size, 2 * size // len(items)))
    while done < size and empty.any():
        rounds = np.arange(done, min(size, done + at_once), dtype=_U)
        done += len(rounds)
        h = mix(items[None, :] + (rounds[:, None] + _U(1)) * _STEP)
        bins = (h % _U(size)).astype(np.int64)
        # Least value of the first round to reach each bin.
        order = np.lexsort((h.ravel(), np.repeat(np.arange(len(rounds)), len(items)), bins.ravel()))
        sorted_bins = bins.ravel()[order]
        first = np.append(True, sorted_bins[1:] != sorted_bins[:-1])
        bin_, value = sorted_bins[first], h.ravel()[order[first]]
        new = empty[bin_]
        out[bin_[new]] = value[new]
        empty[bin_] = False
    for j in np.flatnonzero(empty).tolist():
        out[j] = mix(items + np.asarray([size + j + 1], _U) * _STEP).min()
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of a sketch."""
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=_U) * _STEP
    for r in range(ROWS):
        key = mix(key ^ rows[:, r]) + _U(r)
    return key


def shingles() -> Shingles:
    return worker_state(("shingles", SHINGLE), Shingles)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    maker = shingles()
    for batch in blocks(batches, most=BLOCK):
        sets = maker.sets(byte_column(batch.column(1)).to_pylist())
        digest = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        keys = [bands(sketch(s)) if len(s) else np.empty(0, _U) for s in sets]
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            ["doc_id", "n_shingles", "set_key", "bands"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maker = shingles()
    for batch in blocks(batches, most=BLOCK):
        sets = maker.sets(byte_column(batch.column(1)).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "items"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b| for sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [_linked(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return run


def _tile(percent: int):
    """Links between members of different components in one tile, one per member and other component.

    Pairs that share an earlier band have met there: by the star in a bucket of two, else in a tile.
    """

    def run(tile: pa.Table) -> pa.Table:
        ids, comps = tile["rep"].to_numpy(), tile["component"].to_numpy()
        rest = np.asarray(tile["asks"].to_pylist(), bool)
        sets = [np.frombuffer(x, _U) for x in tile["items"].to_pylist()]
        sizes = np.asarray([len(s) for s in sets])
        earlier = np.asarray(tile["bands"].combine_chunks().flatten()).reshape(len(sets), -1)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = []
        mark = np.zeros(int(code.max()) + 1, bool)
        for i in np.flatnonzero(rest).tolist():
            new = (comps != comps[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & ~(earlier == earlier[i]).any(axis=1)
            if not new.any():
                continue
            mine = code[starts[i] : starts[i + 1]]
            mark[mine] = True
            both = np.bincount(owner[mark[code]], minlength=len(sets))
            mark[mine] = False
            hit = new & (100 * both >= percent * (sizes + sizes[i] - both))
            _, first = np.unique(comps[hit], return_index=True)
            out += [(int(ids[i]), int(x)) for x in ids[hit][first]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def link_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of every row.

    Texts without words are linked with nothing. A row with a null id has no component (null) and links nothing. Rows
    of one id count as one document.
    """
    rows = id_and_text(docs, id_col, text_col)
    sketched = written(rows.mapInArrow(_sketches, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketches")
    named = sketched.where(F.col("doc_id").isNotNull())
    classes = named.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = named.select("doc_id", "set_key", "bands").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_key"], "left_semi")
    keyed = reps.select(F.col("doc_id").alias("rep"), F.posexplode("bands").alias("band", "key"))
    # Buckets of two members or more, and their smallest member.
    sizes = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("other")).where(F.col("hub") != F.col("other"))
    members = written(keyed.join(sizes.select("key", "hub"), "key"), "bucket-members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(
        rows.where(F.col("doc_id").isNotNull()).join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets, "rep long, items binary")
        .groupBy("rep", "items").agg(F.lit(1).alias("one")).drop("one"),
        "full-sets",
    )
    pairs = members.where(F.col("rep") != F.col("hub")).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b").join(
        sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a"
    )
    verified = both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long, linked boolean").where("linked")
    # Rows of one id in several classes tie these together.
    placed = named.where(F.col("set_key").isNotNull()).select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep")
    shared = placed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where(F.col("a") != F.col("z"))
    ties = placed.join(shared, "doc_id").select("a", F.col("rep").alias("b")).where(F.col("a") != F.col("b"))
    links = written(verified.select("a", "b").unionByName(ties), "star-links")
    first = components(links, "star")
    more = written(_rest_links(members, sets, reps.select(F.col("doc_id").alias("rep"), "bands"), first, percent), "rest-links")
    if more.limit(1).count():
        first = components(links.unionByName(more), "all")
    labelled = placed.join(first.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component_id")
    ).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return sketched.select("doc_id", "n_shingles").join(labelled, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _rest_links(members: DataFrame, sets: DataFrame, bands_of: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Links that the comparisons with the buckets' smallest members did not make, between components."""
    label = first.withColumnRenamed("node", "rep")
    placed = members.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # Buckets of two have been compared in full, those of one component need no comparison.
    mixed = placed.groupBy("key").agg(F.min("hub").alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    mixed = written(mixed.where((F.col("low") != F.col("high")) & (F.col("n") > 2)).select("key", "hub"), "open-buckets")
    # A member is the smallest of one bucket a band at most.
    main = mixed.join(label.withColumnsRenamed({"rep": "hub", "component": "hub_component"}), "hub", "left")
    main = main.select("key", F.coalesce("hub_component", "hub").alias("hub_component"))
    placed = written(placed.join(main, "key").withColumn("asks", F.col("component") != F.col("hub_component")).drop("hub"), "open-members")
    # Members in the hub's component, and the rest.
    counts = placed.groupBy("key").agg(
        F.sum(F.col("asks").cast("long")).alias("n_rest"), F.sum((~F.col("asks")).cast("long")).alias("n_main")
    )
    open_ = placed.join(counts, "key").select(
        "key", "band", "rep", "component", "asks", F.ceil(F.col("n_rest") / TILE).alias("rests"), F.ceil(F.col("n_main") / TILE).alias("mains")
    )
    chunk = F.pmod(F.xxhash64("rep"), F.when(F.col("asks"), F.col("rests")).otherwise(F.col("mains")))
    open_ = open_.withColumn("chunk", chunk)
    # A rest chunk meets every rest chunk and every main chunk.
    with_rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j")))
    with_main = F.transform(F.sequence(F.lit(1).cast("long"), F.col("mains")), lambda j: F.struct(F.col("chunk").alias("i"), (-j).alias("j")))
    from_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda i: F.struct(i.alias("i"), (-F.col("chunk") - 1).alias("j")))
    tiles = F.when(F.col("asks"), F.when(F.col("mains") > 0, F.concat(with_rest, with_main)).otherwise(with_rest)).otherwise(from_main)
    # 31 bits tell bands apart: a pair that has not met is taken for one that has in two of 10^8 cases, far fewer than banding misses.
    earlier = F.transform(F.slice("bands", F.lit(1), F.col("band")), lambda b: b.bitwiseAND(0x7FFFFFFF).cast("int"))
    spread = open_.select("key", "band", "rep", "component", "asks", F.explode(tiles).alias("tile")).select("key", "band", "tile.i", "tile.j", "rep", "component", "asks")
    full = spread.join(sets, "rep").join(bands_of, "rep").select("key", "i", "j", "band", "rep", "component", "asks", "items", earlier.alias("bands"))
    return full.groupBy("key", "i", "j").applyInArrow(_tile(percent), "a long, b long")


def keep_one(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose document is the first of its component (or has no id).

    The ids that go are written first, so that their size decides how they meet the documents.
    """
    dropped = link_components(docs, percent, id_col, text_col).where(F.col("doc_id") != F.col("component_id"))
    gone = written(dropped.select(F.col("doc_id").alias("__gone")).distinct(), "later-copies")
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
