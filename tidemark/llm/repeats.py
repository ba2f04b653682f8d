"""Suffix-array dedup (operator 10): bytes of any string of ``LENGTH`` bytes that stands earlier are removed.

The longest previous factor of a position is the longest string starting there that also starts earlier. In suffix order
it is reached from the nearest entries before and after that have a smaller place in the corpus (the previous and next smaller
positions). A byte goes if it is covered by a position whose longest previous factor is ``LENGTH`` or more, so suffixes are
sorted to that depth and factors counted up to it. The first copy stays.

What must meet in one task are equal windows of ``LENGTH`` bytes. Each window is named by the least hash of the k-grams in
it (its minimizer), which equal windows share; neighbouring windows mostly share it too, so a text has one stretch of windows
per 40 bytes or so:

1. ``stretches``: one row per document with the names of its stretches (written once; no text moves).
2. Names that occur in two different contents, or twice in one, are found by a combining aggregate and joined back to the
   documents. All else, most of the corpus, is done with.
3. Documents with such names send those stretches (bytes and place) to the task of the name, after repeats within a
   block of documents have been found on the spot. Stretches of names that occur more than ``HOT`` times go to one of ``SALTS`` tasks of the
   name; the windows that are first there go, each with its bytes to the task of its own hash, through a second round, so
   neither a passage in a third of all documents nor a phrase in very many contexts is a single task.
4. Each task makes the suffix order by prefix doubling, the smaller positions, and from these the longest previous factors, in chunks
   of ``CHUNK`` bytes that never cut a name's group. Hot or not, it is the bytes that are compared. Equal stretches enter the
   order once, at their first place: what a suffix finds in a later copy it finds there too. A name with one text left is
   in order already.

Later exact copies of a whole text are removed at once; every string in them stands in the first copy too. Texts are
shuffled by document once, and read from that exchange by step 3 and by the final cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLOCK_BYTES, blocks, byte_column, id_and_text, written
from tidemark.llm.text_columns import BLANKS

LENGTH = 100
GRAM = 20
#: Stretches with one name that still go to one task: about 3 MB.
HOT = 20_000
#: Tasks that the stretches of a hot name are dealt to before what is first in them meets.
SALTS = 64
CHUNK = 1 << 20
PART = 1 << 18
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_STEPS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5, 0xF7C2EBC08F67F2B5, 0x9FB21C651E98DF25)


def _grams(text: np.ndarray) -> np.ndarray:
    """Hash of the 20 bytes from every place on, by doubling (1, 2, 4, 8, 16, then 16 + 4)."""
    h = _BYTES[text]
    four = None
    for k, step in zip((1, 2, 4, 8), _STEPS):
        h = h[:-k] * _U(step) + h[k:]
        h ^= h >> _U(29)
        four = h if k == 2 else four
    return _mix(h[: len(text) - GRAM + 1] * _U(_STEPS[4]) + four[16 : 16 + len(text) - GRAM + 1])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


def stretches(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, first and last window start of every stretch of windows of one name in a text, and whether the place of
    the named k-gram moves inside it (only then may a stretch hold equal windows)."""
    if len(text) < LENGTH:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.int64), empty, empty, np.empty(0, bool)
    data, width = np.frombuffer(text, np.uint8), LENGTH - GRAM + 1
    grams = np.concatenate([_grams(data[i : i + PART + GRAM - 1]) for i in range(0, len(data) - GRAM + 1, PART)])
    names = np.concatenate([_least(grams[i : i + PART + width - 1], width) for i in range(0, len(grams) - width + 1, PART)])
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    last = np.append(first[1:], len(names)) - 1
    moves = last - first >= width
    for i in range(0, len(first), PART // width):
        a, b = (x[i : i + PART // width, None] + np.arange(width) for x in (first, last))
        moves[i : i + PART // width] |= a[:, 0] + grams[a].argmin(axis=1) != b[:, 0] + grams[b].argmin(axis=1)
    return names[first].view(np.int64), first, last, moves


def _name_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        texts = byte_column(batch.column(1)).to_pylist()
        names, again, counts = [], [], []
        for t in texts:
            name, _, _, moves = stretches(t or b"")
            found, times = np.unique(name, return_counts=True)
            names.append(found)
            counts.append(times.astype(np.int32))
            again.append(np.union1d(found[times > 1], name[moves]))
        lists = [
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32)), pa.array(np.concatenate(part)))
            for part in (names, again, counts)
        ]
        digest = pa.array([hashlib.sha256(t or b"").digest() for t in texts], pa.binary())
        size = pa.array([len(t or b"") for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), size, digest, *lists], ["doc_id", "content", "n_bytes", "digest", "names", "again", "times"])


def window_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every window of ``LENGTH`` bytes, by doubling: 64 + 32 + 4 bytes."""
    data = np.frombuffer(text, np.uint8)
    n, h, kept = len(data) - LENGTH + 1, _BYTES[data], {}
    for k in (1, 2, 4, 8, 16, 32):
        h = h[:-k] * _U(_STEPS[k.bit_length() % 5]) + h[k:]
        h ^= h >> _U(29)
        kept[2 * k] = h
    return _mix(_mix(h[:n] * _U(_STEPS[3]) + kept[32][64 : 64 + n]) * _U(_STEPS[4]) + kept[4][96 : 96 + n]).view(np.int64)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of rows whose last column counts up by one while the others stay."""
    if not len(columns[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    breaks = np.diff(columns[-1]) != 1
    for c in columns[:-1]:
        breaks |= c[1:] != c[:-1]
    first = np.flatnonzero(np.append(True, breaks))
    return first, np.append(first[1:], len(columns[0])) - 1


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of repeated names with their bytes; those of hot names with a salt above zero.

    What has been met before in the block comes out as removed at once (no bytes). Rows leave in pieces of ``PART`` bytes, and
    all but the bytes stay in arrays, so that a worker holds little more than the block's different stretches.
    """
    for batch in blocks(batches):
        # The content tells texts of one id apart; where an id has one text, its place needs none.
        ids, contents = batch.column(0).to_numpy(), pc.if_else(batch.column(4), batch.column(2), 0).to_numpy()
        texts, named = byte_column(batch.column(1)), batch.column(3)
        salts = (_mix(ids.astype(np.int64).view(_U) + _U(1)) % _U(SALTS)).astype(np.int32) + 1
        seen: set[bytes] = set()
        parts: list[tuple] = []
        held, before = 0, None
        for i in np.lexsort((contents, ids)).tolist():
            me = (ids[i], contents[i])
            if me == before:
                continue  # a repeated row is the same place
            text, wanted, before = texts[i].as_py() or b"", named[i].values, me
            key, hot = wanted.field("name").to_numpy(), wanted.field("hot").to_numpy(zero_copy_only=False)
            order = np.argsort(key)
            key, hot = key[order], hot[order]
            names, first, last, moves = stretches(text)
            at = np.minimum(np.searchsorted(key, names), len(key) - 1)
            use = key[at] == names
            name, first, last, moves, salt = names[use], first[use], last[use], moves[use], np.where(hot[at[use]], salts[i], 0).astype(np.int32)
            found: list[bytes | None] = []
            for k, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
                whole = text[a : b + LENGTH]
                if whole in seen:
                    found.append(None)
                    name[k] = salt[k] = 0
                else:
                    seen.add(whole)
                    found.append(whole)
                    held += len(whole)
            if found:
                parts.append((name, np.full(len(found), me[0]), np.full(len(found), me[1]), first, last - first + 1, found, salt, moves))
            if held > PART:
                yield _joined(parts)
                parts, held = [], 0
        if parts:
            yield _joined(parts)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_send`` gives, with neighbouring spans without bytes as one."""
    for batch in _send(batches):
        bare = batch.column("bytes").is_null().to_numpy(zero_copy_only=False)
        doc, content, start, n = (batch.column(c).to_numpy() for c in ("doc_id", "content", "start", "n"))
        follows = bare[1:] & bare[:-1] & (doc[1:] == doc[:-1]) & (content[1:] == content[:-1]) & (start[1:] == start[:-1] + n[:-1])
        lead = np.flatnonzero(np.append(True, ~follows))
        whole = np.add.reduceat(n, lead)
        columns = batch.take(pa.array(lead)).columns
        columns[batch.schema.get_field_index("n")] = pa.array(whole, pa.int64())
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _joined(parts: list[tuple]) -> pa.RecordBatch:
    """Sent rows of many texts: arrays one after another, and the lists of their bytes."""
    return _sent(*(pa.array(list(chain.from_iterable(c)), pa.binary()) if isinstance(c[0], list) else np.concatenate(c) for c in zip(*parts)))


def _sent(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    made = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
    salt, moves = columns[6:] if len(columns) > 6 else (np.zeros(len(made[0]), np.int32), np.zeros(len(made[0]), bool))
    return pa.RecordBatch.from_arrays([*made, pa.array(salt, pa.int32()), pa.array(moves, pa.bool_())], ["route", "doc_id", "content", "start", "n", "bytes", "salt", "moves"])


#: Bits of a rank or an index while three of them fit one sorted word.
_BITS = 21


def _ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense rank of every pair, and the indices in order of pairs, then of index."""
    n = len(high)
    if n < 1 << _BITS and int(high.max(initial=0)) < 1 << _BITS and int(low.max(initial=0)) < 1 << _BITS:
        key = np.sort((high << _U(2 * _BITS)) | (low << _U(_BITS)) | np.arange(n, dtype=_U))
        order, key = (key & _U((1 << _BITS) - 1)).astype(np.int64), key >> _U(_BITS)
    else:
        key = (high << _U(32)) | low
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.zeros(n, np.int64)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, _U)
    rank[order] = np.cumsum(new).astype(_U)
    return rank, order


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks of the places by their first bytes, for a growing number of bytes up to ``depth``, by prefix doubling; and the places
    in suffix order to that depth, equal ones by place. Beyond the end zeros follow."""
    size = 5  # forty bits and an index fit one word
    padded = np.append(text, np.zeros(2 * depth, np.uint8)).astype(_U)
    high, low = (padded[:-4] << _U(8)) | padded[1:-3], (padded[2:-2] << _U(16)) | (padded[3:-1] << _U(8)) | padded[4:]
    if len(high) < 1 << _BITS:
        key = np.sort((((high << _U(24)) | low) << _U(_BITS)) | np.arange(len(high), dtype=_U))
        order, key = (key & _U((1 << _BITS) - 1)).astype(np.int64), key >> _U(_BITS)
        new = np.zeros(len(key), np.int64)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(len(key), _U)
        rank[order] = np.cumsum(new).astype(_U)
    else:
        rank, order = _ranked(high, low)
    levels = [(size, rank.astype(np.uint32))]
    while size < depth:
        step = min(size, depth - size)
        rank, order = _ranked(rank[:-step], rank[step:])
        size += step
        levels.append((size, rank.astype(np.uint32)))
    return levels, order[order < len(text)]


def _common(levels: list[tuple[int, np.ndarray]], text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, up to ``depth``."""
    found = np.zeros(len(a), np.int64)
    padded = np.append(text, np.zeros(2 * depth, np.uint8))
    for size, rank in reversed(levels):
        last = len(rank) - 1
        same = (rank[np.minimum(a + found, last)] == rank[np.minimum(b + found, last)]) & (found + size <= depth)
        found += np.where(same, size, 0)
    # Levels do not halve exactly at the top, and stop at five bytes.
    open_ = np.arange(len(a))
    while len(open_):
        x, y = a[open_] + found[open_], b[open_] + found[open_]
        open_ = open_[(found[open_] < depth) & (padded[x] == padded[y])]
        found[open_] += 1
    return found


def _smaller_before(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry the nearest one before with a smaller place (-1: none), and the common prefix of the two.

    All entries step at once to what their candidate has found so far; what lies between is no smaller, so each step is
    right, and steps grow as they go.
    """
    near, low = np.arange(len(place)) - 1, common.copy()
    open_ = np.flatnonzero((near >= 0) & (place[near] >= place))
    while len(open_):
        at = near[open_]
        step, least = near[at], np.minimum(low[open_], low[at])
        near[open_], low[open_] = step, least
        open_ = open_[(step >= 0) & (place[step] >= place[open_])]
    low[near < 0] = 0
    return near, low


def longest_previous_factors(text: np.ndarray, entries: np.ndarray, place: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Longest previous factor (up to ``depth``) of every entry: the common prefix with the previous or the next smaller place in suffix order.

    ``entries`` are places in ``text``, ``place`` what stands for them in the corpus, both ascending; equal places are one occurrence.
    """
    levels, order = suffix_order(text, depth)
    index = np.full(len(text), -1)
    index[entries] = np.arange(len(entries))
    mine = index[order]
    mine = mine[mine >= 0]
    at, p, rank = entries[mine], place[mine], levels[-1][1]
    common = np.zeros(len(at), np.int64)
    equal = np.zeros(len(at), bool)
    equal[1:] = rank[at[1:]] == rank[at[:-1]]
    common[equal] = depth
    rest = np.flatnonzero(~equal[1:]) + 1
    common[rest] = _common(levels, text, at[rest - 1], at[rest], depth)
    _, before = _smaller_before(p, common)
    # The same from the other end; the common prefix with the next entry stands one further.
    _, after = _smaller_before(p[::-1], np.append(0, common[:0:-1]))
    out = np.empty(len(entries), np.int64)
    out[mine] = np.maximum(before, after[::-1])
    return out


def _earlier(doc: np.ndarray, content: np.ndarray, start: np.ndarray, n: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Row, doc, content and start of every window of the stretches whose longest previous factor has ``LENGTH`` bytes or more."""
    by_place = np.lexsort((start, content, doc))
    doc, content, start, n = doc[by_place], content[by_place], start[by_place], n[by_place]
    texts = [texts[i] for i in by_place.tolist()]
    lengths = np.asarray([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    entries = np.repeat(np.cumsum(lengths) - lengths, n) + offset
    # Stretches of one text do not overlap, so their windows are in order; a repeated row stands at the same places.
    same = np.zeros(len(texts), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (content[1:] == content[:-1]) & (start[1:] == start[:-1])
    place = np.maximum.accumulate(np.where(same, 0, np.cumsum(n) - n))[row] + offset
    later = longest_previous_factors(np.frombuffer(b"".join(texts), np.uint8), entries, place) >= LENGTH
    return by_place[row[later]], doc[row[later]], content[row[later]], (start[row] + offset)[later]


def _removed(sent: pa.Table) -> Iterator[pa.RecordBatch]:
    """Removed spans of some rows (no bytes, start and length in windows), and what is left of stretches with a salt, as
    single windows by their own hash."""
    size = pc.fill_null(pc.binary_length(sent["bytes"]), 0).to_numpy()
    route, doc, content, start, n, salt = (sent[c].to_numpy() for c in ("route", "doc_id", "content", "start", "n", "salt"))
    spans = [(doc[size == 0], content[size == 0], start[size == 0], n[size == 0])]
    long = np.flatnonzero(size >= LENGTH)
    long = long[np.lexsort((start[long], content[long], doc[long]))]
    held = sent["bytes"].take(pa.array(long)).combine_chunks()
    # Equal stretches: the first stands for all in the suffix order, the others go whole. A repeated row is the same place.
    code = held.dictionary_encode().indices.to_numpy()
    _, lead = np.unique(code, return_index=True)
    of = long[lead][code] if len(long) else long
    again = (doc[long] != doc[of]) | (content[long] != content[of]) | (start[long] != start[of])
    spans.append(tuple(x[long[again]] for x in (doc, content, start, n)))
    texts, long = held.take(pa.array(lead)).to_pylist(), long[lead]
    # Windows of all stretches, one after another, and which of them go.
    base = np.cumsum(n[long]) - n[long]
    gone = np.zeros(int(n[long].sum()), bool)
    # What is alone under its name meets none but itself, and may hold equal windows only if its k-gram moves.
    _, group, members = np.unique(route[long], return_inverse=True, return_counts=True)
    open_ = np.flatnonzero((members[group] > 1) | sent["moves"].to_numpy()[long])
    if len(open_):
        at = long[open_]
        rows, d, c, s = _earlier(doc[at], content[at], start[at], n[at], [texts[i] for i in open_.tolist()])
        gone[base[open_[rows]] + s - start[at[rows]]] = True
        order = np.lexsort((s, c, d))
        d, c, s = d[order], c[order], s[order]
        first, last = _runs(d, c, s)
        spans.append((d[first], c[first], s[first], last - first + 1))
    d, c, s, k = (np.concatenate(x) for x in zip(*spans))
    yield _sent(np.zeros(len(d), np.int64), d, c, s, k, [None] * len(d))
    out, held = [], 0
    for i in np.flatnonzero(salt[long] > 0).tolist():
        row, left = long[i], np.flatnonzero(~gone[base[i] : base[i] + n[long[i]]])
        if len(left):
            same = [np.full(len(left), x[row]) for x in (doc, content)]
            windows = np.asarray([texts[i][w : w + LENGTH] for w in left.tolist()], object)
            out.append((window_hashes(texts[i])[left], *same, start[row] + left, np.ones(len(left), np.int64), windows))
            held += len(left)
        if held > BLOCK_BYTES // LENGTH:
            yield _sent(*(np.concatenate(c) for c in zip(*out)))
            out, held = [], 0
    if out:
        yield _sent(*(np.concatenate(c) for c in zip(*out)))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans, from sent stretches and windows sorted by route and salt, in chunks that end with a route.

    Stretches with a salt may be cut anywhere: what is first in a chunk meets afterwards.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for piece in blocks(iter([batch]), "bytes"):
            held.append(piece)
            if sum(b.nbytes for b in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            route = table["route"].to_numpy()
            cut = int(np.searchsorted(route, route[-1])) if table["salt"][-1].as_py() == 0 else len(route)
            if cut:
                yield from _removed(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from _removed(pa.Table.from_batches(held).combine_chunks())


def _left(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text without the spans, the bytes removed, and the number of maximal runs of these."""
    kept, at, runs, removed = [], 0, 0, 0
    for a, b in sorted(spans):
        if a > at or not runs:
            kept.append(text[at:a])
            runs += 1
            removed += b - a
            at = b
        elif b > at:
            removed += b - at
            at = b
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def _marked(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Text and removed spans of every row; the batch has doc_id, text, content, of, start, stop."""
    for text, content, of, starts, stops in zip(byte_column(batch.column(1)).to_pylist(), *(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
        yield text or b"", [(a, b) for c, a, b in zip(of or (), starts or (), stops or ()) if c in (0, content)]


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            out = []
            for text, spans in _marked(batch):
                rest, removed, runs = _left(text, spans)
                out.append((removed, runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "content", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    return run


#: Start of a mark that stands for the whole text: a later exact copy.
COPY = -1


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with what is left of their texts; later copies of whole texts are left out."""
    for batch in blocks(batches):
        stay, kept, removed = [], [], []
        for i, (text, spans) in enumerate(_marked(batch)):
            if any(a == COPY for a, _ in spans):
                continue
            rest, n, _ = _left(text, spans)
            stay.append(i)
            kept.append(rest.decode("utf-8", "ignore"))
            removed.append(n)
        rest = batch.column(6).take(pa.array(stay, pa.int64()))
        yield pa.RecordBatch.from_arrays([rest, pa.array(kept, pa.string()), pa.array(removed, pa.int64())], ["rest", "kept", "n_removed"])


def _cut_texts(rows: DataFrame, with_text: bool) -> DataFrame:
    chosen = rows.select("doc_id", "text", "content", "spans.of", "spans.start", "spans.stop")
    return chosen.mapInArrow(_cut(with_text), "doc_id long, content long, n_removed long, n_spans long, kept_sha256 string, kept string")


_SENT = "route long, doc_id long, content long, start long, n long, bytes binary, salt int, moves boolean"


def _found(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Per row its size and digest; later copies of whole texts; texts dealt out by document; removed spans per document."""
    known = written(
        rows.select("doc_id", "text", "content").mapInArrow(
            _name_rows, "doc_id long, content long, n_bytes long, digest binary, names array<long>, again array<long>, times array<int>"
        ), "stretches",
    )
    named = known.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH))
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last"))
    placed = named.select("doc_id", "content", "digest").join(firsts, "digest", "left")
    placed = placed.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    copies = placed.where("copy").select("doc_id", "content").distinct()
    # Ids of copies only are done; the texts of an id with several are told apart by content.
    ids = placed.groupBy("doc_id").agg(F.bool_and("copy").alias("done"), (F.min("content") != F.max("content")).alias("several"))
    entries = F.concat(
        F.zip_with("names", "times", lambda n, k: F.struct(n.alias("name"), F.col("content").alias("c"), k.alias("n"))),
        F.transform("again", lambda n: F.struct(n.alias("name"), F.bitwise_not(F.col("content")).alias("c"), F.lit(0).alias("n"))),
    )
    seen = named.select(F.explode(entries).alias("e")).groupBy("e.name").agg(F.min("e.c").alias("low"), F.max("e.c").alias("high"), F.sum("e.n").alias("n"))
    repeated = seen.where(F.col("low") != F.col("high")).select("name", (F.col("n") > HOT).alias("hot"))
    asked = named.select("doc_id", F.explode("names").alias("name")).join(repeated, "name")
    wanted = asked.groupBy("doc_id").agg(F.collect_set(F.struct("name", "hot")).alias("names")).join(ids.where(~F.col("done")), "doc_id")
    # Whatever else the rows carry goes along in both uses, so that both read one exchange.
    others = [c for c in rows.columns if c not in ("doc_id", "content", "text")]
    texts = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "content", "text", *others).repartition("doc_id")
    sent = texts.join(wanted, "doc_id").select("doc_id", "text", "content", "names", "several", *others).mapInArrow(
        _deal, _SENT
    )
    # Spans have no bytes; they are dealt out by place. In the second round only what is left of hot windows has any.
    key = F.when(F.col("bytes").isNull(), F.xxhash64("doc_id", "start")).otherwise(F.col("route"))
    first = sent.repartition(key, "salt").sortWithinPartitions("route", "salt").mapInArrow(_match, _SENT)
    second = first.repartition(key).sortWithinPartitions("route").mapInArrow(_match, _SENT)
    spans = second.select("doc_id", "content", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("stop"))
    return known, copies, texts, spans


def _by_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("content").alias("of"), "start", "stop")).alias("spans"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, content, n_bytes, n_removed, n_spans, kept_sha256 and (if asked) ``kept``, the text that is left, of every row.

    ``content`` is the 64-bit hash of the text. Null or empty text: 0 bytes, nothing removed. A row with a null id takes no part
    and keeps all. Rows of one id and different texts are ordered by ``content``; rows of one id and one text are the same
    place and do not remove each other. ``kept`` is null where nothing was removed; characters cut in part are left out.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("content", F.xxhash64("text"))
    known, copies, texts, spans = _found(rows)
    cut = _cut_texts(texts.join(_by_document(spans), "doc_id"), with_text).dropDuplicates(["doc_id", "content"])
    gone = copies.withColumn("copy", F.lit(True))
    base = known.select("doc_id", "content", "n_bytes", "digest").join(cut, ["doc_id", "content"], "left").join(gone, ["doc_id", "content"], "left")
    copy = F.coalesce("copy", F.lit(False))
    return base.select(
        "doc_id", "content", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what is left of each text, ``n_chars`` (where there is such a column) counted anew.

    Rows that lose bytes and keep nothing but white space are left out, later exact copies among them; all others stay, with
    all columns. Null texts stay null; rows with a null id take no part and stay; repeated rows (one id, one text) are the
    same place, and each stays as the one does. An empty table gives an empty one.

    Later copies and removed spans, both narrow, meet each document in one join, and its other columns travel with its text, so
    that the texts are shuffled once and nothing is joined after they have been cut.
    """
    narrow = [c for c in docs.columns if c != text_col]
    rest = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(narrow)], docs[text_col].isNull().alias("is_null")).alias("rest")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), rest).withColumn("content", F.xxhash64("text"))
    _, copies, texts, spans = _found(rows)
    whole = copies.select("doc_id", "content", F.lit(COPY).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"))
    marked = texts.join(_by_document(spans.unionByName(whole)), "doc_id", "left")
    kind = rows.schema["rest"].dataType.simpleString()
    cut = marked.select("doc_id", "text", "content", "spans.of", "spans.start", "spans.stop", "rest").mapInArrow(_cut_rows, f"rest {kind}, kept string, n_removed long")
    cut = cut.where((F.col("n_removed") == 0) | (F.btrim("kept", F.lit(BLANKS)) != ""))
    new = {c: F.col(f"rest.c{i}") for i, c in enumerate(narrow)} | {text_col: F.when(~F.col("rest.is_null"), F.col("kept"))}
    if "n_chars" in narrow:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    left = cut.select(*[new[c].alias(c) for c in docs.columns])
    return left.unionByName(docs.where(docs[id_col].isNull()).withColumn(text_col, F.col(text_col).cast("string")))
