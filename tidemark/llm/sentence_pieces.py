"""SentencePiece encoding and decoding (operator 4) by vectorised merge rounds.

The model is byte-pair encoding over pieces with a score each, with white space written as U+2581 in front of
a word. No piece goes on after white space, and no piece holds a line break, so a text is cut into
words there without changing its ids. The words of a batch that the worker has not met yet are encoded together: one
flat array of symbols, the rank of every adjacent pair, the least rank of each word's segment, merges at all
words at once, compaction, until no word has a pair left. If no piece that a merged piece can grow into ranks
before it or beside it, all its occurrences in a word merge in one round (leftmost first, without overlap); otherwise
only the leftmost does. That gives exactly the order of the library: best score first, then leftmost.

A word of more than ``LONG`` characters (text without white space, encoded data) would take a round over all its symbols for each of the
thousands of ranks in it. Such words keep their pairs by rank instead, with links to the neighbours in place of compaction: a round takes the
pairs of the least rank of all of them, and makes new pairs beside the merges only. They are not kept in the worker's cache.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Recent, blocks, id_and_text, worker_state

SPACE = "▁"
CACHE_WORDS = 160_000
#: Bytes of text that are cut into words at once: each word is an object of some sixty bytes.
BLOCK = 2 << 20
LONG = 256
NONE = np.int32(2**31 - 1)
_CUT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class Pieces:
    """The model's tables, and encoding and decoding with them."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", names[i]) for i in plain):
            raise ValueError("pieces that go on after white space or hold a line break are not supported")
        of = {names[i]: i for i in plain}
        self.end_id = model.eos_id()
        self.byte_ids = np.asarray([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.code = {p: i for p, i in of.items() if len(p) == 1}
        # Order of the scores: the smaller, the sooner merged. Pieces of equal score share a rank.
        scores = np.asarray([model.get_score(i) for i in plain])
        _, dense, shared = np.unique(-scores, return_inverse=True, return_counts=True)
        order = np.full(size, NONE, np.int32)
        order[plain] = dense
        pairs = {}
        for name, i in of.items():
            for cut in range(1, len(name)):
                left, right = of.get(name[:cut]), of.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.keys = np.asarray(sorted(pairs), np.int64)
        self.merged = np.asarray([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = order[self.merged]
        grows = np.full(size, NONE, np.int32)
        np.minimum.at(grows, (self.keys >> 32).astype(np.int64), self.rank)
        np.minimum.at(grows, (self.keys & 0xFFFFFFFF).astype(np.int64), self.rank)
        self.safe = grows > order
        self.safe[np.asarray(plain)[shared[dense] > 1]] = False
        text = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(size)]
        self.text = text
        self.words = Recent(cache_words)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of adjacent symbols (``NONE`` where they do not merge)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NONE), self.merged[at]

    def _symbols(self, text: str) -> np.ndarray:
        """One symbol a character; a character that is no piece becomes a negative one, and bytes at the end."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        return np.asarray([self.code.get(chr(c), -1 - int(c)) for c in distinct], np.int32)[inverse]

    def _packed(self, symbols: np.ndarray, word: np.ndarray, n: int) -> list[bytes]:
        """The ids of ``n`` words, from symbols in order of words."""
        if (symbols < 0).any():
            symbols, word = self._to_bytes(symbols, word)
        packed = symbols.astype("<i4").tobytes()
        cuts = (np.searchsorted(word, np.arange(n + 1)) * 4).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge_long(self, words: list[str]) -> list[bytes]:
        """The packed ids of long words, by rounds that touch only the pairs of one rank."""
        if not words:
            return []
        symbols = self._symbols("".join(words)).copy()
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.append(word[1:] != word[:-1], True)
        after[ends] = -1
        before[np.append(True, ends[:-1])] = -1
        rank, merged = np.full(n, NONE), np.zeros(n, np.int32)
        kept: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Rank the pairs that start at these symbols, and put them with others of their ranks."""
            at = at[at >= 0]
            right = after[at]
            rank[at], merged[at] = self._pairs(symbols[at], np.where(right >= 0, symbols[right], -1))
            at = at[rank[at] < NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            ranks = rank[at]
            first = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
            for r, part in zip(ranks[first].tolist(), np.split(at, first[1:])):
                if r not in kept:
                    kept[r] = []
                    heapq.heappush(heap, r)
                kept[r].append(part)

        note(np.arange(n))
        alive = np.ones(n, bool)
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(kept.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            safe = self.safe[merged[at]]
            lead = np.append(True, word[at[1:]] != word[at[:-1]])
            # In a run of overlapping pairs (a symbol repeated), every second one merges.
            new_run = np.append(True, after[at[:-1]] != at[1:])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            take = np.where(safe, (np.arange(len(at)) - run_start) % 2 == 0, lead)
            chosen, left = at[take], at[~take & ~safe]
            gone = after[chosen]
            symbols[chosen] = merged[chosen]
            alive[gone], rank[gone] = False, NONE
            after[chosen] = after[gone]
            followed = after[chosen] >= 0
            before[after[chosen][followed]] = chosen[followed]
            note(np.unique(np.concatenate([before[chosen], chosen])))
            if len(left):
                if r not in kept:
                    kept[r] = []
                    heapq.heappush(heap, r)
                kept[r].append(left)
        return self._packed(symbols[alive], word[alive], len(words))

    def merge(self, words: list[str]) -> list[bytes]:
        """The packed ids of words, all merged together."""
        if not words:
            return []
        text = "".join(words)
        if not text:
            return [b""] * len(words)
        symbols = self._symbols(text)
        lengths = np.asarray([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            same = word[:-1] == word[1:]
            rank, merged = self._pairs(symbols[:-1], symbols[1:])
            rank = np.append(np.where(same, rank, NONE), NONE)
            first = np.flatnonzero(np.append(True, ~same))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            open_ = least < NONE
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
            at = np.flatnonzero(open_ & (rank == least))
            if not len(at):
                break
            safe = self.safe[merged[at]]
            lead = np.append(True, word[at[1:]] != word[at[:-1]])
            # In a run of overlapping pairs (a symbol repeated), every second one merges.
            new_run = np.append(True, (np.diff(at) != 1)) | lead
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            chosen = at[np.where(safe, (np.arange(len(at)) - run_start) % 2 == 0, lead)]
            symbols = symbols.copy()
            symbols[chosen] = merged[chosen]
            keep = open_
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return self._packed(symbols[order], word[order], len(words))

    def _to_bytes(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Writes the characters that are no piece as the ids of their UTF-8 bytes."""
        unknown = np.flatnonzero(symbols < 0)
        codes = [chr(-1 - int(s)).encode() for s in symbols[unknown]]
        times = np.ones(len(symbols), np.int64)
        times[unknown] = [len(c) for c in codes]
        out, word = np.repeat(symbols, times), np.repeat(word, times)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(codes), np.uint8)]
        return out, word

    @staticmethod
    def cut(text: str) -> list[str]:
        """The words of a text, with the leading white space mark the model adds."""
        if text[0] == " " or "  " in text or SPACE in text:
            return _CUT.findall(SPACE + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed 32-bit ids of texts, without begin or end."""
        cut = [self.cut(t) if t else [] for t in texts]
        every = set().union(*cut)
        long = [w for w in every if len(w) > LONG]
        known = self.words.fill(every.difference(long), self.merge)
        if long:
            known = known | dict(zip(long, self.merge_long(long)))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, control ids left out, the added white space in front taken off."""
        out = b"".join(map(self.text.__getitem__, ids))
        return out.removeprefix(b" ").decode("utf-8", "replace")


def pieces(path: str) -> Pieces:
    return worker_state(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """doc_id and ids (array of int) of every row, with the end id at the end if asked.

    Null or empty text: the end id alone. Rows with a null id and repeated rows keep their rows. Texts of any length are encoded whole, also
    without white space in them.
    """
    return _run(docs, model, id_col, text_col, end, False)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """doc_id, ids, and ``decoded``: what decoding these ids gives."""
    return _run(docs, model, id_col, text_col, end, True)


def _run(docs: DataFrame, model: str, id_col: str, text_col: str, end: bool, back: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        tail = np.asarray([coder.end_id], "<i4").tobytes() if end else b""
        for batch in blocks(batches, most=BLOCK):
            packed = [ids + tail for ids in coder.encode(batch.column(1).to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(p) >> 2 for p in packed])]).astype(np.int32)
            flat = np.frombuffer(b"".join(packed), "<i4")
            out = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if back:
                cuts = offsets.tolist()
                out.append(pa.array([coder.decode(flat[a:b].tolist()) for a, b in zip(cuts, cuts[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * back)


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of lists of ids (null list: null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    chosen = rows.select(rows[id_col].cast("long").alias("doc_id"), rows[ids_col].cast("array<int>").alias("ids"))
    return chosen.mapInArrow(run, "doc_id long, text string")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (decimal, one space between) and of the decoded text."""
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
