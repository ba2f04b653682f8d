"""The lower-casing word tokenizer (``word_bpe_49k.json``) through caches of pieces and of pre-tokens.

The tokenizer normalises (NFC, one space for white space, lower case), drops white space and cuts what is
left into pre-tokens; none spans white space. So the ids of a text are those of its pieces between ASCII white space, one after
another. Arrow cuts a batch of texts and numbers its distinct pieces; only those not yet known are cut into pre-tokens, and of these only
the unknown ones are encoded, many in a call; ids are gathered by number. That holds for pieces of plain Latin characters, where Python's
lower case and white space agree with the tokenizer's; other pieces are encoded by the library each, and texts with a special
token's string go through it as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import worker_state

#: Pieces, and pre-tokens, that a worker's caches keep when they have grown to twice as many.
CACHE_TOKENS = 120_000
#: Pre-tokens that the library encodes in one call; what it returns takes far more memory than the ids.
CALL_TOKENS = 1000
#: Characters up to which a piece or pre-token is kept (text without white space has pieces of any length).
LONGEST_KEPT = 64


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: Code points below U+0250 that stay there in lower case, but for the separators U+001C to U+001F and U+0085 (white space for
#: one side only).
PLAIN = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x250)) if c not in "\x1c\x1d\x1e\x1f\x85" and max(c.lower()) < "\u0250") + "]*")

#: The tokenizer's own pre-token pattern, for characters below U+0250.
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def _packed(lists: pa.ListArray, cuts: np.ndarray) -> list[bytes]:
    """The ids between each two cuts (numbers of lists)."""
    flat = lists.values.to_numpy().astype("<i4", copy=False).tobytes()
    at = (lists.offsets.to_numpy()[cuts].astype(np.int64) * 4).tolist()
    return [flat[a:b] for a, b in zip(at, at[1:])]


class Known:
    """The id lists of strings, the most used of which are kept, as Arrow arrays."""

    def __init__(self, size: int, make: Callable[[pa.Array], pa.ListArray]):
        self.size, self.make = size, make
        self.keys, self.ids, self.uses = pa.array([], pa.large_string()), _lists(np.zeros(0, np.int32), np.zeros(1, np.int32)), np.zeros(0, np.int64)

    def get(self, values: pa.Array) -> pa.ListArray:
        """The ids of every value; those of new values are made from an array of these, each once."""
        n = len(self.keys)
        # What is kept comes first, so it has the numbers up to n.
        coded = pa.concat_arrays([self.keys, values]).dictionary_encode()
        at = coded.indices.to_numpy()[n:]
        self.keys = coded.dictionary
        self.ids = pa.concat_arrays([self.ids, self.make(self.keys.slice(n))])
        found = self.ids.take(pa.array(at))
        self.uses = np.bincount(at, minlength=len(self.keys)) + np.concatenate([self.uses, np.zeros(len(self.keys) - n, np.int64)])
        self._forget(n)
        return found

    def _forget(self, n: int) -> None:
        keep = np.concatenate([np.ones(n, bool), pc.less_equal(pc.utf8_length(self.keys.slice(n)), LONGEST_KEPT).to_numpy(zero_copy_only=False)])
        if keep.sum() > 2 * self.size:
            most = np.argpartition(np.where(keep, self.uses, -1), len(keep) - self.size)[-self.size :]
            keep[:] = False
            keep[most] = True
            # Old use counts half.
            self.uses >>= 1
        if not keep.all():
            self.keys, self.ids, self.uses = self.keys.filter(pa.array(keep)), self.ids.filter(pa.array(keep)), self.uses[keep]


class WordBpe:
    """Encodes batches of texts; ids are returned as packed little-endian 32-bit integers."""

    def __init__(self, path: str, cache_tokens: int = CACHE_TOKENS):
        # A task has its core; the library starts no threads of its own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # For pre-tokens, which are normalised and cut already.
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether an id ends a pre-token.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.tokens, self.pieces = Known(cache_tokens, self._encode_tokens), Known(cache_tokens, self._encode_new)

    def library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def has_special(self, text: str) -> bool:
        return "<|" in text and any(s in text for s in self.special)

    def is_plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not self.has_special(text)

    def _by_library(self, texts: list[str]) -> pa.ListArray:
        packed = [self.library(t) for t in texts]
        return _lists(np.frombuffer(b"".join(packed), "<i4"), np.cumsum([0, *map(len, packed)]) >> 2)

    def _encode_tokens(self, tokens: pa.Array) -> pa.ListArray:
        """The ids of pre-tokens, ``CALL_TOKENS`` from one call of the library."""
        tokens = tokens.to_pylist()
        joined = [" ".join(tokens[i : i + CALL_TOKENS]) for i in range(0, len(tokens), CALL_TOKENS)]
        ids = np.concatenate([np.zeros(0, np.int32), *(np.asarray(self.bare.encode_batch_fast([j], add_special_tokens=False)[0].ids, np.int32) for j in joined)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(tokens) or len(ids) != (ends[-1] if len(ends) else 0):
            return self._by_library(tokens)
        return _lists(ids, np.concatenate([[0], ends]))

    def _encode_plain(self, pieces: list[str]) -> pa.ListArray:
        cut = [PRE_TOKEN.findall(p) for p in pieces]
        lists = self.tokens.get(pa.array(chain.from_iterable(cut), pa.large_string()))
        return _lists(lists.values.to_numpy(), lists.offsets.to_numpy()[np.cumsum([0, *map(len, cut)])])

    def _encode_new(self, pieces: pa.Array) -> pa.ListArray:
        """The ids of pieces as they stand in a text, without a special token's string."""
        pieces = pieces.to_pylist()
        plain = np.asarray([PLAIN.fullmatch(p) is not None for p in pieces], bool)
        if plain.all():
            return self._encode_plain([p.lower() for p in pieces])
        first, then = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        lists = pa.concat_arrays([self._encode_plain([pieces[i].lower() for i in first]), self._by_library([pieces[i] for i in then])])
        return lists.take(pa.array(np.argsort(first + then)))

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of white-space free, lower-case, plain pieces."""
        return _packed(self._encode_plain(pieces), np.arange(len(pieces) + 1))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = [t is not None and self.has_special(t) for t in texts]
        # Plain texts are made lower case at once, so that fewer pieces are distinct.
        cut = ["" if w or not t else t.lower() if PLAIN.fullmatch(t) else t for t, w in zip(texts, whole)]
        rows = pc.ascii_split_whitespace(pa.array(cut, pa.large_string()))
        packed = _packed(self.pieces.get(rows.values), rows.offsets.to_numpy())
        return [self.library(t) if w else ids for t, w, ids in zip(texts, whole, packed)]


def encoder(path: str) -> WordBpe:
    """The worker's encoder for a vocabulary file."""
    return worker_state(("word_bpe", path), lambda: WordBpe(path))
