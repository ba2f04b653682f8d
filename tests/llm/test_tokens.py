"""Token counts, SentencePiece rounds and token files against the libraries."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from fixtures import by_id, corpus, documents
from tidemark.llm import sentence_pieces, token_counts, token_files
from tidemark.llm.common import shared_folder
from tidemark.llm.sentence_pieces import Pieces
from tidemark.llm.word_bpe import WordBpe

WORDS, MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def mixed_texts(n: int) -> list[str]:
    pick = random.Random(7)
    letters = " \n\t▁aeotéßŒĳ'.,<|>sd0²日́Σς \x1c\x85😀"
    return ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def piece_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("cache", [50, 10**6])
def test_word_pieces_equal_library(word_library, cache):
    texts = mixed_texts(1500) + [t or "" for _, t in corpus()]
    ours = WordBpe(WORDS, cache)
    got = [np.frombuffer(p, "<u4").tolist() for i in range(0, len(texts), 100) for p in ours.encode(texts[i : i + 100])]
    assert got == [e.ids for e in word_library.encode_batch(texts, add_special_tokens=False)]


def test_letters_that_leave_the_plain_ones_in_lower_case(word_library):
    texts = ["xȺy Ɔa xyzƎa ȺB", "Əla bir İş, Ɓaŋ Ɗo’s", "plain ȾȾ words", "<|ENDOFTEXT|> <|endoftext|>Ə"]
    assert [np.frombuffer(p, "<u4").tolist() for p in WordBpe(WORDS).encode(texts)] == [word_library.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_library_meets_each_new_piece_once(word_library, monkeypatch):
    """No text goes through the library as a whole for a character that is no plain one, and no known pre-token again."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(299)]
    texts = [" ".join(words[i : i + 200]) + " “quoted” — Привет, 日本語. It’s" for i in range(100)] + [None, "", " \xa0\n"]
    coder, whole, met = WordBpe(WORDS), [], []
    library, encode_tokens = WordBpe.library, coder.tokens.make
    monkeypatch.setattr(WordBpe, "library", lambda self, text: whole.append(text) or library(self, text))
    coder.tokens.make = lambda tokens: met.extend(tokens.to_pylist()) or encode_tokens(tokens)
    got = [np.frombuffer(p, "<u4").tolist() for i in range(0, len(texts), 10) for p in coder.encode(texts[i : i + 10])]
    assert got == [word_library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted(whole) == sorted(["“quoted”", "—", "Привет,", "日本語.", "It’s"])
    assert len(met) == len(set(met)) and set(words) <= set(met)


def test_what_a_worker_keeps_is_bounded(word_library):
    coder = WordBpe(WORDS, 100)
    for k in range(8):
        texts = [f"often {'z' * 70}{k} " + " ".join(f"{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)}," for i in range(150))] * 3
        got = [np.frombuffer(p, "<u4").tolist() for p in coder.encode(texts)]
        assert got == [word_library.encode(t, add_special_tokens=False).ids for t in texts]
        for known in (coder.pieces, coder.tokens):
            assert len(known.keys) == len(known.ids) == len(known.uses) <= 200 and max(map(len, known.keys.to_pylist())) <= 64
    assert "often" in coder.pieces.keys.to_pylist()


@pytest.mark.parametrize("cache", [50, 10**6])
def test_merge_rounds_equal_library(piece_library, cache):
    texts = mixed_texts(1500) + [t or "" for _, t in corpus()] + ["aaaaaaa" * 50, "    " * 40, "abababab" * 30, "=-=-" * 99]
    ours = Pieces(MODEL, cache)
    got = [np.frombuffer(p, "<i4").tolist() for i in range(0, len(texts), 100) for p in ours.encode(texts[i : i + 100])]
    assert got == piece_library.encode(texts)
    assert [ours.decode([*ids, 2]) for ids in got] == [piece_library.decode([*ids, 2]) for ids in got]


def test_counts(spark, word_library):
    rows = corpus()
    got = by_id(token_counts.token_counts(documents(spark, rows), WORDS, limit=300))
    for i, text in rows:
        n = len(word_library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 300)


def test_counts_of_mixed_texts(word_library):
    """A character that is no plain one sends its piece to the library, not the text; only special strings send a text."""
    texts = mixed_texts(400) + ["It’s a — Привет мир, 日本語 text’s and plain words " * 3, "Ɔa xyzƎa ȺB İstanbul ΑΣ ΑΣ ́x e\u0301 a\u0300\u0327",
                                "日" * 500 + " end", "odd’ <|endoftext|> one", "<|END’", "K<|endoftext|>’"]
    n = [len(word_library.encode(t, add_special_tokens=False).ids) for t in texts]
    whole: list[str] = []
    library = WordBpe.library

    def seen(self, text):
        whole.append(text)
        return library(self, text)

    class Table:
        value = {"привет": len(word_library.encode("привет", add_special_tokens=False).ids), "words": len(word_library.encode("words", add_special_tokens=False).ids)}

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(WordBpe, "library", seen)
        patch.setattr(token_counts, "worker_state", lambda key, build: build())
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "n_bytes": pa.array([0] * len(texts), pa.int64())})
        [out] = token_counts._counts(WORDS, Table, 10)(iter([batch]))
    assert out.column(2).to_pylist() == n
    blank = set(" \t\n\x0b\x0c\r")
    assert {t for t in whole if blank & set(t)} == {t for t in texts if "<|endoftext|>" in t and " " in t}
    assert max(whole.count(t) for t in whole if t in ("—", "It’s", "text’s")) == 1


def test_round_trip(spark, piece_library):
    rows = corpus()
    trip = sentence_pieces.round_trip(documents(spark, rows), MODEL)
    got = by_id(sentence_pieces.digests(trip))
    texts = by_id(sentence_pieces.decode(trip, MODEL))
    for i, text in rows:
        ids = [*piece_library.encode(text or ""), piece_library.eos_id()]
        decoded = piece_library.decode(ids)
        assert got[i]["n_tokens"] == len(ids) and texts[i]["text"] == decoded
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_files(spark, word_library):
    rows = corpus()
    folder = shared_folder(spark, "files")
    token_files.write_token_files(documents(spark, list(reversed(rows))), folder, WORDS, 2)
    got, start = by_id(token_files.checksums(spark, folder)), 0
    for i, text in rows:
        ids = [*word_library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        start += len(ids)
    back = by_id(token_files.read_token_files(spark, folder))
    assert all(len(back[i]["ids"]) == got[i]["n_tokens"] and back[i]["start"] == got[i]["start"] for i, _ in rows)
    few = by_id(token_files.lookup(spark, folder, [5, 7]))
    assert set(few) == {5, 7} and few[5]["n_tokens"] == got[5]["n_tokens"]


def test_odd_tables(spark):
    empty = documents(spark, [])
    assert token_counts.token_counts(empty, WORDS).collect() == []
    assert sentence_pieces.digests(sentence_pieces.round_trip(empty, MODEL)).collect() == []
    folder = shared_folder(spark, "empty")
    token_files.write_token_files(empty, folder, WORDS, 2)
    assert token_files.checksums(spark, folder).collect() == []
    again = documents(spark, [(3, "one two"), (3, "one two"), (None, "x"), (None, None)])
    assert sorted(r.n_tokens for r in token_counts.token_counts(again, WORDS).collect()) == [0, 1, 2, 2]
    assert sentence_pieces.encode(again, MODEL).count() == 4
    folder = shared_folder(spark, "again")
    token_files.write_token_files(again, folder, WORDS, 2)
    rows = token_files.checksums(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 3, 3] and rows[-1].start + rows[-1].n_tokens == 9


def test_long_words_equal_the_library_in_time(piece_library):
    """Text without white space: letters at random, encoded data, mixed scripts, repeats, and characters that are no piece."""
    pick = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = [
        "".join(pick.choice(letters) for _ in range(100_000)), "".join(pick.choice("日本語のテキスト漢字かな交じり文") for _ in range(30_000)),
        "a" * 20_001, "ab" * 9_999, "".join(pick.choice("theinger") for _ in range(40_000)), "é" * 700 + "\U0001f600\u0378" * 300 + "x" * 5000,
        ("word" + "y" * 300 + " ") * 5, "z" * 256, "z" * 257, "".join(chr(pick.randrange(0x21, 0x2000)) for _ in range(20_000)),
    ]
    coder = Pieces(MODEL)
    started = time.perf_counter()
    got = coder.encode(texts)
    assert time.perf_counter() - started < 60
    for text, packed in zip(texts, got):
        assert np.frombuffer(packed, "<i4").tolist() == piece_library.encode(text)
    assert all(len(w) <= sentence_pieces.LONG for w in coder.words.young)


def test_long_and_short_words_merge_alike(monkeypatch, piece_library):
    """Every word by either way."""
    texts = [t for _, t in corpus() if t]
    for limit in (0, 3):
        monkeypatch.setattr(sentence_pieces, "LONG", limit)
        for text, packed in zip(texts, Pieces(MODEL).encode(texts)):
            assert np.frombuffer(packed, "<i4").tolist() == piece_library.encode(text)
