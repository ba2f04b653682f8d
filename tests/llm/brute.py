"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None) -> frozenset:
    words = BLANK_WORD.findall((text or "").translate(LOWER))
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()


def near_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, component)."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str, bytes]]:
    """doc_id: n_bytes, n_removed, n_spans, kept_sha256, kept."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def measures(text: str | None) -> dict:
    text = text or ""
    words = BLANK_WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    hit = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text)),
    }


def failed(m: dict) -> int:
    rules = (
        m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], 10 * m["n_symbols"] > 3 * m["n_words"],
        m["n_lines"] >= 5 and 10 * m["n_dup_lines"] > 7 * m["n_lines"],
        m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 20 * m["n_words"], 10 * m["n_upper"] > 6 * m["word_chars"],
    )
    return sum(1 << k for k, f in enumerate(rules) if f)


def plain_words(text: str | None) -> list[str]:
    return PLAIN_WORD.findall((text or "").translate(LOWER))


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, set]]:
    """doc_id: n_words, n_hit, item ids."""
    windows = defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        k = min(10, len(words))
        for i in range(len(words) - k + 1) if k else ():
            windows[tuple(words[i : i + k])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for k in sizes:
            for s in range(len(words) - k + 1):
                if (w := tuple(words[s : s + k])) in windows:
                    hit.update(range(s, s + k))
                    found |= windows[w]
        out[i] = (len(words), len(hit), found)
    return out
