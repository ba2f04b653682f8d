"""License scans (operator 9): a positional index of rare licence words, checked by alignment and key phrases.

Two passes of column expressions, without a shuffle of documents:

1. Document frequencies of all licence words over all documents (one small aggregate). Each template is indexed by its
   ``INDEXED`` words of highest inverse document frequency, with their places in the template.
2. Per file: all its indexed words are looked up (a file may hold every template). Every occurrence votes, for each
   place of that word in a template, for the word position at which the template would start; starts with two votes
   or more are candidates. A candidate counts if the template's key phrase stands at its place, and its
   score is the share of the template's words that stand at theirs.

The index is a constant of a few dozen words, so nothing that grows with the data is broadcast.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text
from tidemark.llm.text_columns import ascii_lower, at, plain_words

#: Phrases that name a licence, and its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, key phrase and opening words of widely used licence notices.
TEMPLATES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "mit license", "licensed under the mit license"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "in compliance with the license", "you may not use this file except in compliance with the license"),
    ("gpl", "general public license", "under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc", "creative commons attribution", "this work is licensed under a creative commons attribution"),
)
INDEXED, LEAST_SCORE = 4, 0.6
#: Words of one file that are looked up: as many as the index can hold, that is all of them.
LOOKED_UP = INDEXED * len(TEMPLATES)


def _vocabulary() -> list[str]:
    return sorted({w for _, _, text in TEMPLATES for w in text.split()})


def frequencies(rows: DataFrame) -> dict[str, int]:
    """How many documents have each licence word; at most as many rows as the templates have words."""
    words = F.array(*[F.lit(w) for w in _vocabulary()])
    there = rows.select(F.explode(F.array_intersect(plain_words(ascii_lower(F.col("text"))), words)).alias("word"))
    return {r.word: r.n for r in there.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rarest(words: list[str], counts: dict[str, int]) -> list[str]:
    """Distinct words by falling inverse document frequency; ties by name."""
    return sorted(set(words), key=lambda w: (counts.get(w, 0), w))


def _index(counts: dict[str, int]) -> tuple[list[str], list[tuple[str, str, list[str], list[tuple[str, int]]]]]:
    """All indexed words, rarest first, and label, key phrase, words and postings of each template."""
    out, used = [], set()
    for label, phrase, text in TEMPLATES:
        words = text.split()
        chosen = rarest(words, counts)[:INDEXED]
        used.update(chosen)
        out.append((label, phrase, words, [(w, i) for i, w in enumerate(words) if w in chosen]))
    return rarest(list(used), counts), out


def _starts(words: Column | str, phrase: str) -> Column:
    """Places where the words of a phrase stand one after another."""
    parts = phrase.split()
    hit = lambda i: functools.reduce(Column.__and__, [F.coalesce(at(words, i + k) == F.lit(w), F.lit(False)) for k, w in enumerate(parts)])
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), hit)
    return F.when(F.array_contains(words, parts[-1]), places).otherwise(F.array().cast("array<int>"))


def _votes(template: tuple[str, str, list[str], list[tuple[str, int]]]) -> Column:
    """Starts of a template that the looked-up words at ``places`` vote for, sorted."""
    by_word: dict[str, list[int]] = {}
    for word, place in template[3]:
        by_word.setdefault(word, []).append(place)

    def votes(p: Column) -> Column:
        out = F
        for word, offsets in by_word.items():
            out = out.when(at("words", p) == F.lit(word), F.array(*[(p - o).cast("int") for o in offsets]))
        return out.otherwise(F.array().cast("array<int>"))

    return F.sort_array(F.flatten(F.transform("places", votes)))


def _supported(votes: Column) -> Column:
    """Distinct values that stand at least twice in a sorted array."""
    twice = F.transform(votes, lambda s, k: F.when(s == at(votes, k + 1), s))
    return F.array_distinct(F.array_compact(twice))


def _best(starts: Column, template: tuple[str, str, list[str], list[tuple[str, int]]]) -> Column:
    """Score of a template at the best start where its key phrase stands, 0 if there is none."""
    _, phrase, wanted, _ = template
    key = phrase.split()
    offset = next(i for i in range(len(wanted)) if wanted[i : i + len(key)] == key)
    stands = lambda i, w: F.coalesce(at("words", i) == F.lit(w), F.lit(False))
    verified = F.filter(starts, lambda s: functools.reduce(Column.__and__, [stands(s + (offset + k), w) for k, w in enumerate(key)]))
    share = lambda s: functools.reduce(Column.__add__, [stands(s + k, w).cast("int") for k, w in enumerate(wanted)]) / F.lit(float(len(wanted)))
    return F.coalesce(F.array_max(F.transform(verified, share)), F.lit(0.0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    ``score`` is that of the best template found in the file, 0 without any. Null or empty text: no words, no labels.
    Rows with a null id and repeated rows keep their rows. ``counts`` are document frequencies, taken from ``docs`` if
    not given.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    indexed, templates = _index(frequencies(rows) if counts is None else counts)
    rows = rows.withColumn("words", plain_words(ascii_lower(F.col("text"))))
    top = F.array_intersect(F.array(*[F.lit(w) for w in indexed]), "words")
    rows = rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), top.alias("top"),
                       *[_starts("words", p).alias(f"base_{k}") for k, p in enumerate(PHRASES)])
    looked = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains("top", at("words", i)))
    rows = rows.withColumn("places", F.when(F.size("top") > 0, looked).otherwise(F.array().cast("array<int>")))
    some = F.size("places") > 1
    rows = rows.withColumn("votes", F.when(some, F.array(*[_votes(t) for t in templates])))
    rows = rows.withColumn("starts", F.transform("votes", _supported))
    rows = rows.withColumn("scores", F.when(some, F.array(*[_best(at("starts", k), t) for k, t in enumerate(templates)])))
    bases = [f"base_{k}" for k in range(len(PHRASES))]
    every = F.concat(*bases)
    own = F.array_compact(F.array(*[F.when(F.size(b) > 0, F.lit(label)) for b, label in zip(bases, PHRASES.values())]))
    more = F.array_compact(F.array(*[F.when(at("scores", k) >= LEAST_SCORE, F.lit(t[0])) for k, t in enumerate(templates)]))
    return rows.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_join(F.sort_array(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(own, more)), ",").alias("labels"),
        F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("score"),
    )
