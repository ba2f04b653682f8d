"""Documents that hold the awkward cases, and a reader of results."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SYLLABLES = "ka lo mi re su ta vo ne pi du or an is ut em".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 4)))
    out = []
    while len(out) < n:
        line = [word() for _ in range(pick.randint(4, 12))]
        out += [line[0].capitalize(), *line[1:-1], line[-1] + ".\n"]
    return " ".join(out[:n])


def changed(text: str, seed: int, times: int) -> str:
    pick, words = random.Random(seed), text.split(" ")
    for i in pick.sample(range(len(words)), times):
        words[i] = f"changed{pick.randint(0, 10**6)}"
    return " ".join(words)


def corpus() -> list[tuple[int, str | None]]:
    """Null, empty and blank texts, copies, near copies, shared passages, other scripts, special strings, long texts."""
    base, passage = prose(1, 160), prose(2, 60)
    texts: list[str | None] = [None, "", " \t\n ", "one", "Two words", base, base, base.upper()]
    texts += [changed(base, k, 1 + k % 5) for k in range(14)]
    texts += [prose(10 + k, 40 + 9 * k) + " " + passage + " " + prose(50 + k, 30) for k in range(5)]
    texts += ["Aa bb Aa bb " * 60, "x" * 350, "é" * 130 + "ü" + "é" * 130, "日本語のテキスト " * 20, "a b c d e f g h i j " * 15]
    texts += ["say <|endoftext|> don't we'll 3.14 İstanbul Σίσυφος\x85ﬁ", "tab\tand\x0bfeed\x0c ▁ mark  two   three\n\nlines \x00 nul"]
    texts += [prose(99, 9000), "This is licensed under the MIT License, see MIT license and the Apache License, Version 2.0.", "\n".join(["same line here"] * 9)]
    return list(enumerate(texts))


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """The rows with further columns whose names operators use inside."""
    wide = [(i, t, "en", "src0", len(t or ""), "clash", 1) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, words string, key int")


def by_id(df: DataFrame) -> dict:
    rows = [r.asDict() for r in df.collect()]
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out
