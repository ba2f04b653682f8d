"""Benchmark decontamination (operator 8): a hash set of test n-grams against all word windows of the corpus.

The benchmark's windows (``size`` consecutive words; a shorter item is one window) are grouped by their words and keyed by
a 64-bit hash. A document is parsed once: its words are hashed, the hashes are doubled to windows of 2, 4 and 8 words, and
windows of every length that the benchmark has are put together from these. The windows are exploded into a hash join with the set,
so documents are not shuffled and a hot passage costs as much as any other text; only windows that match go on, after
their words have been compared in full. One more entry of the same array, which matches nothing, brings the document's
number of words along. The set is written first, and broadcast if its strings and ids have at most ``BROADCAST_BYTES``; a larger one
is joined by shuffle.

Hashes are of words in lower case of all scripts, so that equal words have equal hashes; the comparison in full lower-cases A-Z only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, written
from tidemark.llm.text_columns import CASED_WORD, at, plain_lower

WINDOW = 10
BROADCAST_BYTES = 256 << 20


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CASED_WORD), F.lit(0))


def _word_hashes(words: Column | str) -> Column:
    # Word by word: what a whole text's lower case makes of a word can depend on its neighbours.
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _joined(left: Column | str, right: Column | str, skip: int) -> Column:
    """Hashes of what ``left`` covers from every place on, followed by what ``right`` covers ``skip`` words later."""
    pairs = F.zip_with(left, F.slice(right, F.lit(skip + 1), F.greatest(F.size(right) - skip, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(right) - skip, F.lit(0)))


def _with_window_hashes(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Column ``w_{n}`` for every length: hashes of all windows of n words of ``words``, by their place."""
    rows = rows.withColumn("w_1", _word_hashes("words"))
    made, size = {1}, 1
    while 2 * size <= max(lengths):
        rows = rows.withColumn(f"w_{2 * size}", _joined(f"w_{size}", f"w_{size}", size))
        size *= 2
        made.add(size)
    for n in lengths:
        # The set bits of n, largest first; every sum on the way is kept.
        have, left = 0, n
        while left and n not in made:
            step = 1 << (left.bit_length() - 1)
            if have and have + step not in made:
                rows = rows.withColumn(f"w_{have + step}", _joined(f"w_{have}", f"w_{step}", have))
                made.add(have + step)
            have, left = have + step, left - step
    return rows


def _of_length(n: int) -> Column:
    return F.transform(f"w_{n}", lambda h: F.xxhash64(F.lit(n), h))


def benchmark_windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """words (joined), length and item_ids of every distinct window. Items without words have none."""
    rows = items.select(items[id_col].cast("string").alias("item_id"), _words(plain_lower(items[text_col].cast("string"))).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(size)))
    rows = rows.select("item_id", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("start"))
    rows = rows.select("item_id", "length", F.slice("words", F.col("start"), F.col("length")).alias("window"))
    return rows.groupBy("length", F.array_join("window", " ").alias("words")).agg(F.collect_set("item_id").alias("item_ids"))


def _keyed(windows: DataFrame, lengths: list[int]) -> DataFrame:
    rows = _with_window_hashes(windows.select("length", F.col("words").alias("wanted"), "item_ids", F.split("words", " ").alias("words")), lengths)
    key = F.coalesce(*[F.when(F.col("length") == n, at(F.col(f"w_{n}"), 0)) for n in lengths])
    return rows.select(F.xxhash64("length", key).alias("key"), F.col("length").alias("n"), "wanted", "item_ids")


def probe(docs: DataFrame, windows: DataFrame, carry: list[str]) -> DataFrame:
    """The ``carry`` columns with start, length and item_ids of every window of a document that the benchmark has too, and
    with ``n_words`` (start null) once for every row of ``docs`` (columns ``text`` and ``carry``)."""
    windows = written(windows, "benchmark-windows")
    about = windows.agg(
        F.sort_array(F.collect_set("length")).alias("lengths"),
        F.sum(F.length("words") + 64 + F.aggregate("item_ids", F.lit(0), lambda n, i: n + F.length(F.coalesce(i, F.lit(""))) + 8)).alias("bytes"),
    ).first()  # one row; at most ``size`` lengths
    lengths = list(about.lengths) or [WINDOW]
    rows = _with_window_hashes(docs.select(*carry, _words(F.col("text")).alias("words")), lengths)
    keys = [_of_length(n) for n in lengths]
    rows = rows.select(*carry, "words", F.concat(*keys, F.array(F.lit(None).cast("long"))).alias("keys"))
    # The outer form: the other one adds a filter below that would hash everything once more. No array is empty.
    each = rows.select(*carry, "words", F.posexplode_outer("keys").alias("place", "key"))
    wanted = _keyed(windows, lengths)
    met = each.join(F.broadcast(wanted) if (about.bytes or 0) <= BROADCAST_BYTES else wanted, "key", "left")
    # Windows of one length follow those of the shorter ones.
    before = F.lit(0)
    start = F.col("place")
    for n in lengths:
        start = F.when(F.col("n") == n, F.col("place") - before).otherwise(start)
        before = before + F.greatest(F.size("words") - (n - 1), F.lit(0))
    hit = F.col("n").isNotNull()
    met = met.where(F.col("key").isNull() | hit).withColumn("start", F.when(hit, start))
    window = F.slice("words", F.col("start") + 1, F.col("n"))
    met = met.where(F.col("start").isNull() | (plain_lower(F.array_join(window, " ")) == F.col("wanted")))
    return met.select(*carry, "start", F.col("n").alias("length"), "item_ids", F.when(~hit, F.size("words")).alias("n_words"))


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, text_key, start, length and item_ids of every window of a document that the benchmark has too."""
    return probe(docs, windows, ["doc_id", "text_key"]).where(F.col("start").isNotNull()).drop("n_words")


def _covered(spans: Column | str) -> Column:
    """Words inside any of the spans, which are sorted by start."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans, start,
        lambda acc, s: F.struct(
            (acc.n + F.greatest(s.start + s.length - F.greatest(s.start, acc.end), F.lit(0))).alias("n"),
            F.greatest(acc.end, s.start + s.length).alias("end"),
        ),
        lambda acc: acc.n,
    )


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit ``spans`` (start and length in words).

    Rows are told apart by id and text, so rows of one id with different texts keep their own results, and repeated
    rows repeat theirs. Null ids keep their rows; an item without id marks words but is not counted as an item.
    An empty benchmark marks nothing.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    found = probe(rows, benchmark_windows(items, size), ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("n_words").alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    n_hit = _covered("spans").cast("long")
    found = found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", "copies",
    )
    # Repeated rows again, in two steps so that no array grows with their number.
    steps = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 1000)))
    found = found.select("*", steps.alias("step"))
    each = F.explode(F.sequence(F.lit(1), F.least(F.col("copies") - F.col("step") * 1000, F.lit(1000))))
    return found.select("*", each.alias("copy")).drop("copies", "step", "copy")


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that share no window with the benchmark.

    Whole documents go: what is left of a text around a removed passage would still lead up to it. Rows with a null id or a
    null text are treated as any other (a null text has no words, and stays); an empty benchmark keeps all rows. The ids that go are
    written first, so that their size decides how they meet the documents: few are broadcast and no text is shuffled.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    bad = hits(rows, benchmark_windows(items, size)).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__key"))
    return docs.join(written(bad, "contaminated"), same, "left_anti")
