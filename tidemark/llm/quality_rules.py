"""Quality rules (operator 3): a ledger of failure bits and measurements, and policies over it.

``ledger`` evaluates every rule once per document and stores its measurements with one bit per failed rule. A
policy is a named, versioned set of rules, that is a bit mask: verdicts (``decide``) and ablations (``ablation``)
under any policy are bit operations on the stored ledger and read no text again.

Everything is a column expression over one row, so nothing is shuffled and a hot source costs nothing more.
A null text has no words.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text
from tidemark.llm.text_columns import BLANKS, at, blank_words

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    name: str
    failed: str


#: Bit k of the ledger is rule k. Rules are only ever added at the end, so old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 5 AND 10 * n_dup_lines > 7 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("shouting", "10 * n_upper > 6 * word_chars"),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document passes if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
DEFAULT = Policy("full-1", tuple(BIT))


def _measured(rows: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns ``more`` and the measurements of rows with doc_id and text."""
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
    rows = rows.withColumn("words", blank_words(F.col("text")))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn(
        "hashes",
        F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, at("words", i + 1), at("words", i + 2))),
    )
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    rows = rows.select(
        "doc_id", *more, "n_words", "hashes", F.sort_array("hashes").alias("sorted"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"), lines.alias("lines"),
    )
    rows = rows.select(
        "doc_id", *more, "n_words", "word_chars", "n_symbols", "n_upper", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "hashes",
        F.array_distinct(F.filter("sorted", lambda h, i: h == at("sorted", i - 1))).alias("repeated"),
    )
    # Places of repeated windows: none for most texts; a few hashes are looked up one by one, many by sorting
    # the windows with their places. Both ways give the same places.
    lookup = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.array_contains("repeated", at("hashes", i)))
    rows = rows.withColumn(
        "placed",
        F.when(F.size("repeated") > 24, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    neighbour = F.filter("placed", lambda x, k: (x.h == at("placed", k - 1).h) | (x.h == at("placed", k + 1).h))
    rows = rows.withColumn(
        "places",
        F.when(F.size("repeated") == 0, F.array().cast("array<int>")).when(F.size("repeated") <= 24, lookup)
        .otherwise(F.sort_array(F.transform(neighbour, lambda x: x.i))),
    )
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(at("places", k + 1), p + 3) - p)), F.lit(0), lambda total, n: total + n
    )
    return rows.withColumn("n_repeat_words", covered.cast("long")).select("doc_id", *more, *MEASURES)


def _failed() -> Column:
    bits = [F.when(F.expr(rule.failed), F.lit(BIT[rule.name])).otherwise(F.lit(0)) for rule in RULES]
    return functools.reduce(Column.bitwiseOR, bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit k is set where rule k fails."""
    return _measured(id_and_text(docs, id_col, text_col)).withColumn("failed", _failed())


def decide(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with ``kept``: whether the document fails none of the policy's rules."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that would be kept without it.

    The ledger shrinks to one row per failure pattern (at most two to the power of the rules) before rules are looked at.
    """
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("pattern")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules]))
    each = patterns.withColumn("r", rules).select("pattern", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("pattern").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("pattern") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )


def keep(docs: DataFrame, policy: Policy = DEFAULT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with all their columns."""
    rows = docs.select(F.lit(0).alias("doc_id"), docs[text_col].cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    decided = decide(_measured(rows, "row").withColumn("failed", _failed()), policy)
    # The optimizer would move the condition down and repeat every measurement inside it; it does not move past an id.
    passed = decided.withColumn("stay", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("stay") >= 0))
    return passed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
