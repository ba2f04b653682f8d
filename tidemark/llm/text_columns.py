"""Column expressions over texts that several native operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space; every other character belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
#: What separates words of letters and digits: all of ASCII but 0-9 and a-z (after lower-casing A-Z).
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters outside ASCII that a full lower-casing may change.
_OTHER_CASE = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def blank_words(text: Column) -> Column:
    """Words between ASCII white space, as an array (empty for a text without words)."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ``lower`` does where nothing else has an upper case."""
    return F.when(F.regexp_like(text, F.lit(_OTHER_CASE)), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def plain_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; for few or short texts."""
    return F.translate(text, _UPPER, _LOWER)


def plain_words(lowered: Column) -> Column:
    """Words of letters, digits and non-ASCII characters of a text in lower case."""
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def at(words: Column | str, i: Column | int) -> Column:
    """Element ``i`` from 0, null outside."""
    return F.get(words, i if isinstance(i, Column) else F.lit(i))
