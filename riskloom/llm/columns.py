"""Column expressions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; plain ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def fenced_words(text: Column) -> Column:
    """Lower-cased words, each with a blank on both sides (so `` a  b ``); no word gives one blank."""
    apart = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")
    return F.concat(F.lit(" "), F.btrim(apart, F.lit(" ")), F.lit(" "))


def fenced_count(fenced: Column) -> Column:
    """Words of a fenced text: every word has two blanks of its own."""
    blanks = F.length(fenced) - F.length(F.replace(fenced, F.lit(" "), F.lit("")))
    return F.when(F.length(fenced) == blanks, 0).otherwise((blanks / 2).cast("long")).cast("long")


def fenced(words: str) -> str:
    return "".join(f" {w} " for w in words.split())


def blank_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
