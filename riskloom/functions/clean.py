"""Column expressions that clean raw values: dates, flags, numbers, labels, paths."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that mark a C or C++ source path.
CODE_EXTENSIONS = ["c", "cc", "cpp", "cxx", "c++", "h", "hh", "hpp", "hxx", "h++"]
# Texts read as true.
TRUE_WORDS = ["true", "1", "t", "yes"]

# Days, and days with a time; a text without a zone is in UTC. Anything else is no time.
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd")
_TIME = r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d(?::\d\d)?)(?:[.,](\d{1,9}))?\s?(Z|z|UTC|[+-]\d\d(?::?\d\d)?)?$"


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _shape(date_format: str) -> str:
    """Regex of the texts a format can match. A failed parse costs far more than this test."""
    return "^" + re.sub(r"yyyy|MM|dd", lambda m: r"\d{4}" if m[0] == "yyyy" else r"\d\d", date_format) + "$"


def iso_timestamp(value: str | Column) -> Column:
    """ISO-like times: ``T`` or a blank, optional seconds, fraction (to microseconds) and zone
    (``Z``, ``+hh``, ``+hhmm`` or ``+hh:mm``; without one UTC); null for any other text."""
    text = F.trim(as_col(value))
    part = lambda k: F.regexp_extract(text, _TIME, k)
    clock = F.when(F.length(part(2)) == 5, F.concat(part(2), F.lit(":00"))).otherwise(part(2))
    digits = F.replace(F.replace(part(4), F.lit(":"), F.lit("")), F.lit("UTC"), F.lit(""))
    zone = F.when(digits.rlike(r"^[+-]"), F.concat(F.substring(digits, 1, 3), F.lit(":"), F.rpad(F.substring(digits, 4, 2), 2, "0"))).otherwise(F.lit("+00:00"))
    plain = F.concat(part(1), F.lit(" "), clock, F.lit("."), F.rpad(F.substring(part(3), 1, 6), 6, "0"), zone)
    return F.when(text.rlike(_TIME), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSXXX")))


def lenient_timestamp(value: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """ISO-like times, else the first day format that parses; null when none does. Formats use
    yyyy, MM and dd."""
    text = F.trim(as_col(value))
    return F.coalesce(iso_timestamp(text), *[F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats])


def instant(value: str | Column) -> Column:
    """A time from a text, a date or a time; a text that is none becomes null."""
    value = as_col(value)
    return F.coalesce(value.try_cast("timestamp"), lenient_timestamp(value.cast("string")))


def day_text(value: str | Column) -> Column:
    """Day of an ISO-like text as it is written, in its own time zone; empty when there is none."""
    text = F.trim(as_col(value))
    leading = F.when((F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-") & (F.length(text) >= 10), F.substring(text, 1, 10))
    short = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy-M-d")))
    return F.coalesce(leading, F.date_format(short, "yyyy-MM-dd"), F.lit(""))


def utc_iso_text(value: str | Column) -> Column:
    """ISO text in UTC; null where the value is no time."""
    return F.date_format(instant(value), "yyyy-MM-dd'T'HH:mm:ssxxx")


def utc_day(value: str | Column) -> Column:
    """Day in UTC; null where the value is no time."""
    return F.to_date(instant(value))


def truthy_words(value: str | Column) -> Column:
    """1 for the fixed true words, else 0."""
    return F.coalesce(F.lower(F.trim(as_col(value).cast("string"))).isin(TRUE_WORDS).cast("int"), F.lit(0))


def truthy_exact(value: str | Column) -> Column:
    """1/0 for the exact texts True and False, null for anything else."""
    text = as_col(value).cast("string")
    return F.when(text == "True", 1).when(text == "False", 0)


def truthy_number(value: str | Column, cut: float = 0.5) -> Column:
    """1 where the value reads as a number of at least ``cut``, else 0."""
    number = as_col(value).cast("string").try_cast("double")
    return F.coalesce((number >= F.lit(cut)).cast("int"), F.lit(0))


def truthy_label(value: str | Column) -> Column:
    """Numbers count from 0.5 on; texts that are no number go through the true words."""
    number = as_col(value).cast("string").try_cast("double")
    return F.when(number.isNotNull(), (number >= 0.5).cast("int")).otherwise(truthy_words(value))


def number_or_null(value: str | Column) -> Column:
    """Invalid text, NaN and empty become null."""
    number = F.trim(as_col(value).cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def number_or_zero(value: str | Column) -> Column:
    return F.coalesce(number_or_null(value), F.lit(0.0))


def missing_to_null(value: str | Column) -> Column:
    """NaN and both infinities become null."""
    v = as_col(value)
    inf = float("inf")
    return F.when(~F.isnan(v) & (v != F.lit(inf)) & (v != F.lit(-inf)), v)


def within_open_ended(day: str | Column, start: Column | None, end: Column | None) -> Column:
    """Inclusive range test with open ends; ends given the wrong way round are swapped."""
    d = as_col(day)
    if start is None and end is None:
        return F.lit(True)
    if start is None:
        return d <= end
    if end is None:
        return d >= start
    return d.between(F.least(start, end), F.greatest(start, end))


def missing_or_within(ts: str | Column, start: Column, end: Column) -> Column:
    """Rows whose time is unknown pass."""
    t = as_col(ts)
    return t.isNull() | t.between(start, end)


def clip_low(value: str | Column, floor: float = 0.0) -> Column:
    return F.greatest(as_col(value), F.lit(floor))


def nullable_flag(score: str | Column, threshold: float) -> Column:
    """1/0 by threshold, null for a null score."""
    s = as_col(score)
    return F.when(s >= threshold, 1).when(s < threshold, 0)


def canonical_name(value: str | Column, names: Mapping[str, str], rewrites: Sequence[tuple[str, str]]) -> Column:
    """Dictionary name if there is one, else the regex rewrites in order."""
    raw = as_col(value)
    rewritten = raw
    for pattern, replacement in rewrites:
        rewritten = F.regexp_replace(rewritten, pattern, replacement)
    if not names:
        return rewritten
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, raw), rewritten)


def same_ignoring_case(value: str | Column, wanted: str) -> Column:
    return F.lower(as_col(value)) == F.lower(F.lit(wanted))


def is_code_path(path: str | Column, extensions: Sequence[str] = tuple(CODE_EXTENSIONS)) -> Column:
    pattern = "|".join(e.replace("+", r"\+") for e in extensions)
    return F.lower(as_col(path)).rlike(rf"\.({pattern})$")
