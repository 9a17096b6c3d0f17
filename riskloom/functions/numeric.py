"""Column expressions over numbers: thresholds, rates, weights, rounding, seeded draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.clean import as_col, instant

EPS = 1e-9


def _number(value: str | Column) -> Column:
    """The value as a double; text that is no number becomes null."""
    return as_col(value).cast("string").try_cast("double")


def first_positive(candidates: Sequence[str | Column]) -> Column:
    """First finite value above zero, else infinity."""
    inf = F.lit(float("inf"))
    picks = []
    for c in candidates:
        v = _number(c)
        picks.append(F.when((v > 0) & (v < inf) & ~F.isnan(v), v))
    return F.coalesce(*picks, inf)


def scaled_duration(days: str | Column, rate: str | Column) -> Column:
    """Days times the rate where there is a positive rate, else the days; negatives are null."""
    d, r = _number(days), _number(rate)
    return F.when(d >= 0, F.when(r > 0, d * r).otherwise(d))


def whole_days_between(start: str | Column, end: str | Column) -> Column:
    """Floor of the exact span, so a negative part of a day counts as a full one; null unless both are times."""
    micros = F.unix_micros(instant(end)) - F.unix_micros(instant(start))
    return F.floor(micros / F.lit(86400000000)).cast("bigint")


def churn_weight(churn: str | Column, base: str | Column, cap: float | None = None) -> Column:
    """log1p ratio against the past median; 1 where there is no positive median."""
    x, b = F.greatest(as_col(churn).cast("double"), F.lit(0.0)), as_col(base).cast("double")
    ratio = F.log1p(x) / F.log1p(b)
    if cap is not None and cap > 0:
        ratio = F.least(ratio, F.lit(float(cap)))
    return F.when(b > 0, ratio).otherwise(F.lit(1.0))


def rounded(value: str | Column, mode: str = "ceil") -> Column:
    v = as_col(value)
    if mode == "ceil":
        out = F.ceil(v - F.lit(EPS))
    elif mode == "floor":
        out = F.floor(v + F.lit(EPS))
    elif mode == "round":
        out = F.bround(v, 0)
    else:
        raise ValueError(f"unknown rounding mode {mode!r}")
    return F.greatest(out.cast("bigint"), F.lit(0).cast("bigint"))


def keyed_uniform(seed: int, *keys: str | Column) -> Column:
    """Draw in [0, 1) fixed by the keys and the seed, the same on every executor and run."""
    token = F.concat_ws("::", *[F.coalesce(as_col(k).cast("string"), F.lit("-")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def percent(part: str | Column, whole: str | Column) -> Column:
    """Share times 100; zero for an empty whole."""
    p, w = as_col(part), as_col(whole)
    return F.when(w > 0, p.cast("double") / w.cast("double") * 100.0).otherwise(F.lit(0.0))


def ratio_or_null(part: str | Column, whole: str | Column) -> Column:
    p, w = as_col(part).cast("double"), as_col(whole).cast("double")
    return F.when(w != 0, p / w)


def as_percentage(rate: str | Column) -> Column:
    """Shares up to 1 become percentages; larger values are taken as percentages already."""
    r = as_col(rate)
    return F.when(r <= 1.0, r * 100.0).otherwise(r)
