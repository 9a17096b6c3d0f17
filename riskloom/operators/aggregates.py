"""Grouped summaries. Everything here combines on the map side before it shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import numeric as nm
from riskloom.functions.clean import as_col


def last_non_null(value: str | Column, *order: str | Column) -> Column:
    """Value of the last row in ``order`` that has one; unlike ``last`` it is deterministic."""
    v = as_col(value)
    return F.max_by(v, F.when(v.isNotNull(), F.struct(*[as_col(o) for o in order])))


def rule_aggregate(
    df: DataFrame, keys: Sequence[str], rules: Mapping[str, str], order: Sequence[str] = (), names: Mapping[str, str] | None = None
) -> DataFrame:
    """One function per column (count, sum, mean, max, min, last); absent columns are skipped."""
    plain = {"count": F.count, "sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}
    aggs = []
    for column, rule in rules.items():
        if column not in df.columns:
            continue
        value = last_non_null(column, *order) if rule == "last" else plain[rule](column)
        aggs.append(value.alias((names or {}).get(column, column)))
    return df.groupBy(*keys).agg(*aggs)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first in ``order``. Ends in a partial group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return out.select(*columns) if columns else out


def quartiles(value: str | Column, prefix: str = "", weight: str | None = None) -> list[Column]:
    """Median, quartiles and count of finite values; for domains with few distinct values.

    ``weight`` names a column with the count a row stands for.
    """
    v = as_col(value).cast("double")
    inf = float("inf")
    finite = F.when(~F.isnan(v) & (v < inf) & (v > -inf), v)
    n = F.col(weight) if weight else F.lit(1)
    return [
        F.percentile(finite, F.lit(0.5), n).alias(f"{prefix}median"),
        F.percentile(finite, F.lit(0.25), n).alias(f"{prefix}q1"),
        F.percentile(finite, F.lit(0.75), n).alias(f"{prefix}q3"),
        F.coalesce(F.sum(F.when(finite.isNotNull(), n)), F.lit(0)).cast("bigint").alias(f"{prefix}count"),
    ]


def daily_share(df: DataFrame, keys: Sequence[str], part: str, whole: str, name: str) -> DataFrame:
    """Sums per group and their ratio in percent, 0 for an empty whole."""
    sums = df.groupBy(*keys).agg(F.sum(part).alias(part), F.sum(whole).alias(whole))
    return sums.withColumn(name, nm.percent(part, whole))


def schedule_summary(df: DataFrame, value: str, keys: Sequence[str] = (), means: Mapping[str, str] | None = None) -> DataFrame:
    """Rows, distinct entities and days, the total and optional means, overall or per group.

    Distinct counts are taken over (group, entity, day) combinations that a first group-by
    has already made unique, so a large strategy does not meet in one task.
    """
    sums = {f"_s{i}": c for i, c in enumerate((means or {}).values())}
    grain = df.groupBy(*keys, *[c for c in ("project", "day") if c not in keys]).agg(
        F.count("*").alias("_n"),
        F.sum(value).alias("_v"),
        *[F.sum(c).alias(a) for a, c in sums.items()],
        *[F.count(c).alias(f"{a}n") for a, c in sums.items()],
    )
    aggs = [F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")]
    if "project" not in keys:
        aggs.append(F.countDistinct("project").alias("unique_projects"))
    aggs += [F.countDistinct("day").alias("unique_days"), F.coalesce(F.sum("_v"), F.lit(0)).alias(value)]
    for (a, _), name in zip(sums.items(), means or {}):
        aggs.append((F.sum(a) / F.sum(f"{a}n")).alias(name))
    return grain.groupBy(*keys).agg(*aggs)


def error_statistics(actual: str | Column, predicted: str | Column) -> list[Column]:
    """MAE, RMSE, MAPE over non-zero actuals, and the row count."""
    a, p = as_col(actual), as_col(predicted)
    gap = F.abs(a - p)
    return [
        F.avg(gap).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.when(F.abs(a) > 1e-12, gap / F.abs(a))).alias("mape"),
        F.count(gap).alias("count"),
    ]


def class_floor(df: DataFrame, entity: str, label: str, floor: int) -> DataFrame:
    """Rows of entities whose rarer class has at least ``floor`` rows.

    A group-by and a semi join: a window over the entity would hold all its rows in one task.
    """
    big = df.groupBy(entity).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    return df.join(big.filter(F.least("_p", "_n") >= floor).select(entity), entity, "left_semi")


def confusion(label: str | Column, predicted: str | Column) -> list[Column]:
    y, p = as_col(label), as_col(predicted)
    return [
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    ]


def class_report() -> list[Column]:
    """Precision, recall, F1, accuracy and MCC from tp/fp/fn/tn.

    Without positives recall, F1 and MCC are null, and precision is 0 if anything was
    predicted positive, else null. Other zero denominators give 0.
    """
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    none = tp + fn == 0
    precision = F.when(none & (tp + fp == 0), None).otherwise(F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)))
    f1 = F.when(~none, F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)))
    # one root per factor: the product of four counts would leave the exact range of a double
    scale = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    mcc = F.when(~none, F.when(scale == 0, 0.0).otherwise((tp * tn - fp * fn) / scale))
    return [
        precision.alias("precision"),
        F.when(~none, tp / (tp + fn)).alias("recall"),
        f1.alias("f1"),
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        mcc.alias("mcc"),
        (F.col("tp") + F.col("fn")).alias("support"),
    ]


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value).filter(F.col(value).isNotNull())


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a global aggregate (exactly one row) to every row."""
    return df.crossJoin(F.broadcast(one_row))
