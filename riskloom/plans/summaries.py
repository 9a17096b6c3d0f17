"""Summaries that compare strategies and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def against_baseline(per_project: DataFrame, baseline: DataFrame, value: str, entity: str = "project") -> DataFrame:
    """Per-project totals beside their baseline; what is missing counts as 0."""
    base = baseline.select(entity, F.col("baseline"))
    joined = per_project.join(base, entity, "left").withColumns(
        {"baseline": F.coalesce("baseline", F.lit(0.0)), value: F.coalesce(value, F.lit(0))}
    )
    return joined.withColumns(
        {
            "residual": F.greatest(F.col("baseline") - F.col(value), F.lit(0.0)),
            "overrun": F.greatest(F.col(value) - F.col("baseline"), F.lit(0.0)),
        }
    )


def strategy_totals(per_project: DataFrame, value: str) -> DataFrame:
    """Total, median, mean and saved amount per strategy (one input row per project)."""
    return per_project.groupBy("strategy").agg(
        F.sum(value).alias("total"),
        F.percentile(value, F.lit(0.5)).alias("median_total"),
        F.avg(value).alias("mean_total"),
        F.sum("baseline").alias("baseline"),
        F.sum(F.col("baseline") - F.col(value)).alias("saved"),
        F.count("*").alias("projects"),
    )


def mean_by_model(metrics: DataFrame) -> DataFrame:
    """Mean per model and metric, with the number of distinct projects of the model."""
    means = metrics.groupBy("model", "metric").agg(
        (F.sum("value").cast("double") / F.count("value")).alias("mean_value")
    )
    projects = metrics.select("model", "project").distinct().groupBy("model").agg(F.count("*").alias("project_count"))
    return means.join(projects, "model")


def leave_one_out_sums(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Row count and sum over all other entities, as total minus own."""
    own = df.groupBy(entity).agg(F.count(value).alias("_n"), F.sum(value).alias("_v"))
    total = own.agg(F.sum("_n").alias("_tn"), F.sum("_v").alias("_tv"))
    both = own.crossJoin(F.broadcast(total))  # total: one row
    return both.select(entity, (F.col("_tn") - F.col("_n")).alias("others"), (F.col("_tv") - F.col("_v")).alias(f"other_{value}"))
