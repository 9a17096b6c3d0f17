"""Detection tables: durations in work units, their statistics, baselines and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import numeric as nm
from riskloom.functions import text as tx
from riskloom.operators import aggregates as ag
from riskloom.operators import scans

QUARTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}


def detection_units(detections: DataFrame, rates: DataFrame) -> DataFrame:
    """Detections with ``units``: days times the project's rate, plain days without a positive rate."""
    joined = detections.join(rates, "project", "left")
    return joined.withColumn("units", nm.scaled_duration("days", "rate")).filter("units IS NOT NULL")


def level_statistics(units: DataFrame, exact_any_domain: bool = False) -> DataFrame:
    """Quartiles of ``units`` per project, over everything, and over all other projects.

    Durations are whole days times a rate, so a project has few distinct values and the
    built-in exact ``percentile`` stays small; pass ``exact_any_domain`` otherwise.
    """
    if exact_any_domain:
        per = scans.exact_quantiles(units, ["project"], "units", QUARTILES)
        overall = scans.exact_quantiles(units, [], "units", QUARTILES).withColumn("project", F.lit(None).cast("string"))
        both = per.withColumn("level", F.lit("project")).unionByName(overall.withColumn("level", F.lit("global")))
    else:
        both = units.rollup("project").agg(*ag.quartiles("units")).withColumn(
            "level", F.when(F.col("project").isNull(), "global").otherwise("project")
        )
    others = scans.leave_one_out_quantiles(units, "project", "units", QUARTILES).withColumn("level", F.lit("others"))
    columns = ["level", "project", "median", "q1", "q3", "count"]
    return both.select(*columns).unionByName(others.select(*columns))


def baseline_metrics(detections: DataFrame, rates: DataFrame) -> DataFrame:
    """Median days and median work units per project; a missing rate leaves the units null, then 0."""
    clean = detections.filter(F.col("days") >= 0).join(rates, "project", "left")
    out = clean.groupBy("project").agg(
        F.percentile(F.col("days").cast("double") * F.col("rate"), F.lit(0.5)).alias("baseline_units"),
        F.percentile(F.col("days").cast("double"), F.lit(0.5)).alias("baseline_days"),
        F.max("rate").alias("rate"),
    )
    return out.fillna(0.0, ["baseline_units", "rate"])


def detection_targets(detections: DataFrame, rates: DataFrame, ids: Sequence[str | Column], introduced: str, row_no: str) -> DataFrame:
    """One target per detection: a stable id and the amount of work that reaches it."""
    joined = detection_units(detections, rates)
    return joined.select(
        "project", tx.stable_id(ids, introduced, row_no).alias("target_id"), F.col("days").cast("double").alias("days"), "rate", F.col("units").alias("target")
    )


def threshold_map(baseline: DataFrame) -> DataFrame:
    """Work needed per project: baseline units, else days times rate, else days, else infinity."""
    return baseline.select(
        "project",
        nm.first_positive(["baseline_units", F.col("baseline_days") * F.col("rate"), "baseline_days"]).alias("threshold"),
    )
