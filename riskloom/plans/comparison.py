"""Comparing strategies, thresholds and models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import clean
from riskloom.functions import numeric as nm
from riskloom.operators import aggregates as ag
from riskloom.operators import ranking as rk
from riskloom.operators import sets as st
from riskloom.plans import summaries
from riskloom.plans.funnel import stage_counts


def union_schedules(schedules: Mapping[str, DataFrame]) -> DataFrame:
    """One table of project, day and scheduled amount with the strategy's name."""
    return st.union_all([df.select(F.lit(name).alias("strategy"), "project", "day", "scheduled") for name, df in schedules.items()])


def compare_strategies(schedules: DataFrame, baseline: DataFrame) -> dict[str, DataFrame]:
    """Summary, per-project, overall and daily tables of schedules that carry a strategy.

    ``baseline``: project, rate, baseline_days, baseline_units. Days still needed shrink by
    the scheduled amount over the rate where there is a rate.
    """
    summary = ag.schedule_summary(schedules, "scheduled", keys=["strategy"])
    per = ag.schedule_summary(schedules, "scheduled", keys=["strategy", "project"])
    known = baseline.select("project", "rate", "baseline_days", "baseline_units")
    projects = per.join(known, "project", "left").fillna(0.0, ["rate", "baseline_days", "baseline_units"])
    cut = F.greatest(F.col("baseline_days") - F.col("scheduled") / F.nullif("rate", F.lit(0.0)), F.lit(0.0))
    projects = projects.withColumns(
        {
            "per_trigger": nm.ratio_or_null("scheduled", "rows"),
            "estimated_days": F.when(F.col("rate") > 0, cut).otherwise(F.col("baseline_days")),
            "estimated_units": F.greatest(F.col("baseline_units") - F.col("scheduled"), F.lit(0.0)),
        }
    )
    # one row per strategy and project from here on
    overall = projects.groupBy("strategy").agg(
        F.count("*").alias("projects"),
        F.sum("scheduled").alias("total_scheduled"),
        F.percentile("scheduled", F.lit(0.5)).alias("median_scheduled"),
        F.avg("scheduled").alias("mean_scheduled"),
        F.percentile("estimated_days", F.lit(0.5)).alias("median_days"),
        F.avg("estimated_days").alias("mean_days"),
        F.percentile("estimated_units", F.lit(0.5)).alias("median_units"),
        F.avg("estimated_units").alias("mean_units"),
        F.sum(F.col("baseline_units") - F.col("estimated_units")).alias("units_saved"),
    )
    daily = schedules.groupBy("strategy", "project", "day").agg(F.sum("scheduled").alias("scheduled")).orderBy("strategy", "project", "day")
    return {"summary": summary, "projects": projects, "overall": overall, "daily": daily}


def low_precision_rows(sweep: DataFrame, target: float) -> DataFrame:
    """Rows of one precision target with the share of false alarms."""
    return sweep.filter(F.col("precision_target") == target).withColumn("false_positive_rate", 1.0 - F.col("precision"))


# Strategies in report order with their labels.
REPORT_LABELS = {"median": "S1", "iqr": "S2", "churn": "S3", "regression_simple": "S4", "regression_multi": "S5"}


def combine_results(simple: DataFrame, multi: DataFrame) -> DataFrame:
    """All strategies of the simple run and the regression of the multi run, under own names."""
    renamed = simple.withColumn("strategy", F.when(F.col("strategy") == "regression", "regression_simple").otherwise(F.col("strategy")))
    return st.merge_relabelled(renamed, multi, F.col("strategy") == "regression", {}, {"regression": "regression_multi"}, "strategy")


def result_table(summary: DataFrame) -> DataFrame:
    """Cost, hits, hit rate and cost per hit in report order, and the saving against the first row.

    ``summary``: strategy, units_total, detections_additional, success_ratio, targets_total.
    """
    labels = F.create_map(*[F.lit(x) for pair in REPORT_LABELS.items() for x in pair])
    rows = summary.filter(F.col("strategy").isin(list(REPORT_LABELS))).select(
        F.try_element_at(labels, F.col("strategy")).alias("label"),
        F.col("units_total").cast("double").alias("cost"),
        F.col("detections_additional").alias("found"),
        F.concat_ws(" / ", "detections_additional", "targets_total").alias("found_of"),
        F.round(nm.as_percentage(F.coalesce("success_ratio", F.lit(0.0))), 2).alias("hit_rate"),
    )
    rows = rows.withColumn("cost_per_hit", F.round(F.coalesce(nm.ratio_or_null("cost", "found"), F.lit(0.0)), 2))
    base = rows.agg(F.min_by("cost", "label").alias("_base"))
    out = ag.with_constants(rows, base).withColumn("reduction", F.round(100.0 * nm.ratio_or_null(F.col("_base") - F.col("cost"), "_base"), 2))
    return rk.order_by_list(out.drop("_base"), "label", list(REPORT_LABELS.values()))


def compare_models(
    metrics: DataFrame, importances: DataFrame, daily: DataFrame, names: Sequence[str], top_n: int = 10, top_features: int = 10
) -> dict[str, DataFrame]:
    """Tables that compare models on the projects all of them cover.

    ``metrics``: model, experiment, project and one column per metric. ``importances``:
    model, project, feature, importance. ``daily``: project, flagged.
    """
    shared = st.common_entities(metrics, "project", ["model", "experiment"])
    common = metrics.join(shared, "project", "left_semi")
    long = ag.wide_to_long(common, ["model", "experiment", "project"], names)
    means = summaries.mean_by_model(long)
    best = rk.top_per_group(long.filter(F.col("metric") == names[0]), ["model"], [F.desc("value"), F.col("project")], top_n, "rank")
    medians = importances.groupBy("feature").agg(F.percentile("importance", F.lit(0.5)).alias("median"))
    strongest = medians.orderBy(F.desc("median"), "feature").limit(top_features)
    positive = daily.groupBy("project").agg(F.count_if(F.col("flagged") == 1).alias("positive_days"))
    busiest = positive.orderBy(F.desc("positive_days"), "project").limit(top_n)
    return {
        "long": long,
        "means": means,
        "best": best,
        "best_means": best.groupBy("model").agg(F.avg("value").alias("top_mean")),
        "features": importances.join(F.broadcast(strongest), "feature"),  # top_features rows
        "busiest": common.join(F.broadcast(busiest), "project"),  # top_n rows
    }


def dataset_funnel(
    metadata: DataFrame, advisories: DataFrame, cloned: DataFrame, coverage: DataFrame, languages: Sequence[str], min_per_repo: int,
    start: Column | None = None, end: Column | None = None,
) -> DataFrame:
    """Advisories and repositories left after each filter stage.

    Stages: project written in one of the languages, project cloned, enough advisories per
    repository, published on or after the project's first coverage day.
    """
    known = metadata.filter(F.lower(F.trim("language")).isin(list(languages))).select("project", F.col("main_repo").alias("_repo"))
    first = coverage.filter(clean.within_open_ended("day", start, end)).groupBy("project").agg(F.min("day").alias("_first"))
    rows = advisories.join(known, "project", "left").join(first, "project", "left")
    rows = rows.join(cloned.select("project").distinct().withColumn("_cloned", F.lit(True)), "project", "left")
    flags = rows.select(
        F.col("_repo").alias("repo"),
        F.col("_repo").isNotNull().alias("known"),
        F.coalesce("_cloned", F.lit(False)).alias("cloned"),
        F.coalesce(F.col("published") >= F.col("_first"), F.lit(False)).alias("eligible"),
    )
    return stage_counts(flags, min_per_repo)
