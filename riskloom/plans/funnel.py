"""Counts after each filter stage of a data set, and per-project day and report totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_counts(df: DataFrame, min_per_repo: int) -> DataFrame:
    """One row of counts after each stage.

    ``df`` has ``repo`` and the flags ``known``, ``cloned``, ``eligible``. All stages come
    from one group-by on the repo followed by sums over repos.
    """
    stage2 = F.col("known") & F.col("cloned")
    repos = df.groupBy("repo").agg(
        F.count("*").alias("n0"), F.count_if("known").alias("n1"), F.count_if(stage2).alias("n2"), F.count_if(stage2 & F.col("eligible")).alias("n4")
    )
    enough = F.col("n2") >= min_per_repo
    return repos.agg(
        F.sum("n0").alias("total_issues"),
        F.sum("n1").alias("known_issues"),
        F.count_if(F.col("n1") > 0).alias("known_repos"),
        F.sum("n2").alias("cloned_issues"),
        F.count_if(F.col("n2") > 0).alias("cloned_repos"),
        F.sum(F.when(enough, F.col("n2")).otherwise(0)).alias("enough_issues"),
        F.count_if(enough).alias("enough_repos"),
        F.sum(F.when(enough, F.col("n4")).otherwise(0)).alias("final_issues"),
        F.coalesce(F.try_divide(F.sum("n1") * 100.0, F.sum("n0")), F.lit(0.0)).alias("known_percent"),
    )


def day_flag_totals(df: DataFrame) -> DataFrame:
    """Days with and without a flag per project and for ``all``; a day counts once."""
    days = df.groupBy("project", "day").agg(F.max("flag").alias("hit"))
    out = days.rollup("project").agg(F.count("*").alias("total_days"), F.sum("hit").cast("bigint").alias("days_with"))
    return out.select(
        F.coalesce("project", F.lit("all")).alias("project"), "total_days", "days_with", (F.col("total_days") - F.col("days_with")).alias("days_without")
    )


def distinct_targets(df: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Distinct ids per project and over all projects."""
    kept = df if allowed is None else df.join(allowed.select("project").distinct(), "project", "left_semi")
    pairs = kept.select("project", "id").distinct()
    per_project = pairs.groupBy("project").agg(F.count("*").alias("ids"))
    overall = pairs.select("id").distinct().agg(F.count("*").alias("ids")).select(F.lit("all").alias("project"), "ids")
    return per_project.unionByName(overall)


def report_totals(df: DataFrame) -> DataFrame:
    """Distinct report days with the first and last one, per project and for ``all``."""
    days = df.select("project", "day").distinct()
    out = days.rollup("project").agg(F.count("*").alias("reports"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return out.withColumn("project", F.coalesce("project", F.lit("all")))
