"""All strategies at all precision targets in one plan; the threshold is a grouping key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import aggregates as ag
from riskloom.operators import ranking as rk
from riskloom.operators import sets as st
from riskloom.operators import windows as wn
from riskloom.plans import budgets as bd
from riskloom.plans.detection import detection_units
from riskloom.session import settle

STRATEGIES = ("median", "iqr", "churn", "regression")
# What a schedule may carry beside its amount: mean (or sum) over its rows in the summary.
_MEANS = {"median_mean": "median", "sampled_mean": "sampled", "weight_mean": "weight"}
_SUMS = {"predicted_sum": "raw"}


def precision_steps(curve: DataFrame, targets: Sequence[float], include_sentinel: bool = False) -> DataFrame:
    """The threshold of each reached precision target, numbered from 1 at the lowest threshold."""
    reached = rk.thresholds_for_precision(curve, targets, include_sentinel=include_sentinel)
    names = [c for c in reached.columns if c not in ("threshold", "precision_target")]
    order = F.array_sort(F.collect_list(F.struct("threshold", "precision_target", *names)))  # one entry per target
    numbered = reached.agg(order.alias("_steps")).select(F.posexplode("_steps").alias("_i", "_s"))
    return numbered.select((F.col("_i") + 1).alias("step"), "_s.*")


def flagged_by_step(labelled: DataFrame, steps: DataFrame) -> DataFrame:
    """Days whose risk reaches the lowest threshold, with ``band``, the number of steps they reach.

    A day reaches the steps 1 to ``band``, so one row stands for all of them.
    """
    ladder = steps.agg(F.collect_list("threshold").alias("_ladder"))  # one row, one entry per target
    reached = F.size(F.filter("_ladder", lambda t: t <= F.col("risk")))
    return ag.with_constants(labelled, ladder).withColumns({"band": reached, "is_flagged": F.lit(True)}).drop("_ladder").filter("band > 0")


def step_schedules(
    labelled: DataFrame, steps: DataFrame, detections: DataFrame, rates: DataFrame, mode: str = "per_project", strategies: Sequence[str] = STRATEGIES,
    churn: str = "churn", cap: float | None = None, seed: int = 42, features: Sequence[str] = ("churn",), digits: int | None = None,
) -> DataFrame:
    """Schedules of the strategies at every step: strategy, own_step, band, project, day, amounts.

    ``labelled`` has a risk and, for ``per_project`` and the regression, folds; its own flags
    are not read. Median and draw do not depend on the other flagged days, so a row with
    ``own_step`` 0 holds for the steps 1 to ``band``. Past churn and the regression do: their
    days come once per step they reach and are scheduled inside it. Duration statistics
    depend on no threshold and are taken once.
    """
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise KeyError(f"unknown strategies {sorted(unknown)}; known: {', '.join(STRATEGIES)}")
    flagged = flagged_by_step(labelled, steps)
    if {"churn", "regression"} & set(strategies):
        amounts = {c: F.coalesce(c, F.lit(0)).cast("double") for c in {churn, *features}}
        flagged = flagged.withColumns(amounts)
    flagged = settle(flagged, "flagged-steps")
    per_step = flagged.withColumn("own_step", F.explode(F.sequence(F.lit(1), "band")))  # at most one copy per target
    budgets: dict[str, DataFrame] = {}
    if set(strategies) - {"regression"}:
        known = bd.with_duration_statistics(flagged, detection_units(detections, rates), mode).withColumn("own_step", F.lit(0))
        known = settle(known, "step-statistics")
        whole = known.filter("fold IS NOT NULL") if mode == "per_project" else known
        budgets["median"] = bd.scheduled_by_median(whole, mode)
        budgets["iqr"] = bd.scheduled_by_draw(whole, mode, seed)
        if "churn" in strategies:
            past = wn.expanding_median(per_step, ["own_step", "project"], churn, F.lit(True), "past_churn")
            carried = past.select("own_step", "project", "day", "past_churn").join(known.drop("own_step"), ["project", "day"])
            budgets["churn"] = bd.scheduled_by_churn(carried, mode, churn, cap=cap)
    if "regression" in strategies:
        budgets["regression"] = bd.regression_budget(per_step, detections, features, digits=digits, within=["own_step"])
    carry = [*_MEANS.values(), *_SUMS.values()]
    parts = []
    for name in strategies:
        df = budgets[name]
        extra = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in carry]
        held = F.when(F.col("own_step") > 0, F.col("own_step")).otherwise(F.col("band")).alias("band")
        parts.append(df.select(F.lit(name).alias("strategy"), "own_step", held, "project", "day", "scheduled", *extra))
    return st.union_all(parts)


def summarise_steps(schedules: DataFrame, steps: DataFrame, strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """One row per precision target and strategy: rows, distinct projects and days, amounts, means.

    Rows are added up per band and bands are then added up downwards. A project or day
    counts at a step if its highest band reaches it, so distinct counts are sums as well. A
    strategy without a row at a step has zeros and null means.
    """
    schedules = settle(schedules, "step-schedules")
    keys = ["strategy", "own_step"]
    values = {**_MEANS, **_SUMS}
    sums = [F.sum("scheduled").alias("scheduled"), *[F.sum(c).alias(f"_s_{n}") for n, c in values.items()], *[F.count(c).alias(f"_n_{n}") for n, c in values.items()]]
    amounts = schedules.groupBy(*keys, "band").agg(F.count("*").alias("rows"), *sums)
    parts = [amounts]
    for column in ("project", "day"):
        highest = schedules.groupBy(*keys, column).agg(F.max("band").alias("band"))
        parts.append(highest.groupBy(*keys, "band").agg(F.count("*").alias(f"unique_{column}s")))
    bands = st.union_all(parts)  # a few rows per strategy and step from here on
    first = F.when(F.col("own_step") > 0, F.col("own_step")).otherwise(F.lit(1))
    spread = bands.withColumn("step", F.explode(F.sequence(first, F.col("band"))))
    counted = ["rows", "unique_projects", "unique_days", "scheduled"]
    held = [*counted, *[f"_{k}_{n}" for n in values for k in "sn"]]
    added = spread.groupBy("strategy", "step").agg(*[F.sum(c).alias(c) for c in held])
    named = steps.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    out = named.join(added, ["strategy", "step"], "left").fillna(0, counted)
    means = {n: F.try_divide(F.col(f"_s_{n}"), F.col(f"_n_{n}")) for n in _MEANS}
    return out.withColumns({**means, **{n: F.col(f"_s_{n}") for n in _SUMS}}).select(*steps.columns, "strategy", *counted, *values)


def threshold_sweep(
    curve: DataFrame, targets: Sequence[float], labelled: DataFrame, detections: DataFrame, rates: DataFrame, include_sentinel: bool = False,
    strategies: Sequence[str] = STRATEGIES, **options,
) -> DataFrame:
    """Strategy summaries at the threshold that reaches each precision target.

    Targets that no point of the curve reaches have no rows. Nothing comes back to the driver.
    """
    steps = settle(precision_steps(curve, targets, include_sentinel), "precision-steps")
    schedules = step_schedules(labelled, steps, detections, rates, strategies=strategies, **options)
    return summarise_steps(schedules, steps, strategies)
