"""Work budgets for flagged days: by median, by draw, by churn and by regression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import numeric as nm
from riskloom.learning import regression as rg
from riskloom.operators import aggregates as ag
from riskloom.operators import joins as jn
from riskloom.operators import scans
from riskloom.operators import windows as wn
from riskloom.plans.detection import QUARTILES, detection_units
from riskloom.session import settle

STATS = ["median", "q1", "q3", "count"]
MODES = ("per_project", "cross_project")


def _named(df: DataFrame, level: str, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{level}_{c}") for c in STATS])


def with_duration_statistics(days: DataFrame, units: DataFrame, mode: str) -> DataFrame:
    """Add the duration statistics that apply to each flagged day and where they come from.

    ``per_project`` takes the day's training window, else the project, else everything;
    ``cross_project`` takes all other projects, else everything. Levels without a sample
    are passed over. Median and quartiles are held at 0 from below.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    # Detections shrink to counts per project, day and duration before any level reads
    # them; the table is written once.
    units = settle(units.groupBy("project", "commit_day", "units").agg(F.count("*").alias("n")), "units")
    overall = units.agg(*ag.quartiles("units", weight="n"))
    out = days
    if mode == "per_project":
        windows = days.filter("fold IS NOT NULL").select("project", "fold", "train_start", "train_end").distinct()
        inside = jn.interval_join(units, windows, "project", "commit_day", "train_start", "train_end")
        per_fold = inside.groupBy("project", "fold").agg(*ag.quartiles("units", weight="n"))
        per_project = units.groupBy("project").agg(*ag.quartiles("units", weight="n"))
        out = out.join(_named(per_fold, "fold", "project", "fold"), ["project", "fold"], "left")
        out = out.join(_named(per_project, "project", "project"), "project", "left")
        levels = ["fold", "project", "global"]
    else:
        others = scans.leave_one_out_quantiles(units, "project", "units", QUARTILES, weight="n")
        known = _named(others, "others", "project")
        out = out.join(known, "project", "left")
        # a project without detections of its own is left out of nothing
        out = ag.with_constants(out, _named(overall, "rest"))
        for c in STATS:
            out = out.withColumn(f"others_{c}", F.coalesce(f"others_{c}", f"rest_{c}")).drop(f"rest_{c}")
        levels = ["others", "global"]
    out = ag.with_constants(out, _named(overall, "global"))
    source = F.lit(None).cast("string")
    for level in reversed(levels):
        source = F.when(F.col(f"{level}_median").isNotNull(), level).otherwise(source)
    out = out.withColumn("stat_source", source)
    for c in STATS:
        pick = F.coalesce(*[F.when(F.col("stat_source") == level, F.col(f"{level}_{c}")) for level in levels])
        out = out.withColumn(c, pick if c == "count" else F.greatest(pick, F.lit(0.0)))
    return out.withColumn("q3", F.greatest("q1", "q3")).drop(*[f"{level}_{c}" for level in levels for c in STATS]).filter(
        "stat_source IS NOT NULL"
    )


def _flagged(labelled: DataFrame, mode: str, need_fold: bool = True) -> DataFrame:
    days = labelled.filter("is_flagged")
    if mode == "per_project" and need_fold:
        return days.filter("fold IS NOT NULL")
    return days


def scheduled_by_median(days: DataFrame, mode: str) -> DataFrame:
    """ceil(median) for days that carry their duration statistics."""
    out = days.withColumn("scheduled", F.ceil("median").cast("bigint"))
    return out.filter("rate > 0 AND scheduled > 0").withColumns({"strategy": F.lit("median"), "strategy_mode": F.lit(mode)})


def scheduled_by_draw(days: DataFrame, mode: str, seed: int = 42) -> DataFrame:
    """A draw between the quartiles for days that carry their duration statistics."""
    fold = F.col("fold") if mode == "per_project" else F.lit(None)
    draw = F.col("q1") + nm.keyed_uniform(seed, "project", fold, "day_index") * (F.col("q3") - F.col("q1"))
    out = days.withColumn("sampled", draw).withColumn("scheduled", F.ceil("sampled").cast("bigint"))
    return out.filter("scheduled > 0").withColumns({"strategy": F.lit("iqr"), "strategy_mode": F.lit(mode)})


def scheduled_by_churn(days: DataFrame, mode: str, churn: str = "churn", scaling: float = 1.0, cap: float | None = None, rounding: str = "ceil") -> DataFrame:
    """Median times the churn weight for days that carry their statistics and ``past_churn``."""
    base = F.lit(max(scaling, 0.0)) * F.col("median")
    weight = nm.churn_weight(churn, "past_churn", cap)
    out = days.withColumns({"budget_base": base, "weight": weight}).withColumn("expected", F.col("budget_base") * F.col("weight"))
    out = out.withColumns(
        {
            "scheduled": nm.rounded("expected", rounding),
            "no_past_churn": F.coalesce(F.col("past_churn") <= 0, F.lit(True)),
            "budget_target": F.bround("budget_base", 0).cast("bigint"),
        }
    )
    return out.filter("budget_base > 0 AND scheduled > 0").withColumns({"strategy": F.lit("churn"), "strategy_mode": F.lit(mode)})


def median_budget(labelled: DataFrame, detections: DataFrame, rates: DataFrame, mode: str = "per_project") -> DataFrame:
    """ceil(median) for each flagged day of a project with a positive rate."""
    return scheduled_by_median(with_duration_statistics(_flagged(labelled, mode), detection_units(detections, rates), mode), mode)


def iqr_budget(labelled: DataFrame, detections: DataFrame, rates: DataFrame, mode: str = "per_project", seed: int = 42) -> DataFrame:
    """A draw between the quartiles for each flagged day, fixed by project, fold, day and seed."""
    return scheduled_by_draw(with_duration_statistics(_flagged(labelled, mode), detection_units(detections, rates), mode), mode, seed)


def churn_budget(
    labelled: DataFrame,
    detections: DataFrame,
    rates: DataFrame,
    mode: str = "per_project",
    churn: str = "churn",
    scaling: float = 1.0,
    cap: float | None = None,
    rounding: str = "ceil",
) -> DataFrame:
    """Median times the day's churn against the median churn of earlier flagged days."""
    filled = labelled.withColumn(churn, F.coalesce(churn, F.lit(0)).cast("double"))
    past = wn.expanding_median(filled, "project", churn, F.col("is_flagged"), "past_churn")
    days = with_duration_statistics(_flagged(past, mode, need_fold=False), detection_units(detections, rates), mode)
    return scheduled_by_churn(days, mode, churn, scaling, cap, rounding)


def observed_work(timeline: DataFrame, detections: DataFrame) -> DataFrame:
    """Timeline with the work its day's changes took to be found: ceil(sum of days times rate)."""
    per_day = detections.filter("days IS NOT NULL").groupBy("project", F.col("commit_day").alias("day")).agg(F.sum("days").alias("_days"))
    out = timeline.join(per_day, ["project", "day"], "left")
    work = F.coalesce(F.col("_days"), F.lit(0)).cast("double") * F.greatest(F.col("rate"), F.lit(0))
    return out.withColumn("observed", F.greatest(F.ceil(work), F.lit(0)).cast("bigint")).drop("_days")


def regression_budget(
    labelled: DataFrame,
    detections: DataFrame,
    features: Sequence[str],
    evaluation: str = "leave_one_out",
    test_fraction: float = 0.2,
    seed: int = 42,
    digits: int | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Predicted work for flagged days of the folds: least squares, clipped at 0, rounded up.

    ``digits`` rounds the prediction before it is rounded up, so the noise of a fit cannot add
    a unit to a whole number; by default it is taken as it is.

    ``leave_one_out`` fits each project on all others, apart for every value of ``within``;
    ``random_split`` fits on a seeded share of the projects.
    """
    data = observed_work(labelled.filter("is_flagged AND fold IS NOT NULL"), detections)
    data = data.fillna(0, list(features))
    if evaluation == "leave_one_out":
        scored = rg.leave_one_out_predictions(data, "project", features, "observed", "raw", within)
    elif evaluation == "random_split" and not within:
        train = rg.entity_split(data, "project", test_fraction, seed).filter("is_train").drop("is_train")
        scored = rg.predict(data, rg.fit(train, features, "observed"), features, "raw")
    else:
        raise ValueError(f"no evaluation {evaluation!r} within {list(within)}")
    clipped = F.greatest("raw", F.lit(0.0))
    return scored.withColumns(
        {
            "was_clipped": (F.col("raw") < 0).cast("int"),
            "scheduled": F.ceil(clipped if digits is None else F.round(clipped, digits)).cast("bigint"),
            "strategy": F.lit("regression"),
        }
    )


def leave_one_out_caps(totals: DataFrame, entity: str = "project", total: str = "total") -> DataFrame:
    """Mean of the other entities' positive totals; the own total where there is none."""
    positive = F.when(F.col(total) > 0, F.col(total))
    sums = totals.agg(F.sum(positive).alias("_s"), F.count(positive).alias("_n"))
    out = ag.with_constants(totals, sums)
    own, own_n = F.coalesce(positive, F.lit(0)), F.when(F.col(total) > 0, 1).otherwise(0)
    mean = F.try_divide((F.coalesce("_s", F.lit(0)) - own).cast("double"), F.col("_n") - own_n)
    cap = F.greatest(F.coalesce(mean, F.col(total).cast("double"), F.lit(0.0)), F.lit(0.0))
    return out.withColumn("cap", cap).drop("_s", "_n")


# Named strategies; aliases point at the canonical name.
def _regression_by_rates(labelled: DataFrame, detections: DataFrame, rates: DataFrame, features: Sequence[str] = ("churn",), **options) -> DataFrame:
    """``regression_budget`` with the tables of the other strategies; the labelled days carry their rate."""
    return regression_budget(labelled, detections, features, **options)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "churn": churn_budget,
    "iqr": iqr_budget,
    "median": median_budget,
    "regression": _regression_by_rates,
}
ALIASES = {"strategy1": "median", "strategy2": "iqr", "strategy3": "churn", "strategy4": "regression"}


def strategy_names() -> list[str]:
    return sorted(STRATEGIES)


def run_strategy(name: str, labelled: DataFrame, detections: DataFrame, rates: DataFrame, **options) -> DataFrame:
    """Run a strategy by its name or an alias, ignoring case; all take the same three tables."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in STRATEGIES:
        raise KeyError(f"unknown strategy {name!r}; known: {', '.join(strategy_names())}")
    return STRATEGIES[key](labelled, detections, rates, **options)
