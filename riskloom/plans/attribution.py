"""Which scheduled work, or the daily base capacity, first reaches each detection target.

Closed form per (strategy, project): with ``days`` since the first event (held at
window + 1 where a window is set), base progress is rate * days and an event reaches
progress + scheduled. A target goes to the first event that reaches it, so everything
follows from prefix scans over events and distinct targets; no event is replayed. The scans run
over ranges of the order, whatever share of the events one project holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import ratio_or_null
from riskloom.operators import joins as jn
from riskloom.operators import scans as sc
from riskloom.session import settle

EPS = 1e-9
KEYS = ["strategy", "project"]
ORDER = ["day", "event_id"]
INF = float("inf")


def _events(schedules: DataFrame, rates: DataFrame, window: int) -> DataFrame:
    rate = F.greatest(F.coalesce("rate", F.lit(0.0)), F.lit(0.0)).cast("double")
    rows = schedules.select(*KEYS, "day", "event_id", F.coalesce("scheduled", F.lit(0)).cast("double").alias("scheduled"))
    rows = rows.join(rates.select("project", rate.alias("rate")), "project", "left").fillna(0.0, ["rate"])
    rows = sc.in_ranges(rows, KEYS, ORDER, "events-in-order")
    day, before = F.col("day"), {"_n": ("sum", F.lit(1)), "_earliest": ("min", F.col("day")), "_prev": ("max", F.col("day"))}
    out = sc.prefix_scan(rows, KEYS, [F.asc(c) for c in ORDER], before, include_current=False)
    out = out.withColumns({"no": (F.coalesce("_n", F.lit(0)) + 1).cast("int"), "_first": F.least("_earliest", day)}).drop("_n", "_earliest")
    days = F.datediff("day", "_first")
    if window > 0:
        days = F.least(days, F.lit(window + 1))
    out = out.withColumn("progress", F.col("rate") * days)
    if window > 0:
        oldest = F.greatest(F.date_add("_first", 1), F.date_sub("_prev", window))
        expired = (F.col("rate") > 0) & F.col("_prev").isNotNull() & (oldest < F.date_sub("day", window))
    else:
        expired = F.lit(False)
    return out.withColumns({"reach": F.col("progress") + F.col("scheduled"), "_expired": expired}).drop("_first", "_prev")


def target_hits(schedules: DataFrame, targets: DataFrame, rates: DataFrame, window: int = 0) -> DataFrame:
    """Per strategy and distinct (project, target): its count, the event that reaches it, and how.

    ``additional`` targets are reached by scheduled work (one per target value and event,
    repeats of the value follow for free), others by the base capacity.
    """
    return _hits(_events(schedules, rates, window), targets)


def _hits(events: DataFrame, targets: DataFrame) -> DataFrame:
    values = targets.groupBy("project", F.col("target").cast("double").alias("target")).agg(F.count("*").alias("n"))
    per_strategy = events.select(*KEYS).distinct().join(values, "project")
    first = jn.first_crossing(events, per_strategy, KEYS, "reach", "no", "target", EPS)
    at_event = events.select(*KEYS, F.col("no").alias("hit_no"), F.col("progress").alias("_progress"))
    hits = per_strategy.join(first, [*KEYS, "target"]).join(at_event, [*KEYS, "hit_no"], "left")
    extra = F.col("_progress").isNotNull() & (F.col("_progress") + EPS < F.col("target"))
    return hits.withColumn("additional", extra.cast("int")).drop("_progress")


def crossing_attribution(schedules: DataFrame, targets: DataFrame, rates: DataFrame, window: int = 0) -> DataFrame:
    """One row per scheduled event: consumed and wasted work, detections and class.

    ``schedules``: strategy, project, day, event_id (order within a day), scheduled.
    ``targets``: project, target. ``rates``: project, rate. ``window``: days, 0 for none.
    """
    # both tables are read several times below, so each is written once
    events = settle(_events(schedules, rates, window), "events")
    hits = settle(_hits(events, targets), "hits")
    per_event = hits.filter("hit_no IS NOT NULL").groupBy(*KEYS, F.col("hit_no").alias("no")).agg(
        F.sum("additional").alias("detections_count"),
        F.sum(F.col("n") - F.col("additional")).alias("baseline_detections_count"),
        F.max(F.when(F.col("additional") == 1, F.col("target"))).alias("_top"),
    )
    has_targets = targets.select("project").distinct().withColumn("_has", F.lit(1))

    by_no = [F.asc("no")]
    marks = sc.prefix_scan(events, KEYS, by_no, {"_reached": ("max", F.col("reach"))}, include_current=False)
    marks = marks.withColumn("_at", F.greatest("_reached", F.col("progress")) + EPS)
    # next open target: the smallest above everything reached so far, so downwards events stand before targets at a tie
    side_a = marks.select(*KEYS, "_at", F.lit(1).alias("_kind"), "no", F.lit(None).cast("double").alias("_t"))
    side_b = hits.select(*KEYS, F.col("target").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("no"), F.col("target").alias("_t"))
    down = [F.desc("_at"), F.desc("_kind")]
    ahead = sc.in_ranges(side_a.unionByName(side_b), KEYS, down, "open-targets")
    ahead = sc.prefix_scan(ahead, KEYS, down, {"threshold": ("min", F.col("_t"))})
    open_target = ahead.filter("_kind = 1").select(*KEYS, "no", "threshold")

    out = events.join(open_target, [*KEYS, "no"]).join(per_event, [*KEYS, "no"], "left").join(has_targets, "project", "left")
    out = out.fillna(0, ["detections_count", "baseline_detections_count"])
    success = F.col("detections_count") > 0
    consumed = F.when(success, F.least(F.col("_top") - F.col("progress"), F.col("scheduled"))).otherwise(0.0)
    label = (
        F.when(F.col("_has").isNull(), "fp")
        .when(F.col("threshold").isNull(), "baseline_only")
        .when(success, "tp")
        .when(F.col("_expired"), "expired")
        .otherwise("fp")
    )
    out = out.withColumns({"consumed": consumed, "success": success.cast("int"), "classification": label})
    found = F.col("detections_count") + F.col("baseline_detections_count")
    out = sc.prefix_scan(out, KEYS, by_no, {"_running": ("sum", found)})
    return out.withColumns(
        {
            "wasted": F.col("scheduled") - F.col("consumed"),
            "threshold": F.coalesce("threshold", F.lit(INF)),
            "expired": (F.col("classification") == "expired").cast("int"),
            "detection_id": F.when(success, F.col("_running")),
        }
    ).select(
        *KEYS, "day", "event_id", "no", "threshold", "scheduled", "consumed", "wasted", "success", "expired", "detection_id", "classification",
        "progress", "reach", "detections_count", "baseline_detections_count",
    )


def attribution_summary(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Trigger counts, detections, consumed and wasted work and their ratios per strategy.

    Events that only meet base capacity leave the trigger counts, but their work stays in
    the wasted amount. Targets count where their project has at least one event.
    """
    kind = F.col("classification")
    per_project = events.groupBy(*KEYS).agg(
        F.count_if(kind != "baseline_only").alias("triggers"),
        F.count_if(kind == "tp").alias("hits"),
        F.count_if(kind == "expired").alias("expired"),
        F.count_if(kind == "baseline_only").alias("baseline_only"),
        F.sum("detections_count").alias("extra"),
        F.sum("baseline_detections_count").alias("base"),
        F.sum("scheduled").alias("scheduled"),
        F.sum("consumed").alias("consumed"),
        F.sum("wasted").alias("wasted"),
        F.count_if(kind != "tp").alias("missed"),
    )
    sizes = targets.groupBy("project").agg(F.count("*").alias("targets"))
    rows = per_project.join(sizes, "project", "left").fillna(0, ["targets"])
    out = rows.groupBy("strategy").agg(
        F.sum("triggers").alias("triggers_total"),
        F.sum("hits").alias("success_triggers"),
        F.sum("expired").alias("expired_triggers"),
        F.sum("baseline_only").alias("baseline_only_triggers"),
        F.sum("extra").alias("detections_additional"),
        F.sum("base").alias("detections_baseline"),
        F.sum("scheduled").alias("units_total"),
        F.sum("consumed").alias("units_success"),
        F.sum("wasted").alias("units_wasted"),
        F.count("*").alias("projects"),
        F.count_if(F.col("hits") > 0).alias("projects_with_success"),
        F.count_if(F.col("missed") > 0).alias("projects_with_waste"),
        F.sum("targets").alias("targets_total"),
    )
    wasted = F.col("triggers_total") - F.col("success_triggers")
    return out.withColumns(
        {
            "wasted_triggers": wasted,
            "detections_completed": F.col("detections_additional") + F.col("detections_baseline"),
            "targets_open": F.col("targets_total") - F.col("detections_additional") - F.col("detections_baseline"),
            "success_ratio": ratio_or_null("success_triggers", "triggers_total"),
            "wasted_ratio": ratio_or_null(wasted, "triggers_total"),
            "expired_ratio": ratio_or_null("expired_triggers", "triggers_total"),
            "units_success_ratio": ratio_or_null("units_success", "units_total"),
            "units_wasted_ratio": ratio_or_null("units_wasted", "units_total"),
        }
    )
