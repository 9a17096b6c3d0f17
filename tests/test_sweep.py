"""The one-plan threshold sweep against one run of every strategy per threshold."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom.learning import curves
from riskloom.operators import aggregates as ag
from riskloom.plans import budgets as bd
from riskloom.plans import sweep as sw

DAY = dt.date(2024, 1, 1)
SCHEMA = "project string, day date, day_index int, rate bigint, risk double, is_flagged boolean, fold string, train_start date, train_end date, churn bigint, hit int"


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(5)
    rows = []
    for project, rate in (("a", 2), ("b", 1), ("c", 0), ("d", 3)):
        for i in range(40):
            risk = None if i % 11 == 5 else round(draw.random(), 1)  # many equal scores, some days without one
            fold = f"fold-{i // 10}" if i >= 10 else None
            start, end = (DAY, DAY + dt.timedelta(days=i // 10 * 10 - 1)) if fold else (None, None)
            churn = None if i % 7 == 3 else draw.randrange(0, 50)
            hit = int(risk is not None and draw.random() > risk)
            rows.append((project, DAY + dt.timedelta(days=i), i + 1, rate, risk, True, fold, start, end, churn, hit))
    found = [(p, DAY + dt.timedelta(days=draw.randrange(40)), draw.randrange(0, 30)) for p in "abcc" for _ in range(15)]
    labelled = spark.createDataFrame(rows, SCHEMA)
    detections = spark.createDataFrame(found, "project string, commit_day date, days bigint")
    rates = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", None), ("d", 3.0)], "project string, rate double")
    return labelled, detections, rates


def _one_by_one(labelled, detections, rates, mode, threshold):
    days = labelled.withColumn("is_flagged", F.coalesce(F.col("risk") >= threshold, F.lit(False)))
    units = detections
    made = {
        "median": (bd.median_budget(days, units, rates, mode), "median"),
        "iqr": (bd.iqr_budget(days, units, rates, mode), "sampled"),
        "churn": (bd.churn_budget(days, units, rates, mode, cap=3.0), "weight"),
        "regression": (bd.regression_budget(days, units, ["churn"], digits=6), "raw"),
    }
    out = {}
    for name, (df, value) in made.items():
        r = ag.schedule_summary(df, "scheduled").first()
        out[name] = (r["rows"], r["unique_projects"], r["unique_days"], r["scheduled"], df.agg(F.sum(value)).first()[0])
    return out


@pytest.mark.parametrize("mode", bd.MODES)
def test_sweep_equals_a_run_per_threshold(tables, mode):
    labelled, detections, rates = tables
    curve = curves.precision_recall(labelled.filter("risk IS NOT NULL"), "risk", "hit")
    got = sw.threshold_sweep(curve, [0.1, 0.3, 0.5, 2.0], labelled, detections, rates, mode=mode, cap=3.0, digits=6).collect()
    thresholds = {r["precision_target"]: r["threshold"] for r in got}
    assert set(thresholds) == {0.1, 0.3, 0.5} and len(set(thresholds.values())) > 1
    for target, threshold in thresholds.items():
        want = _one_by_one(labelled, detections, rates, mode, threshold)
        mine = {r["strategy"]: r for r in got if r["precision_target"] == target}
        assert set(mine) == set(want)
        for name, (rows, projects, days, amount, total) in want.items():
            r = mine[name]
            assert (r["rows"], r["unique_projects"], r["unique_days"], r["scheduled"]) == (rows, projects, days, amount), (target, name)
            value = {"median": r["median_mean"], "iqr": r["sampled_mean"], "churn": r["weight_mean"], "regression": r["predicted_sum"]}[name]
            mean = total if name == "regression" else total / rows
            assert value == pytest.approx(mean, rel=1e-9, abs=1e-9)


def test_sweep_without_flagged_days_or_reached_targets(tables):
    labelled, detections, rates = tables
    curve = curves.precision_recall(labelled.filter("risk IS NOT NULL"), "risk", "hit")
    assert sw.threshold_sweep(curve, [2.0], labelled, detections, rates).count() == 0
    # the point above all scores reaches any target and flags nothing: zeros and no means
    top = sw.threshold_sweep(curve, [0.99], labelled, detections, rates, include_sentinel=True).collect()
    assert {r["strategy"] for r in top} == set(sw.STRATEGIES)
    assert all((r["rows"], r["unique_projects"], r["scheduled"], r["median_mean"]) == (0, 0, 0, None) for r in top)
    empty = sw.threshold_sweep(curve, [0.1], labelled.limit(0), detections, rates, strategies=["median", "churn"]).collect()
    assert [r["rows"] for r in empty] == [0, 0]
    with pytest.raises(KeyError):
        sw.threshold_sweep(curve, [0.1], labelled, detections, rates, strategies=["other"])
