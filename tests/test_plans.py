"""Detection, budgets, attribution, regression and curves on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.learning import curves
from riskloom.learning import regression as rg
from riskloom.operators import aggregates as ag
from riskloom.operators import history as hs
from riskloom.operators import ranking as rk
from riskloom.operators import tables as tb
from riskloom.operators import windows as wn
from riskloom.plans import attribution as at
from riskloom.plans import budgets as bd
from riskloom.plans import detection as dt
from riskloom.plans import timeline as tl


def dated(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.to_date(c) for c in columns})


def test_baseline_median(spark):
    found = spark.createDataFrame([("p", 2), ("p", 4), ("p", -5)], "project string, days int")
    rates = spark.createDataFrame([("p", 1.5)], "project string, rate double")
    r = dt.baseline_metrics(found, rates).first()
    assert (r.baseline_units, r.baseline_days) == (4.5, 3.0)


def test_threshold_falls_back(spark):
    rows = [("a", 5.0, 9.0, 9.0), ("b", 0.0, 3.0, 1.0), ("c", 0.0, 3.0, 0.0), ("d", 0.0, None, 0.0)]
    df = spark.createDataFrame(rows, "project string, baseline_units double, baseline_days double, rate double")
    assert {r.project: r.threshold for r in dt.threshold_map(df).collect()} == {"a": 5.0, "b": 3.0, "c": 3.0, "d": math.inf}


def test_ids_fall_back_to_the_introducing_commit(spark):
    rows = [("p", 1, "m1", "abc", 0), ("p", 1, " ", "def456", 1), ("p", 1, None, "", 2)]
    found = spark.createDataFrame(rows, "project string, days int, issue string, introduced string, n int")
    rates = spark.createDataFrame([("p", 0.0)], "project string, rate double")
    ids = dt.detection_targets(found, rates, ["issue"], "introduced", "n").orderBy("target_id")
    assert sorted(r.target_id for r in ids.collect()) == ["introduced:def456", "m1", "row_2"]


def test_rates_round_half_even_and_timeline_adds_up(spark):
    daily = dated(spark, [("p", "2024-01-01"), ("p", "2024-01-03"), ("q", "2024-01-01")], "project string, day string", "day")
    rates = spark.createDataFrame([("p", 2.2), ("q", 3.9)], "project string, rate double")
    got = tl.build_timeline(daily, rates).orderBy("project", "day").collect()
    assert [(r.rate, r.day_index, r.unit_start, r.cumulative_units) for r in got] == [(2, 1, 1, 2), (2, 2, 3, 4), (4, 1, 1, 4)]


def defined(events, targets, rate, window):
    """What the closed rule says of each event, from all (target, event) pairs.

    Capacity at an event is the rate times the days since the first event, of which at most
    ``window + 1`` count; an event reaches its capacity plus its scheduled work, and a target
    belongs to the first event that reaches it.
    """
    days = [d for d, _ in events]
    held = [rate * min(d - days[0], window + 1 if window else d) for d in days]
    reach = [h + scheduled for h, (_, scheduled) in zip(held, events)]
    owner = {t: next((i for i, r in enumerate(reach) if r + 1e-9 >= t), None) for t in set(targets)}
    by_work = {t: i is not None and held[i] + 1e-9 < t for t, i in owner.items()}  # else by capacity alone
    extra = [sum(by_work[t] for t in owner if owner[t] == i) for i in range(len(events))]
    base = [sum(1 for t in targets if owner[t] == i) - extra[i] for i in range(len(events))]
    out = []
    for i, day in enumerate(days):
        above = max([held[i], *reach[:i]]) + 1e-9
        threshold = min((t for t in targets if t > above), default=math.inf)
        consumed = max((t - held[i] for t in owner if owner[t] == i and by_work[t]), default=0.0)
        lost = any(days[i - 1] - window <= d < day - window for d in range(days[0] + 1, day + 1)) if i and window and rate > 0 else False
        kind = "fp" if not targets else "baseline_only" if threshold == math.inf else "tp" if extra[i] else "expired" if lost else "fp"
        out.append((threshold, consumed, extra[i], base[i], kind, sum(extra[: i + 1]) + sum(base[: i + 1]) if extra[i] else None))
    return out


@pytest.mark.parametrize("window", [0, 1, 4])
def test_attribution_equals_its_definition(spark, window):
    rng = random.Random(window)
    events, targets, rates, want = [], [], [], {}
    for n in range(150):
        p, rate = f"p{n}", rng.choice([0.0, 0.5, 1.0, 3.0])
        days = sorted(rng.choice(range(12)) for _ in range(rng.randint(1, 6)))
        plan = [(d, float(rng.choice([0, 0.5, 1, 2, 5, 9]))) for d in days]
        goals = [float(rng.choice([0, 0.5, 1, 2, 2, 3, 6, 10, 15])) for _ in range(rng.randint(0, 6))]
        events += [("s", p, f"2024-01-{d + 1:02d}", i, a) for i, (d, a) in enumerate(plan)]
        targets += [(p, g) for g in goals]
        rates.append((p, rate))
        want[p] = defined(plan, goals, rate, window)
    got = at.crossing_attribution(
        dated(spark, events, "strategy string, project string, day string, event_id int, scheduled double", "day"),
        spark.createDataFrame(targets, "project string, target double"),
        spark.createDataFrame(rates, "project string, rate double"),
        window,
    ).collect()
    assert len(got) == len(events)
    for r in got:
        threshold, consumed, extra, base, kind, done = want[r.project][r.no - 1]
        found = (r.threshold, r.detections_count, r.baseline_detections_count, r.classification, r.detection_id)
        assert found == (threshold, extra, base, kind, done), (r, want[r.project])
        assert r.consumed == pytest.approx(consumed)
        assert r.wasted == pytest.approx(r.scheduled - consumed)


def test_attribution_of_three_days(spark):
    events = [("s", "p", f"2024-01-0{i + 1}", 0, a) for i, a in enumerate([0.5, 1.5, 1.0])]
    args = (
        dated(spark, events, "strategy string, project string, day string, event_id int, scheduled double", "day"),
        spark.createDataFrame([("p", 2.0)], "project string, target double"),
        spark.createDataFrame([("p", 1.0)], "project string, rate double"),
    )
    rows = at.crossing_attribution(*args)
    assert [r.classification for r in rows.orderBy("no").collect()] == ["fp", "tp", "baseline_only"]
    s = at.attribution_summary(rows, args[1]).first()
    assert (s.triggers_total, s.success_triggers, s.baseline_only_triggers, s.targets_total, s.targets_open) == (2, 1, 1, 1, 0)


def test_leave_one_out_caps(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 0.0), ("c", 4.0)], "project string, total double")
    assert {r.project: r.cap for r in bd.leave_one_out_caps(df).collect()} == {"a": 4.0, "b": 7.0, "c": 10.0}
    alone = spark.createDataFrame([("a", 10.0)], "project string, total double")
    assert bd.leave_one_out_caps(alone).first().cap == 10.0


def test_budget_allocation_by_largest_remainder(spark):
    rows = [("p", 1, 5, 6.0), ("p", 2, 3, 6.0), ("p", 3, 1, 6.0), ("q", 1, 2, None), ("r", 1, 4, 9.0)]
    df = spark.createDataFrame(rows, "project string, n int, requested int, cap double")
    got = {(r.project, r.n): r.allocated for r in wn.allocate_budget(df, "project", "requested", "cap", "n").collect()}
    assert got == {("p", 1): 3, ("p", 2): 2, ("p", 3): 1, ("q", 1): 2, ("r", 1): 4}


def test_error_statistics(spark):
    rows = [("f1", 1.0, 1.5), ("f1", 2.0, 1.5), ("f2", 4.0, 2.0), ("f2", 0.0, 2.0)]
    df = spark.createDataFrame(rows, "fold string, a double, p double")
    got = {r.fold: r for r in df.rollup("fold").agg(*ag.error_statistics("a", "p")).collect()}
    assert (got["f1"].mae, got["f2"].mae, got[None].mae) == (0.5, 2.0, 1.25)
    assert got["f2"].mape == 0.5 and got[None]["count"] == 4


def test_strategy_names_and_aliases():
    assert bd.strategy_names() == sorted(bd.STRATEGIES)
    assert set(bd.ALIASES.values()) == set(bd.STRATEGIES)
    with pytest.raises(KeyError):
        bd.run_strategy("unheard of", None, None, None)


def test_regression_equals_lstsq_and_survives_constant_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=90) * 0.1
    rows = [(f"p{i % 3}", float(a), float(b), 1.0, float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "project string, a double, b double, one double, y double")
    model = rg.leave_one_out_models(df, "project", ["a", "b"], "y").collect()
    for r in model:
        keep = np.array([row[0] != r.project for row in rows])
        want = np.linalg.lstsq(np.column_stack([np.ones(keep.sum()), x[keep]]), y[keep], rcond=None)[0]
        assert np.allclose(r.coefficients, want)
        assert r.training_entities == 2
    got = rg.fit(df, ["a", "one"], "y").first().coefficients
    want = np.linalg.lstsq(np.column_stack([np.ones(90), x[:, 0], np.ones(90)]), y, rcond=None)[0]
    assert np.allclose(got, want)


def test_single_entity_regression_uses_its_own_fit(spark):
    df = spark.createDataFrame([("p", 1.0, 2.0), ("p", 2.0, 4.0)], "project string, x double, y double")
    r = rg.leave_one_out_models(df, "project", ["x"], "y").first()
    assert r.training_entities == 0 and r.coefficients == pytest.approx([0.0, 2.0], abs=1e-9)


def test_ranking_areas(spark):
    rows = [("a", 0.9, 1), ("a", 0.9, 0), ("a", 0.5, 1), ("a", 0.1, 0), ("b", 0.3, 1), ("c", 0.3, 0)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.g: r for r in curves.ranking_areas(df, "s", "y", ["g"]).collect()}
    assert got["a"].auc_roc == pytest.approx(0.625)
    assert got["a"].average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert got["b"].auc_roc is None and got["c"].average_precision is None


def test_sentinel_threshold(spark):
    df = spark.createDataFrame([(0.9, 0), (0.8, 1), (0.7, 1)], "s double, y int")
    curve = curves.precision_recall(df, "s", "y")
    plain = rk.thresholds_for_precision(curve, [0.6, 0.99]).collect()
    assert [(r.precision_target, r.threshold) for r in plain] == [(0.6, 0.7)]
    with_top = rk.thresholds_for_precision(curve, [0.6, 0.99], include_sentinel=True).collect()
    assert {r.threshold for r in with_top} == {1.9} and {r.fn for r in with_top} == {2}


def test_walk_forward_folds(spark):
    daily = dated(spark, [("p", f"2024-01-{d:02d}") for d in range(1, 8)], "project string, day string", "day")
    folds, assigned = wn.walk_forward(daily, "project", 3)
    got = [(r.fold, str(r.train_start), str(r.train_end), r.test_rows) for r in folds.orderBy("fold").collect()]
    assert got == [("fold-1", "2024-01-01", "2024-01-03", 3), ("fold-2", "2024-01-01", "2024-01-06", 1)]
    assert assigned.count() == 4


def test_label_source_order(spark):
    df = spark.createDataFrame([(0.7, "yes", 0)], "predicted_risk_x double, predicted_label_y string, mine int")
    assert tb.resolve_label(df, "predicted_risk_x", "mine", 0.5).source == "mine"
    assert tb.resolve_label(df, "predicted_risk_x", None, 0.5).source == "predicted_label_y"
    bare = df.select("predicted_risk_x")
    choice = tb.resolve_label(bare, "predicted_risk_x", None, 0.5)
    assert (choice.source, choice.threshold) == ("predicted_risk_x>= 0.500", 0.5)
    with pytest.raises(ValueError):
        tb.resolve_label(df.select("predicted_risk_x"), None, None, 0.5)


def test_class_report_without_positives(spark):
    rows = [("none", 0, 1, 0, 3), ("quiet", 0, 0, 0, 4), ("all", 2, 0, 0, 2)]
    df = spark.createDataFrame(rows, "g string, tp int, fp int, fn int, tn int")
    got = {r.g: r for r in df.select("g", *ag.class_report()).collect()}
    assert (got["none"].precision, got["none"].recall, got["none"].f1, got["none"].mcc) == (0.0, None, None, None)
    assert got["quiet"].precision is None
    assert (got["all"].precision, got["all"].accuracy) == (1.0, 1.0)
    assert got["all"].mcc == pytest.approx(1.0)


def test_revision_positions_answer_for_every_probe(spark):
    rows = [("p", f"c{c:03}", f"f{c % 3}" if c % 2 else "hot", f"2020-01-{c // 10 + 1:02}") for c in range(60)]
    changes = spark.createDataFrame(rows, "project string, commit_id string, path string, day string").withColumn("day", F.col("day").cast("date"))
    numbered = {(r["path"], r["commit_id"]): (r["position"], r["previous_commit"]) for r in hs.revision_positions(changes).collect()}
    files = {path: sorted(c for _, c, f, _ in rows if f == path) for _, _, path, _ in rows}
    assert numbered == {(f, c): (i + 1, own[i - 1] if i else None) for f, own in files.items() for i, c in enumerate(own)}
    listed = hs.earlier_revisions(changes, changes, most_rows=10_000).collect()
    below = [(f, c, b) for f, c in numbered for b in files[f] if numbered[f, b][0] < numbered[f, c][0]]
    assert sorted((r["path"], r["probe_commit"], r["commit_id"]) for r in listed) == sorted(below)
    with pytest.raises(ValueError):
        hs.earlier_revisions(changes, changes, most_rows=len(below) - 1)
