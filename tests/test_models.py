"""Properties of the tree models and of the loops around them."""

import pytest
from pyspark.sql import functions as F

from riskloom.learning import evaluation as ev
from riskloom.learning import sampling as sp

FEATURES = ["a", "b"]
SMALL = {"random_forest": {"numTrees": 5, "maxDepth": 3}, "boosted": {"maxIter": 3, "maxDepth": 2}}


@pytest.fixture(scope="module")
def rows(spark):
    """Three entities whose label follows ``a``; one row in four is positive."""
    data = [(f"g{p}", p * 1000 + i, f"2024-01-{i % 28 + 1:02d}", int(i % 4 == 0), float(10 * (i % 4 == 0) + i % 3), float(i % 7)) for p in range(3) for i in range(56)]
    df = spark.createDataFrame(data, "project string, row_id bigint, day string, label int, a double, b double")
    return df.withColumn("day", F.to_date("day")).cache()


@pytest.mark.parametrize("kind", ["random_forest", "boosted"])
def test_scores_separate_and_repeat(rows, kind):
    run = lambda seed: ev.repeated_scores(rows, ["g0", "g1", "g2"], kind, FEATURES, 1, seed, **SMALL[kind])
    scored = run(3).collect()
    assert len(scored) == rows.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in scored)
    best_clean = max(r["score"] for r in scored if not r["label"])
    assert min(r["score"] for r in scored if r["label"]) > best_clean
    key = lambda r: (r["row_id"], r["score"])
    assert sorted(map(key, scored)) == sorted(map(key, run(3).collect()))


def test_classes_are_equalised_before_the_fit(rows, monkeypatch):
    seen = []
    real = ev.estimator

    def spy(*args, **kwargs):
        model = real(*args, **kwargs)
        fit = model.fit
        monkeypatch.setattr(model, "fit", lambda df: seen.append({r["label"]: r["count"] for r in df.groupBy("label").count().collect()}) or fit(df), raising=False)
        return model

    monkeypatch.setattr(ev, "estimator", spy)
    ev.cross_entity_validation(rows, "g0", "random_forest", FEATURES, 1, **SMALL["random_forest"])
    ev.cross_entity_validation(rows, "g0", "random_forest", FEATURES, 1, resample=None, **SMALL["random_forest"])
    assert seen == [{0: 28, 1: 28}, {0: 84, 1: 28}]


def test_parameter_search_returns_the_best_draw(rows):
    chunked = ev.day_chunks(rows, 4)
    table, best, model = ev.parameter_search(chunked, "random_forest", FEATURES, {"maxDepth": [1, 3], "numTrees": [2]}, 2, seed=1, folds=3)
    found = table.collect()
    assert len(found) == 2 and str(best) == max(found, key=lambda r: (r["pr_auc"], -r["draw"]))["settings"]
    assert all(0 <= r["pr_auc"] <= 1 for r in found) and model is not None


def test_parameter_search_equalises_training_rows_only(rows, monkeypatch):
    sizes, tested, estimator, score_rows = [], [], ev.estimator, ev.score_rows

    class Counted:
        def __init__(self, *args, **params):
            self.own = estimator(*args, **params)

        def fit(self, train):
            sizes.append({r["label"]: r["count"] for r in train.groupBy("label").count().collect()})
            return self.own.fit(train)

    monkeypatch.setattr(ev, "estimator", Counted)
    monkeypatch.setattr(ev, "score_rows", lambda model, test: tested.append(test.count()) or score_rows(model, test))
    chunked = ev.day_chunks(rows.filter("label = 0 OR row_id % 3 > 0"), 4)
    ev.parameter_search(chunked, "random_forest", FEATURES, {"maxDepth": [1]}, 1, seed=1, folds=2, numTrees=1)
    assert len(sizes) == 3 and all(n[0] == n[1] for n in sizes)
    assert tested == [chunked.filter(f"_chunk = {i}").count() for i in (1, 2)]


def test_shipped_forest_grows_as_deep_as_spark_can():
    assert ev.estimator("random_forest", FEATURES, 1).getStages()[-1].getMaxDepth() == 30


def test_importances_name_the_feature_that_matters(spark, rows):
    _, model = ev.cross_entity_validation(rows, "g0", "random_forest", FEATURES, 1, **SMALL["random_forest"])
    values = {r["feature"]: r["importance"] for r in ev.importances(spark, model, FEATURES).collect()}
    assert values["a"] > values["b"] and sum(values.values()) == pytest.approx(1)


def test_walk_forward_trains_on_earlier_days_only(rows):
    scored = ev.time_series_validation(rows, ["g0", "g1", "g2"], "random_forest", FEATURES, 3, seed=1, **SMALL["random_forest"])
    sizes = {(r["project"], r["fold"]): r for r in ev.walk_forward_sizes(rows, 3).collect()}
    tested = {(r["project"], r["fold"]): r["count"] for r in scored.groupBy("project", "fold").count().collect()}
    assert tested == {k: r["n_test"] for k, r in sizes.items() if not r["skipped"]}
    assert all(r["n_train"] == 19 * int(k[1][-1]) for k, r in sizes.items())


def test_one_class_gives_no_model(rows):
    assert ev.cross_entity_validation(rows.filter("label = 0"), "g0", "random_forest", FEATURES, 1) is None


def test_one_busy_day_is_cut_into_chunks(spark):
    """Half of the rows on one day: places still run through, and equal those of one sort."""
    data = [("g", i, "2024-01-02" if i % 2 else f"2024-01-{3 + i % 20:02d}") for i in range(4000)]
    df = spark.createDataFrame(data, "project string, row_id bigint, day string").withColumn("day", F.to_date("day"))
    got = {r["row_id"]: r["_chunk"] for r in ev.day_chunks(df, 5).collect()}
    order = sorted(data, key=lambda r: (r[2], r[1]))
    assert got == {r[1]: i // 800 for i, r in enumerate(order)}


def test_prepare_rows_reads_odd_values(spark):
    df = spark.createDataFrame([(1, "yes", "3"), (2, "0.4", "n/a"), (3, None, None)], "i int, y string, x string")
    assert sorted(tuple(r) for r in sp.prepare_rows(df, "y", ["x"], ["i"]).collect()) == [(1, 1, 3.0), (2, 0, 0.0), (3, 0, 0.0)]


def test_regression_budget_on_several_features(spark):
    """Against a least-squares solve over the training entities."""
    import math

    import numpy as np

    from riskloom.learning import regression as rg
    from riskloom.plans import budgets as bd
    from riskloom.queries import standins as s
    from riskloom.queries.q_l_plans import labelled
    from riskloom.session import settle

    folder, features = "/root/testdata/sf0.001", ["churn", "rate", "day_index"]
    table, found = settle(labelled(spark, folder), "labelled"), s.detections(spark, folder)
    got = bd.regression_budget(table, found, features, evaluation="random_split").collect()
    data = bd.observed_work(table.filter("is_flagged AND fold IS NOT NULL"), found).fillna(0, features)
    train = rg.entity_split(data, "project", 0.2, 42).filter("is_train").select(*features, "observed").collect()
    x = np.array([[1.0, *[float(r[f]) for f in features]] for r in train])
    weights = np.linalg.lstsq(x, np.array([float(r["observed"]) for r in train]), rcond=None)[0]
    assert got
    for r in got:
        raw = float(np.dot([1.0, *[float(r[f]) for f in features]], weights))
        assert r["raw"] == pytest.approx(raw, rel=1e-6, abs=1e-4)
        assert r["scheduled"] == math.ceil(max(r["raw"], 0.0)) and r["was_clipped"] == int(r["raw"] < 0)
