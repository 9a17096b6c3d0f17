"""Trees against plain recursion, and joint fits against one another."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.learning import ensembles as en
from riskloom.learning import trees

SMALL = {"trees": 40}


def plain_tree(x, g, h, depth, l1=0.0, l2=0.0, least=-1e-9, min_leaf=1.0, stop_pure=True):
    """One tree by recursion over sorted values; a function from a row to its leaf value."""
    cut_off = lambda v: math.copysign(max(abs(v) - l1, 0.0), v)
    score = lambda a, b: cut_off(a) ** 2 / (b + l2)
    total_g, total_h = float(g.sum()), float(h.sum())
    value = -cut_off(total_g) / (total_h + l2)
    best = None
    if depth > 0 and total_h >= 2 * (not l2) and not (stop_pure and (total_g == 0 or total_g == -total_h)):
        for f in range(x.shape[1]):
            for c in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= c
                if h[left].sum() < min_leaf or h[~left].sum() < min_leaf:
                    continue
                gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(total_g, total_h)
                if gain >= least and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, c
    if best is None:
        return lambda r: value
    _, f, c = best
    left = x[:, f] <= c
    a, b = (plain_tree(x[s], g[s], h[s], depth - 1, l1, l2, least, min_leaf, stop_pure) for s in (left, ~left))
    return lambda r: a(r) if r[f] <= c else b(r)


def data(n=150, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    return x, (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) * 0.7 > 0).astype(float)


@pytest.mark.parametrize(("depth", "min_leaf"), [(1, 1), (3, 1), (30, 1), (30, 7)])
def test_a_tree_without_chance_is_the_plain_one(depth, min_leaf):
    x, y = data()
    bins = trees.to_bins(x, trees.bin_cuts(x, 200))
    block = trees.grow_forest(bins, y, 1, trees.Shape(max_depth=depth, min_leaf=min_leaf), (1,), bootstrap=False)
    plain = plain_tree(x, -y, np.ones(len(y)), depth, min_leaf=min_leaf)
    assert block.leaves(bins)[0] == pytest.approx([plain(r) for r in x])


def test_boosting_is_the_plain_one():
    x, y = data()
    bins = trees.to_bins(x, trees.bin_cuts(x, 200))
    shape = trees.Shape(max_depth=4, min_split=0, min_leaf=1, l1=1, l2=2, least_gain=1.0)
    rounds = trees.grow_boosted(bins, y, 12, 0.3, shape, (1,))
    margin = np.zeros(len(y))
    for tree in rounds:
        p = 1 / (1 + np.exp(-margin))
        plain = plain_tree(x, p - y, p * (1 - p), 4, 1, 2, 1.0, 1.0, stop_pure=False)
        step = tree.leaves(bins)[0]
        assert step == pytest.approx([0.3 * plain(r) for r in x], abs=1e-9)
        margin += step
    loss = lambda m: -np.mean(y * np.log(1 / (1 + np.exp(-m))) + (1 - y) * np.log(1 - 1 / (1 + np.exp(-m))))
    assert loss(margin) < loss(np.zeros(len(y))) * 0.7


def test_gradients_agree_with_finite_differences():
    y, m, e = np.array([0.0, 1.0, 1.0]), np.array([0.3, -1.2, 2.0]), 1e-5
    loss = lambda v: np.log1p(np.exp(v)) - y * v
    p = 1 / (1 + np.exp(-m))
    assert (p - y) == pytest.approx((loss(m + e) - loss(m - e)) / (2 * e), abs=1e-8)
    assert p * (1 - p) == pytest.approx((loss(m + e) - 2 * loss(m) + loss(m - e)) / e**2, abs=1e-4)


def test_trees_of_a_block_do_not_touch_each_other():
    """Grown together or alone, trees without draws are the same; with draws they differ."""
    x, y = data()
    bins = trees.to_bins(x, trees.bin_cuts(x))
    plain = trees.grow_forest(bins, y, 5, trees.Shape(), (1,), bootstrap=False).leaves(bins)
    assert (plain == plain[0]).all()
    drawn = trees.grow_forest(bins, y, 5, trees.Shape(candidates=1), (1,)).leaves(bins)
    assert len(np.unique(drawn, axis=0)) == 5


def test_many_values_and_one_value():
    x = np.column_stack([np.arange(1000.0), np.zeros(1000)])
    cuts = trees.bin_cuts(x)
    bins = trees.to_bins(x, cuts)
    assert bins.max() <= 63 and len(cuts[1]) == 0 and (np.bincount(bins[:, 0]) > 10).all()
    only = trees.grow_forest(bins[:, 1:], np.arange(1000) % 2, 2, trees.Shape(), (1,))
    assert len(only.feature) == 2  # nothing to split: both trees are leaves


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = [(f"g{p}", p * 1000 + i, i % 10, int(i % 4 == 0), float(10 * (i % 4 == 0) + rng.random() * 12), rng.choice([None, 1.0, 2.0])) for p in range(3) for i in range(120)]
    return spark.createDataFrame(made, "project string, row_id long, _chunk int, label int, a double, b double").cache()


def table(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("kind", "params"), [("random_forest", SMALL), ("boosted", {"rounds": 30})])
def test_scores_do_not_depend_on_how_work_is_dealt(rows, monkeypatch, kind, params):
    run = lambda df=rows: table(en.across_entities(df, ["g0", "g1", "g2"], kind, {"all": ["a", "b"], "a": ["a"]}, 2, 5, **params))
    first = run()
    assert len(first) == 2 * 2 * 360 and all(0 <= r[-2] <= 1 for r in first)
    monkeypatch.setattr(en, "PART_UNITS", 1)
    again = run(rows.repartition(7))
    assert [r[:4] for r in again] == [r[:4] for r in first] and [r[4] for r in again] == pytest.approx([r[4] for r in first])
    by = {(e, i): [r for r in first if r[2:4] == (e, i)] for e in ("all", "a") for i in (0, 1)}
    assert all(len(v) == 360 for v in by.values()) and by["all", 0] != by["all", 1]
    for v in by.values():  # columns: project, row_id, experiment, repetition, score, label
        assert np.mean([r[4] for r in v if r[5]]) > np.mean([r[4] for r in v if not r[5]]) + 0.2


def test_a_target_never_trains_its_own_model(rows):
    """The left-out entity's labels are turned round; its scores stay as they were."""
    turned = rows.withColumn("label", F.when(F.col("project") == "g1", 1 - F.col("label")).otherwise(F.col("label")))
    run = lambda df: [r[:-1] for r in table(en.across_entities(df, ["g1"], "random_forest", {"all": ["a"]}, 1, 5, **SMALL))]
    assert run(rows) == run(turned)


def test_training_rows_are_the_only_bound(rows):
    train = en.others(en.vectors(rows, ["a"]), ["g0"])
    sizes = {(r["set"], r["label"]): r["count"] for r in en.training_rows(train, 25).groupBy("set", "label").count().collect()}
    assert sizes == {("g0", 0): 25, ("g0", 1): 25}
    assert en.across_entities(rows, ["g0"], "random_forest", {"all": ["a"]}, 1, 1, most=25, **SMALL).count() == 120


def test_one_class_gives_no_rows(rows):
    assert en.across_entities(rows.filter("label = 0 OR project = 'g0'"), ["g0", "g1"], "random_forest", {"all": ["a"]}, 1, 1, **SMALL).select("project").distinct().collect()[0][0] == "g1"
    assert en.importances([en.Fit("m", "g0", "random_forest", 1, SMALL)], en.others(en.vectors(rows.filter("label = 0"), ["a"]), ["g0"])).count() == 0


def test_importances(rows):
    fits = [en.Fit(str(i), "g0", "random_forest", i, SMALL) for i in range(2)]
    got = {(r["fit"], r["feature"]): r["importance"] for r in en.importances(fits, en.others(en.vectors(rows, ["a", "b"]), ["g0"])).collect()}
    for fit in "01":
        assert got[fit, 0] + got[fit, 1] == pytest.approx(1) and got[fit, 0] > got[fit, 1]


def test_walk_forward_reads_earlier_chunks_only(rows):
    run = lambda df, **o: {(r["project"], r["row_id"]): (r["fold"], r["score"]) for r in en.inside_entities(df, "random_forest", ["a"], 10, 1, entities=["g0", "g1"], **SMALL, **o).collect()}
    got = run(rows)
    assert len(got) == 2 * 108 and all(f == f"fold-{k[1] % 1000 % 10}" for k, (f, _) in got.items())
    late = rows.withColumn("label", F.when(F.col("_chunk") >= 5, 1 - F.col("label")).otherwise(F.col("label")))
    turned = run(late)
    assert all(turned[k] == v for k, v in got.items() if int(v[0][-1]) <= 5) and any(turned[k] != v for k, v in got.items())
    early = rows.withColumn("label", F.when(F.col("_chunk") < 4, 1 - F.col("label")).otherwise(F.col("label")))
    assert all(run(early, recent=True)[k] == v for k, v in run(rows, recent=True).items() if int(v[0][-1]) > 5)


def test_search_marks_every_draw_and_refits_the_best(rows):
    chunked = rows.withColumn("_chunk", F.col("_chunk") % 4)
    found, refit = en.search(chunked, "random_forest", ["a", "b"], 4, seed=3, space={"max_depth": [1, None], "trees": [5, 20], "candidates": ["log2", 1.0, 0.5]})
    marks = found.collect()
    assert [r["draw"] for r in sorted(marks)] == [0, 1, 2, 3] and all(0 < r["pr_auc"] <= 1 for r in marks)
    assert refit(rows).count() == 360
    with pytest.raises(ValueError):
        en.score([en.Fit("x", "all", "linear", 1)], rows, rows)


def test_shipped_sizes_are_the_defaults():
    forest, boosted = en.Fit("f", "s", "random_forest", 1), en.Fit("b", "s", "boosted", 1)
    assert sum(forest.units()) == 1500 and forest.settings().get("max_depth") is None
    assert boosted.units() == [1000] and (boosted.settings()["l1"], boosted.settings()["l2"], boosted.settings()["columns"]) == (1.0, 2.0, 0.8)
