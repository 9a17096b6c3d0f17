"""Running totals, quantiles, as-of joins and neighbours against direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.learning import sampling as sp
from riskloom.operators import joins as jn
from riskloom.operators import scans
from riskloom.operators import windows as wn


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows on one key, with repeated and negative values."""
    rng = random.Random(3)
    rows = [("hot" if i % 2 else f"k{i % 7}", i, i // 20, round(rng.gauss(0, 50), rng.choice([0, 1, 3]))) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "k string, i int, c int, v double")


def test_running_totals_with_null_keys(spark):
    rows = [(None if i % 3 == 0 else "a", i, i // 4, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, c int, v int")
    got = {r.i: (r.s, r.b) for r in scans.running_totals(df, ["k"], "c", ["i"], {"s": F.col("v"), "b": F.lit(1)}).collect()}
    assert len(got) == 60
    for k, i, _, _ in rows:
        past = [r for r in rows if r[0] == k and r[1] <= i]
        assert got[i] == (sum(r[3] for r in past), len(past))


def test_running_totals_excluding_current(spark, skewed):
    rows, df = skewed
    got = {r.i: r.n for r in scans.running_totals(df, ["k"], "c", ["i"], {"n": F.lit(1)}, include_current=False).collect()}
    seen: dict = {}
    for k, i, _, _ in rows:
        assert got[i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_exact_quantiles(skewed, accuracy):
    rows, df = skewed
    probs = {"a": 0.0, "q": 0.25, "m": 0.5, "z": 1.0, "p": 0.913}
    for r in scans.exact_quantiles(df, ["k"], "v", probs, accuracy).collect():
        values = [x[3] for x in rows if x[0] == r.k]
        assert r["count"] == len(values)
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(values, p), abs=1e-9)
    one = scans.exact_quantiles(df, [], "v", {"m": 0.5}, accuracy).first()
    assert one.m == pytest.approx(np.median([x[3] for x in rows]))


def test_leave_one_out_quantiles(skewed):
    rows, df = skewed
    probs = {"q1": 0.25, "m": 0.5, "q3": 0.75, "z": 1.0}
    got = scans.leave_one_out_quantiles(df, "k", "v", probs, buckets=8).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        others = [x[3] for x in rows if x[0] != r.k]
        assert r["count"] == len(others)
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(others, p), abs=1e-9)


def test_leave_one_out_of_a_single_entity(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double")
    r = scans.leave_one_out_quantiles(df, "k", "v", {"m": 0.5}).first()
    assert (r["count"], r.m) == (0, None)


def test_first_crossing(spark):
    rng = random.Random(5)
    events = [(p, n, float(rng.randint(0, 40))) for p in "ab" for n in range(1, 40)]
    targets = [(p, float(t)) for p in "abc" for t in range(0, 50, 3)]
    got = jn.first_crossing(
        spark.createDataFrame(events, "p string, no int, reach double"), spark.createDataFrame(targets, "p string, t double"), ["p"], "reach", "no", "t"
    ).collect()
    assert len(got) == len(targets)
    for r in got:
        hits = [n for p, n, reach in events if p == r.p and reach >= r.t]
        assert r.hit_no == (min(hits) if hits else None)


def test_suffix_join_prefers_matching_parts_then_short_paths(spark):
    targets = [("p", "src/a.c"), ("p", "a.c"), ("p", "lib/deep/long/name/of/a/file.c"), ("p", "none.c"), ("q", "src/a.c")]
    names = ["/x/src/a.c.html", "/x/y/src/a.c.html", "/other/ba.c.html", "/xsrc/a.c.html", "/r/lib/deep/long/name/of/a/file.c.html"]
    got = jn.suffix_join(
        spark.createDataFrame(targets, "project string, path string"),
        spark.createDataFrame([("p", n) for n in names], "project string, page string"),
        ["project"], "path", "page", ending=".html",
    )
    assert {(r.project, r.path): r.page for r in got.collect()} == {
        ("p", "src/a.c"): "/x/src/a.c.html",
        ("p", "a.c"): "/xsrc/a.c.html",
        ("p", "lib/deep/long/name/of/a/file.c"): "/r/lib/deep/long/name/of/a/file.c.html",
    }


def test_nearest_neighbours_are_exact_across_blocks(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(100, 3)) * 0.01 + 5, [[90.0, 0.0, 0.0]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id bigint, a double, b double, c double")
    got: dict = {}
    for r in sp.nearest_neighbours(df, "id", ["a", "b", "c"], 4, block_rows=37, bins=16).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.other
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [got[i][n] for n in (1, 2, 3, 4)] == list(np.argsort(d, kind="stable")[:4])


def test_smote_balances_the_classes(spark):
    df = spark.createDataFrame([(i, int(i % 9 == 0), float(i % 13), float(i)) for i in range(200)], "id bigint, label int, x double, y double")
    extra = sp.smote(df, "label", "id", ["x", "y"], seed=2)
    few = df.filter("label = 1").count()
    assert extra.count() == 200 - 2 * few
    assert extra.filter("y < 0 OR y > 199 OR x < 0 OR x > 12").count() == 0
    again = sp.smote(df.repartition(5), "label", "id", ["x", "y"], seed=2)
    assert sorted(map(tuple, extra.collect())) == sorted(map(tuple, again.collect()))


def test_under_sample_keeps_equal_classes(spark):
    df = spark.range(5000).select("id", (F.col("id") % 11 == 0).cast("int").alias("y"))
    got = {r.y: r["count"] for r in sp.under_sample(df, "y", ["id"], 1).groupBy("y").count().collect()}
    assert got == {0: 455, 1: 455}


def test_past_event_counts_are_strict_on_both_ends(spark):
    days = spark.createDataFrame([("f", "2024-01-01"), ("f", "2024-01-31"), ("f", "2024-02-01")], "path string, d string").selectExpr("path", "to_date(d) AS day")
    events = days.filter("day < '2024-01-31'")
    got = {str(r.day): (r.count_30d, r.count_ever, r.last_day) for r in wn.past_event_counts(days, events, ["path"], [30]).collect()}
    assert got["2024-01-01"] == (0, 0, None)
    assert got["2024-01-31"][:2] == (0, 1)  # exactly 30 days back is outside
    assert got["2024-02-01"][:2] == (0, 1)
