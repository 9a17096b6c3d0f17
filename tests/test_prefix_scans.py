"""Prefix scans of any fold, developers by bitmaps, and crossings, with most rows under one key."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import history as hs
from riskloom.operators import joins as jn
from riskloom.operators import scans as sc
from riskloom.operators import windows as wn
from riskloom.plans import attribution as at


@pytest.fixture
def many_partitions(spark):
    """Range partitions are not merged, as they would be on such small tables."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def hot_rows(n=6000):
    """Nine rows in ten have key ``a``; values are null now and then."""
    rng = random.Random(3)
    return [("a" if rng.random() < 0.9 else rng.choice("bc"), i, rng.choice([None, *range(-5, 100)])) for i in range(n)]


def test_every_fold_over_a_hot_key(spark, many_partitions):
    data = hot_rows()
    rows = sc.in_ranges(spark.createDataFrame(data, "k string, at long, v long").repartition(5), ["k"], ["at"])
    sizes = [r["count"] for r in rows.filter("k = 'a'").groupBy("_chunk").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < len(data) / 3  # what the largest task of the scan reads, but for one carried row
    folds = {
        "s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")),
        "last": ("max", sc.last_value(["at"], F.col("v"))), "three": ("join", F.when(F.col("at") % 2000 < 3, F.array("at"))),
    }
    for current in (True, False):
        got = {r["at"]: r for r in sc.prefix_scan(rows, ["k"], [F.asc("at")], folds, current).collect()}
        assert len(got) == len(data)
        seen = {k: [] for k in "abc"}
        for k, i, v in data:
            mine = seen[k] + ([(i, v)] if current else [])
            known = [x for _, x in mine if x is not None]
            r = got[i]
            assert (r["s"], r["hi"], r["lo"]) == ((sum(known), max(known), min(known)) if known else (None, None, None))
            assert (r["last"] and r["last"]["value"]) == (known[-1] if known else None)
            assert r["three"] == [j for j, _ in mine if j % 2000 < 3]
            seen[k].append((i, v))


def test_scan_of_nothing_and_of_null_keys(spark):
    schema = "k string, at long, v long"
    run = lambda data: sc.prefix_scan(sc.in_ranges(spark.createDataFrame(data, schema), ["k"], ["at"]), ["k"], [F.asc("at")], {"s": ("sum", F.col("v"))})
    assert run([]).count() == 0
    assert sorted((r["at"], r["s"]) for r in run([(None, 1, 2), (None, 2, 3), ("x", 3, 4)]).collect()) == [(1, 2), (2, 5), (3, 4)]


def developers_brute(changes):
    met, out = {}, {}
    for p, c, author, day, path in sorted(changes, key=lambda r: (r[3], r[1])):
        met.setdefault((p, path), set()).add(author)
    seen: dict = {}
    by_commit: dict = {}
    for r in changes:
        by_commit.setdefault((r[3], r[1], r[0]), []).append(r)
    for (day, c, p), rows in sorted(by_commit.items()):
        for r in rows:
            seen.setdefault((p, r[4]), set()).add(r[2])
        out[p, c] = len(set().union(*[seen[p, r[4]] for r in rows]))
    return out


CHANGES = "project string, commit_id long, author string, day date, path string"


@pytest.mark.parametrize("listed", [0, 3, 512])
def test_developers(spark, many_partitions, listed):
    """Against sets, with lists only, bitmaps only, and both in one commit."""
    import datetime as dt

    rng = random.Random(8)
    changes = []
    for c in range(900):
        p, author, day = rng.choice("xy"), f"a{int(rng.random() ** 2 * 80)}", dt.date(2024, 1, 1 + rng.randrange(28))
        changes += [(p, c, author, day, f"f{f}") for f in {int(rng.random() ** 3 * 40) for _ in range(rng.randrange(1, 5))}]
    got = hs.developers(spark.createDataFrame(changes + changes[:50], CHANGES), listed)
    assert {(r["project"], r["commit_id"]): r["ndev"] for r in got.collect()} == developers_brute(changes)


def test_developers_of_one_file_with_half_of_all_changes(spark, many_partitions):
    """50,000 authors in one file, two ranges of bitmaps; commits of two files count the union."""
    n = 50_000
    commits = spark.range(n).select(
        F.lit("p").alias("project"), F.col("id").alias("commit_id"), F.concat(F.lit("a"), "id").alias("author"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 100).cast("int")).alias("day")
    )
    hot, other = commits.withColumn("path", F.lit("hot")), commits.withColumn("path", F.concat(F.lit("f"), F.col("commit_id") % 1000)).filter("commit_id % 2 = 0")
    got = hs.developers(hot.unionByName(other))
    wrong = got.filter("ndev <> commit_id + 1")  # everybody so far has touched the hot file
    assert got.count() == n and wrong.count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_or_agg" in plan


def crossing_brute(events, targets):
    out = {}
    for k, t in targets:
        hits = [no for kk, no, reach in events if kk == k and reach + 1e-9 >= t]
        out[k, t] = min(hits, default=None)
    return out


def test_first_crossing_with_one_hot_key(spark, many_partitions):
    rng = random.Random(5)
    events = [("a" if rng.random() < 0.9 else "b", i, float(int(i**0.7 * rng.random() * 4)) / 4) for i in range(3000)]
    targets = [(k, float(t) / 4) for k in "abz" for t in range(0, 1000, 7)] + [("a", 1.0)] * 3
    got = jn.first_crossing(spark.createDataFrame(events, "k string, no int, reach double"), spark.createDataFrame(targets, "k string, t double"), ["k"], "reach", "no", "t")
    assert {(r["k"], r["t"]): r["hit_no"] for r in got.collect()} == crossing_brute(events, set(targets))


def test_attribution_with_most_events_in_one_project(spark, many_partitions):
    """The same result whether the events of a project are one range or many."""
    import datetime as dt

    rng = random.Random(6)
    schedule = [("s", "hot" if rng.random() < 0.9 else f"p{i % 5}", dt.date(2020, 1, 1) + dt.timedelta(days=i // 4), i, float(rng.randrange(0, 9))) for i in range(2000)]
    targets = [(p, float(rng.randrange(0, 400))) for p in ["hot", "p1", "p2", "none"] for _ in range(60)]
    frames = (
        spark.createDataFrame(schedule, "strategy string, project string, day date, event_id long, scheduled double"),
        spark.createDataFrame(targets, "project string, target double"),
        spark.createDataFrame([("hot", 0.5), ("p1", 1.0)], "project string, rate double"),
    )
    sizes = sc.in_ranges(frames[0], at.KEYS, at.ORDER).filter("project = 'hot'").groupBy("_chunk").count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 700
    cut = sorted(map(tuple, at.crossing_attribution(*frames, window=30).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        whole = sorted(map(tuple, at.crossing_attribution(*frames, window=30).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert cut == whole and len(cut) == 2000


def test_peer_percentile_of_many_members(spark):
    """Against counts per day: one project with most members, windows that close and open again."""
    import datetime as dt

    rng, start, window = random.Random(9), dt.date(2024, 1, 1), 5
    events = [("hot" if rng.random() < 0.9 else "cold", f"m{int(rng.random() ** 2 * 60)}", start + dt.timedelta(days=int(rng.random() * 40))) for _ in range(900)]
    got = {(r["p"], r["m"], r["day"]): (r["own_count"], r["peers"], r["percentile"]) for r in wn.peer_percentile(spark.createDataFrame(events, "p string, m string, day date"), "p", "m", window=window).collect()}
    assert set(got) == set(events)
    for (p, m, day), (own, peers, share) in got.items():
        counts = {}
        for q, other, d in events:
            if q == p and 0 <= (day - d).days <= window:
                counts[other] = counts.get(other, 0) + 1
        below, equal = sum(c < counts[m] for c in counts.values()), sum(c == counts[m] for c in counts.values())
        assert (own, peers) == (counts[m], len(counts)) and share == pytest.approx((below + (equal + 1) / 2) / len(counts))


def test_peer_percentile_copies_no_row_per_day(spark):
    """A window of a thousand days makes no more rows than one of a day: two change points per daily row."""
    events = spark.range(2000).selectExpr("'p' AS p", "id % 500 AS m", "date_add(DATE '2024-01-01', CAST(id % 7 AS INT)) AS day")
    plan = wn.peer_percentile(events, "p", "m", window=1000)
    assert plan.count() == events.distinct().count()
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(day" in text and text.count("explode(sequence(") == 1  # only (count, level) intervals are spread over days
