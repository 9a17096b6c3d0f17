"""What keeps tasks and disk bounded: shuffles dropped, commits dealt by rows, small tables known as small."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskloom import session as se
from riskloom.learning import sampling as sp
from riskloom.operators import history as hs
from riskloom.operators import sets as st
from riskloom.operators import tables as tb
from riskloom.operators import text_features as tf
from riskloom.plans import features as ft
from riskloom.plans import tables as tbl
from riskloom.queries import standins as s

DAY = dt.datetime(2024, 3, 1)


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def _local_folders(spark):
    folder = spark.sparkContext.getConf().get("spark.local.dir", "/tmp")
    return [Path(f) for f in folder.split(",")]


def _shuffle_files(spark):
    return {f for folder in _local_folders(spark) for f in folder.glob("blockmgr-*/*/shuffle_*.data")}


def test_settle_drops_its_shuffles(spark):
    """F1, F2."""
    was = spark.conf.get(se.DROP_SHUFFLES, None)
    rows = spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    before = _shuffle_files(spark)
    kept = rows.collect()
    assert _shuffle_files(spark) - before  # an action outside leaves its files, so the folder is the right one
    before = _shuffle_files(spark)
    settled = se.settle(rows, "sums")
    assert not _shuffle_files(spark) - before
    assert sorted(settled.collect()) == sorted(kept)
    assert spark.conf.get(se.DROP_SHUFFLES, None) == was


def test_setting_of_shuffles_is_restored_after_an_error(spark):
    was = spark.conf.get(se.DROP_SHUFFLES, None)
    with pytest.raises(ZeroDivisionError), se.shuffles_dropped(spark):
        assert spark.conf.get(se.DROP_SHUFFLES) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(se.DROP_SHUFFLES, None) == was


def test_training_set_of_one_class(spark):
    """F3."""
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("t", 3, 1)], "project string, row_id long, label int")
    schema = {"project": "string", "row_id": "bigint", "label": "int", "absent": "double"}
    assert sp.training_set(df, "exclude_target", "t", schema) is None
    rows = sp.training_set(df, "exclude_target", "t", schema, one_class=True)
    assert sorted(map(tuple, rows.collect())) == [("a", 1, 0, 0.0), ("a", 2, 0, 0.0)]


@pytest.fixture
def star(spark, tmp_path):
    """12 orders; order 3 has part 5 twice, one line has no part, one no order."""
    orders = [(k, 1 + k % 2, "F", DAY + dt.timedelta(days=k), "P") for k in range(1, 13)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, 20 * k + i, 2.0, i) for k in range(1, 13) for i in (1, 2)] + [(3, 5, 1.0, 3), (3, 5, 4.0, 4), (4, None, 3.0, 3), (None, 5, 9.0, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_commits_are_dealt_by_rows(spark, star, monkeypatch):
    """F4, F8, F9, F10: tasks grow in number with the rows and not in size."""
    monkeypatch.setattr(tb, "ROWS_OF_TASK", 5)
    files = s.commit_files(spark, star)
    assert files.rdd.getNumPartitions() == 6  # 28 lines
    rows = {(r.commit_id, r.path): (r.added, r.deleted) for r in files.collect()}
    assert len(rows) == 26 and rows[3, "sub5/dir5/f5.H"] == (5, 7) and rows[4, None] == (3, 3)
    assert hs.file_count(files).rdd.getNumPartitions() == 6


def test_counts_per_commit_need_no_further_shuffle(spark, star, capsys):
    """F4, F8: the rows of a commit are together already."""
    files = s.commit_files(spark, star)
    for out in (hs.spread(files), hs.file_count(files)):
        assert "hashpartitioning(project" not in _plan(out, capsys)
    assert {r.commit_id: (r.files_changed, r.subsystems_changed, r.directories_changed) for r in hs.spread(files).collect()}[3] == (3, 3, 3)


def test_texts_are_not_shuffled_by_entity(spark, capsys):
    """F6, F7."""
    docs = spark.createDataFrame([(1, "en", "aa bb aa"), (2, "en", "bb"), (3, None, "cc cc"), (4, "fr", None)], "doc_id long, lang string, text string")
    out = tf.add_tfidf(docs, "doc_id", "text", k=2, entity=["lang"], stop_words=())
    assert "hashpartitioning(lang" not in _plan(out, capsys)
    got = {r.doc_id: (round(r.w1, 4), round(r.w2, 4)) for r in out.collect()}
    assert got[2] == (0.0, 1.0) and got[4] == (0.0, 0.0) and got[3] == (0.0, 0.0)


def test_label_table_does_not_shuffle_texts_by_project(spark, capsys):
    """F6."""
    commits = spark.createDataFrame([(1, "p", "aa bb", 1), (2, "p", "bb", 2)], "commit_id long, project string, text string, day int")
    advisories = spark.createDataFrame([("p", "2;9")], "project string, introduced_commits string")
    out = tbl.label_table(commits, advisories, message="text", k=2, stop_words=())
    assert "hashpartitioning(project" not in _plan(out, capsys)
    assert {r.commit_id: r.flagged for r in out.collect()} == {1: 0, 2: 1}


def test_source_maps_are_not_shuffled_by_project(spark, capsys):
    """F5."""
    maps = spark.createDataFrame(
        [("p", "20240101", "x", "https://h.org/a/p.git", "r1"), ("p", "20240102", "x", "https://h.org/a/p", "r2"), ("p", "20240102", "y", "https://h.org/a/y", "r1"), ("q", "20240101", "q", "u", "r1")],
        "project string, date string, repo_name string, url string, revision string",
    )
    projects = spark.createDataFrame([("p", "https://h.org/a/p"), ("q", " ")], "project string, main_repo string").distinct()
    commits = spark.createDataFrame([("r1", DAY), ("r2", DAY)], "revision string, committed timestamp")
    dated, counts, pairs = tbl.revision_table(maps, projects, commits)
    assert "hashpartitioning(project" not in _plan(dated, capsys)
    assert sorted(map(tuple, counts.collect())) == [("p", 2, 3), ("q", 0, 1)]
    assert [(r.date, r.revision, r.previous_revision) for r in pairs.collect()] == [("20240102", "r2", "r1")]
    kept, _ = st.canonical_rows(maps, maps.filter("repo_name = 'x'"), ["project", "repo_name"], "project")
    assert "hashpartitioning(project" not in _plan(kept, capsys)


def _odd_changes(spark):
    """Busy and rare files and authors, days and commits that meet, repeated rows, and nulls in every column but the commit."""
    rng = random.Random(7)
    rows = []
    for commit in range(1, 241):
        project, author = rng.choice(["p", "q", "q", None]), rng.choice([1, 1, 1, 2, 3, 4, None])
        day = None if commit % 41 == 0 else dt.date(2023, 11, 1) + dt.timedelta(days=rng.randrange(150))
        flagged = rng.choice([0, 0, 1])
        for k in {rng.choice([0, 0, 1, 2, rng.randrange(3, 40)]) for _ in range(3)}:
            path = None if k == 2 else f"top{k % 3}/d{k % 5}/f{k}.c" if k % 4 else f"f{k}.c"
            added = None if rng.random() < 0.1 else rng.randrange(50)
            rows += [(project, commit, author, day, flagged, path, added, rng.randrange(60))] * rng.choice([1, 1, 1, 2])
    return spark.createDataFrame(rows, "project string, commit_id long, author long, day date, flagged int, path string, added long, deleted long"), len(rows)


def _sorted(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.mark.parametrize("most", [hs.SHORT_FILE, 6, 0])
def test_runs_written_once_give_every_measure(spark, most):
    """the same rows whether a key's history is one window, cut into chunks, or some of both."""
    changes, n = _odd_changes(spark)
    files, authors = hs.with_file_runs(changes, n, [30, 90], most), hs.with_author_runs(changes, n, most)
    assert files.count() == n
    assert (files.filter("long").count() > 0) == (most < hs.SHORT_FILE)
    for measure in (hs.age, hs.previous_size, hs.developers, hs.spread, hs.file_count, lambda df: ft.file_history_features(df, [30, 90])):
        assert _sorted(measure(files)) == _sorted(measure(changes))
    for measure in (hs.experience, hs.recent_experience, hs.subsystem_experience):
        assert _sorted(measure(authors)) == _sorted(measure(changes))


def test_developers_of_few_and_many_authors_from_runs(spark):
    """lists of short files and bitmaps of long ones meet in one commit."""
    rows = [("p", c, c % 37, DAY.date() + dt.timedelta(days=c), c % 2, path, 1, 0) for c in range(1, 121) for path in ("hot.c", f"a/f{c % 50}.c")]
    changes = spark.createDataFrame(rows, "project string, commit_id long, author long, day date, flagged int, path string, added long, deleted long")
    files = hs.with_file_runs(changes, len(rows), most=20)
    assert {r.path for r in files.filter("long").collect()} == {"hot.c"}
    assert _sorted(hs.developers(files, 10)) == _sorted(hs.developers(changes))


def test_measures_of_runs_do_not_shuffle_by_file_or_author(spark, capsys):
    """what a key had before is sorted once, not once per measure."""
    changes, n = _odd_changes(spark)
    files, authors = hs.with_file_runs(changes, n), hs.with_author_runs(changes, n)
    for out in (hs.age(files), hs.previous_size(files), hs.developers(files), ft.file_history_features(files), hs.experience(authors), hs.recent_experience(authors), hs.subsystem_experience(authors)):
        plan = _plan(out, capsys)
        assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning(") <= 1
