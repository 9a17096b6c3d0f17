"""Jobs that build the base tables: advisories, detections, labelled commits, revisions, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import clean
from riskloom.functions import numeric as nm
from riskloom.functions import records as rec
from riskloom.functions import text as tx
from riskloom.operators import sets as st
from riskloom.operators import text_features as tf
from riskloom.operators import windows as wn
from riskloom.session import settle


def advisory_table(records: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Flat advisories in issue order (no issue last); times outside the window drop out, unknown ones stay."""
    flat = records.select(F.struct(*records.columns).alias("_a")).select(*rec.advisory_columns("_a"))
    if start is not None and end is not None:
        for column in ("published", "modified"):
            flat = flat.filter(clean.missing_or_within(clean.lenient_timestamp(column), start, end))
    return flat.orderBy(F.asc_nulls_last("issue_id"), "advisory_id")


def label_table(
    commits: DataFrame,
    advisories: DataFrame,
    done: DataFrame | None = None,
    message: str | None = None,
    k: int = 10,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Commits with their flag and term weights; commits already in ``done`` are carried over.

    Old rows win over new ones of the same commit, then every row is labelled afresh.
    """
    rows = commits
    if done is not None:
        fresh = st.not_yet_done(commits, done, ["project", "commit_id"])
        rows = st.merge_new_rows(done, fresh, ["project", "commit_id"], ["day"])
    rows = rows.drop("flagged")
    out = tf.label_commits(rows, advisories)
    if message:
        # the corpus is read three times; the joins above should not be
        out = tf.add_tfidf(settle(out, "labelled-commits"), "commit_id", message, k=k, entity=["project"], stop_words=stop_words)
    return out


def detection_table(advisories: DataFrame, issues: DataFrame, commits: DataFrame) -> DataFrame:
    """Days from the introducing commit to the report of each advisory.

    ``advisories``: issue_id, project, repo, introduced_commits. ``issues``: issue, reported.
    ``commits``: repo, sha, committed. Advisories without a known commit keep a null span.
    """
    reported = advisories.join(issues, advisories.issue_id == issues.issue).drop("issue")
    keyed = reported.withColumns({"sha": tx.first_of_list("introduced_commits"), "repo_key": tx.owner_and_name("repo")})
    known = commits.select(tx.owner_and_name("repo").alias("repo_key"), "sha", "committed").groupBy("repo_key", "sha").agg(F.min("committed").alias("committed"))
    # rows without a commit get a key of their own, so they do not meet in one task
    spread = F.coalesce("sha", F.concat(F.lit("none:"), F.col("issue_id").cast("string")))
    known = known.withColumnRenamed("sha", "_sha")
    out = keyed.withColumn("_sha", spread).join(known, ["repo_key", "_sha"], "left").drop("_sha")
    return out.withColumn("days", nm.whole_days_between("committed", "reported"))


def revision_table(source_maps: DataFrame, projects: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Revisions with commit day, the canonical rows' counts, and day-to-day revision pairs.

    ``source_maps``: project, date, repo_name, url, revision. ``projects``: project,
    main_repo. ``commits``: revision, committed. Addresses are written first, so that Spark
    knows how few they are and does not shuffle the source maps by project.
    """
    main = projects.filter(F.trim("main_repo") != "").select("project", tx.repo_key("main_repo", lower=False).alias("_main"))
    main = settle(main, "main-repos")
    named = source_maps.join(main, "project", "left")
    canonical = F.coalesce(tx.repo_key("url", lower=False) == F.col("_main"), F.lit(False))
    named = named.withColumn("repo_name", F.when(canonical, F.col("project")).otherwise(F.col("repo_name"))).drop("_main")
    dated = named.join(commits.select("revision", clean.utc_iso_text("committed").alias("commit_date")), "revision", "left")
    wanted = main.select("project", F.col("project").alias("repo_name"))
    kept, counts = st.canonical_rows(dated, wanted, ["project", "repo_name"], "project")
    daily = kept.groupBy("project", "date").agg(F.max_by("revision", F.struct("commit_date", "revision")).alias("revision"))
    pairs = wn.previous_row(daily, "project", "revision", "previous_revision", day="date")
    return dated, counts, pairs


def advisory_summary(metadata: DataFrame, advisories: DataFrame) -> DataFrame:
    """Matched advisories per project, by repository address; most first.

    Advisories are counted per address before the join, so an address with very many
    advisories is one row there.
    """
    repos = metadata.select("project", "language", "main_repo", tx.repo_key("main_repo").alias("_repo")).filter("_repo <> ''")
    hits = advisories.select(tx.repo_key("repo").alias("_repo")).filter("_repo <> ''").groupBy("_repo").agg(F.count("*").alias("vulnerability_count"))
    return repos.join(hits, "_repo").drop("_repo").orderBy(F.desc("vulnerability_count"), "project")


def commit_days(advisories: DataFrame, order: str, include_fixed: bool = False) -> DataFrame:
    """Day of the first advisory naming each commit."""
    lists = [tx.split_list("introduced_commits")] + ([tx.split_list("fixed_commits")] if include_fixed else [])
    rows = advisories.select(order, clean.day_text("published").alias("day"), F.explode(F.concat(*lists)).alias("commit"))
    return rows.groupBy("commit").agg(F.min_by("day", order).alias("day"))

