"""Change-history features."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import history as hs
from riskloom.queries import standins as s
from riskloom.queries.registry import query

CF = s.COMMIT_FILES_CTE
# one row per commit that has files
CM = CF + ", cm AS (SELECT DISTINCT project, commit_id, author, day FROM commit_files)"


def _files(spark, sf):
    return s.commit_files(spark, sf)


@query("j01_spread", f"""WITH {CF}
SELECT project, commit_id, count(DISTINCT path) AS files_changed, count(DISTINCT split_part(path, '/', 1)) AS subsystems_changed,
  count(DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2)) AS directories_changed FROM commit_files GROUP BY ALL""")
def spread(spark, sf):
    return hs.spread(_files(spark, sf))


@query("j02_past_fixes", f"""WITH {CF}, r AS (SELECT project, commit_id, sum(is_fix) OVER (PARTITION BY project, path ORDER BY day, commit_id) AS n FROM commit_files)
SELECT project, commit_id, CAST(sum(n) AS BIGINT) AS past_bug_fixes FROM r GROUP BY ALL""")
def past_fixes(spark, sf):
    return hs.past_fixes(_files(spark, sf))


@query("j03_developers", f"""WITH {CF}
SELECT a.project, a.commit_id, count(DISTINCT b.author) AS ndev FROM commit_files a JOIN commit_files b ON a.project = b.project AND a.path = b.path AND (b.day, b.commit_id) <= (a.day, a.commit_id) GROUP BY ALL""")
def developers(spark, sf):
    return hs.developers(_files(spark, sf))


@query("j04_age", f"""WITH {CF}, r AS (SELECT project, commit_id, date_diff('day', lag(day) OVER (PARTITION BY project, path ORDER BY day, commit_id), day) AS gap FROM commit_files)
SELECT project, commit_id, round(coalesce(avg(gap), 0), 6) AS age FROM r GROUP BY ALL""")
def age(spark, sf):
    return hs.age(_files(spark, sf)).withColumn("age", F.round("age", 6))


@query("j05_file_count", f"WITH {CF} SELECT project, commit_id, count(DISTINCT path) AS nuc FROM commit_files GROUP BY ALL")
def file_count(spark, sf):
    return hs.file_count(_files(spark, sf))


@query("j06_experience", f"WITH {CM} SELECT project, commit_id, row_number() OVER (PARTITION BY project, author ORDER BY day, commit_id) - 1 AS exp FROM cm")
def experience(spark, sf):
    return hs.experience(_files(spark, sf))


@query("j07_recent_experience", f"""WITH {CM}
SELECT a.project, a.commit_id, CAST(coalesce(sum(1.0::DOUBLE / (1 + year(a.day) - year(b.day))), 0) AS DOUBLE) AS rexp FROM cm a LEFT JOIN cm b
  ON a.project = b.project AND a.author = b.author AND b.day >= a.day - 90 AND (b.day, b.commit_id) < (a.day, a.commit_id) GROUP BY ALL""")
def recent_experience(spark, sf):
    return hs.recent_experience(_files(spark, sf))


@query("j08_subsystem_experience", f"""WITH {CF}, sub AS (SELECT DISTINCT project, commit_id, author, day, split_part(path, '/', 1) AS sub FROM commit_files),
r AS (SELECT project, commit_id, row_number() OVER (PARTITION BY project, author, sub ORDER BY day, commit_id) - 1 AS n FROM sub)
SELECT project, commit_id, max(n) AS sexp FROM r GROUP BY ALL""")
def subsystem_experience(spark, sf):
    return hs.subsystem_experience(_files(spark, sf))


@query("j09_previous_size", f"""WITH {CF}, r AS (SELECT project, commit_id, coalesce(sum(added - deleted) OVER (PARTITION BY project, path ORDER BY day, commit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM commit_files)
SELECT project, commit_id, CAST(sum(greatest(n, 0)) AS BIGINT) AS total_prev_loc FROM r GROUP BY ALL""")
def previous_size(spark, sf):
    return hs.previous_size(_files(spark, sf))


@query("j10_days_since_creation", f"""WITH {CF}, r AS (SELECT project, commit_id, date_diff('day', min(day) OVER (PARTITION BY project, path), day) AS n FROM commit_files)
SELECT project, commit_id, round(avg(n), 6) AS mean_days_since_creation FROM r GROUP BY ALL""")
def days_since_creation(spark, sf):
    return hs.days_since_creation(_files(spark, sf)).withColumn("mean_days_since_creation", F.round("mean_days_since_creation", 6))


@query("j11_past_changes", f"""WITH {CF}, r AS (SELECT project, commit_id, row_number() OVER (PARTITION BY project, path ORDER BY day, commit_id) - 1 AS n FROM commit_files)
SELECT project, commit_id, round(avg(n), 6) AS mean_past_changes FROM r GROUP BY ALL""")
def past_changes(spark, sf):
    return hs.past_changes(_files(spark, sf)).withColumn("mean_past_changes", F.round("mean_past_changes", 6))


_RECENT = CM + """, dp AS (SELECT project, day, count(*) AS n FROM cm GROUP BY ALL), da AS (SELECT project, author, day, count(*) AS n FROM cm GROUP BY ALL),
rp AS (SELECT a.project, a.day, sum(b.n) AS n FROM dp a JOIN dp b ON a.project = b.project AND b.day BETWEEN a.day - 30 AND a.day GROUP BY ALL),
ra AS (SELECT a.project, a.author, a.day, sum(b.n) AS n FROM da a JOIN da b ON a.project = b.project AND a.author = b.author AND b.day BETWEEN a.day - 30 AND a.day GROUP BY ALL)"""


@query("j12_author_share", f"""WITH {_RECENT}, r AS (SELECT *, row_number() OVER (PARTITION BY project, author ORDER BY day, commit_id) - 1 AS own, row_number() OVER (PARTITION BY project ORDER BY day, commit_id) AS total FROM cm)
SELECT r.project, r.commit_id, round(own::DOUBLE / total, 6) AS share_ever, round(ra.n::DOUBLE / rp.n, 6) AS share_recent FROM r JOIN rp ON r.project = rp.project AND r.day = rp.day
  JOIN ra ON r.project = ra.project AND r.author = ra.author AND r.day = ra.day""")
def author_share(spark, sf):
    return hs.author_share(_files(spark, sf)).withColumns({c: F.round(c, 6) for c in ("share_ever", "share_recent")})


@query("j13_recent_commits", f"""WITH {_RECENT}
SELECT cm.project, commit_id, CAST(rp.n AS BIGINT) AS commits_recent, CAST(ra.n AS BIGINT) AS author_recent FROM cm JOIN rp ON cm.project = rp.project AND cm.day = rp.day
  JOIN ra ON cm.project = ra.project AND cm.author = ra.author AND cm.day = ra.day""")
def recent_commits(spark, sf):
    return hs.recent_commits(_files(spark, sf))


@query("j15_project_age", f"""WITH {CM} SELECT project, commit_id, CAST(date_diff('day', min(day) OVER (PARTITION BY project), day) AS INTEGER) AS days_after_creation FROM cm""")
def project_age(spark, sf):
    return hs.project_age(_files(spark, sf))


@query("j16_earlier_revisions", f"""WITH {CF}, r AS (SELECT project, path, commit_id, row_number() OVER w AS position, last_value(commit_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS probe_commit
  FROM commit_files WINDOW w AS (PARTITION BY project, path ORDER BY day, commit_id))
SELECT project, path, probe_commit, position, commit_id FROM r WHERE commit_id <> probe_commit""")
def earlier_revisions(spark, sf):
    return hs.earlier_revisions(_files(spark, sf))


@query("j16_revision_positions", f"""WITH {CF}
SELECT project, path, commit_id, row_number() OVER w AS position, lag(commit_id) OVER w AS previous_commit FROM commit_files WINDOW w AS (PARTITION BY project, path ORDER BY day, commit_id)""")
def revision_positions(spark, sf):
    return hs.revision_positions(_files(spark, sf))


# An explicit list of probes; j16_revision_positions answers for every change.
@query("j16_revisions_before_probes", f"""WITH {CF}, r AS (SELECT project, path, commit_id, row_number() OVER (PARTITION BY project, path ORDER BY day, commit_id) AS position FROM commit_files)
SELECT p.project, p.path, p.commit_id AS probe_commit, r.position, r.commit_id FROM r p JOIN r ON r.project = p.project AND r.path = p.path AND r.position < p.position WHERE p.commit_id % 5 = 0""")
def revisions_before_probes(spark, sf):
    files = _files(spark, sf)
    return hs.earlier_revisions(files, files.filter("commit_id % 5 = 0").select("project", "path", "commit_id"))


@query("j17_commit_window", f"""WITH {s.COMMITS_CTE} SELECT commit_id, CAST(day AS VARCHAR) AS day FROM commits WHERE day BETWEEN DATE '1996-06-01' AND DATE '1998-06-30' ORDER BY day, commit_id""")
def commit_window(spark, sf):
    start, end = (F.lit(d).cast("date") for d in ("1996-06-01", "1998-06-30"))
    return hs.commit_window(s.commits(spark, sf), start, end).select("commit_id", F.col("day").cast("string").alias("day"))
