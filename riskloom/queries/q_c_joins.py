"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import clean as c
from riskloom.functions import text as tx
from riskloom.operators import joins as jn
from riskloom.operators import sets as st
from riskloom.operators import windows as wn
from riskloom.plans import budgets, detection, features, summaries
from riskloom.plans import timeline as tl
from riskloom.queries import standins as s
from riskloom.queries.q_d_aggregates import _SIDE_SQL, _UNITS, _side
from riskloom.queries.q_e_windows import _CHUNKS, TIMELINE_CTE, timeline
from riskloom.queries.q_h_functions import _URLS_SQL, repos
from riskloom.queries.registry import query
from riskloom.session import load, settle


@query("c01_join_on_other_names", """
SELECT o_orderkey, c_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS reported FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_on_other_names(spark, sf):
    issues = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").cast("string").alias("reported"))
    names = load(spark, sf, "customer").select("c_custkey", "c_name")
    return issues.join(names, issues.o_custkey == names.c_custkey).select("o_orderkey", "c_name", "reported")


@query("c02_lookup_with_default", f"""WITH {s.RATES_CTE}
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(rate, 1) AS rate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN rates ON project = 'p' || s_nationkey AND s_nationkey < 20""")
def lookup_with_default(spark, sf):
    known = s.rates(spark, sf).filter(F.substring("project", 2, 9).cast("int") < 20)
    rows = s.lines_by_project(spark, sf, "l_orderkey", "l_linenumber", "l_partkey")
    return jn.lookup(rows, known, ["project"], {"rate": 1.0}).select("l_orderkey", "l_linenumber", "l_partkey", "rate")


@query("c03_one_to_many_normalised", f"""WITH {_URLS_SQL}, k AS (SELECT id, lower(regexp_replace(rtrim(trim(regexp_replace(regexp_replace(trim(url), '^git@([^:/]+):', 'https://\\1/'), '^(git|http|ssh)://', 'https://')), '/'), '\\.git$', '', 'i')) AS repo FROM repos)
SELECT a.repo, count(*) AS hits FROM k a JOIN k b ON a.repo = b.repo WHERE a.id % 20 = 0 AND b.id % 20 <> 0 GROUP BY 1""")
def one_to_many_normalised(spark, sf):
    keyed = repos(spark, sf).select("id", tx.repo_key(tx.https_url("url")).alias("repo"))
    # hits per repo are a product of two counts, so the matching rows never need to be formed
    projects = keyed.filter("id % 20 = 0").groupBy("repo").agg(F.count("*").alias("a"))
    reports = keyed.filter("id % 20 <> 0").groupBy("repo").agg(F.count("*").alias("b"))
    return projects.join(reports, "repo").select("repo", (F.col("a") * F.col("b")).alias("hits"))


@query("c04_flag_members", f"""WITH {s.COMMITS_CTE}, refs AS (SELECT DISTINCT project, unnest([commit_id, commit_id + 5]) AS commit_id FROM commits WHERE commit_id % 7 = 0)
SELECT c.project, c.commit_id, CASE WHEN r.commit_id IS NULL THEN 0 ELSE 1 END AS is_flagged FROM commits c LEFT JOIN refs r ON c.project = r.project AND c.commit_id = r.commit_id""")
def flag_members(spark, sf):
    commits = s.commits(spark, sf).select("project", "commit_id")
    lists = commits.filter("commit_id % 7 = 0").select(
        "project", F.concat(F.col("commit_id"), F.lit("; "), F.col("commit_id") + 5).alias("introduced")
    )
    members = lists.select("project", F.explode(tx.split_list("introduced").cast("array<bigint>")).alias("commit_id"))
    return jn.flag_members(commits, members, ["project", "commit_id"], "is_flagged")


@query("c05_not_yet_done", """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def not_yet_done(spark, sf):
    done = load(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return st.not_yet_done(load(spark, sf, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("c06_as_of_day_lag", f"""WITH {s.USER_DAYS_CTE}
SELECT e.event_id, u.n AS n_then, CASE WHEN u.user_id IS NULL THEN 0 ELSE 1 END AS has_then FROM events e
LEFT JOIN user_days u ON e.user_id = u.user_id AND u.day = CAST(e.ts AS DATE) - 2""")
def as_of_day_lag(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    daily = s.user_days(spark, sf).select("user_id", "day", F.col("n").alias("n_then"))
    return jn.as_of_day_lag(rows, daily, "user_id", 2, ["n_then"], "has_then", order=["n_then"]).select("event_id", "n_then", "has_then")


_STOPS = f"""{s.COMMITS_CTE}, stops AS (SELECT DISTINCT project, day FROM commits WHERE day BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND commit_id % 3 = 0),
probes AS (SELECT commit_id, CASE WHEN commit_id % 50 = 0 THEN 'nowhere' ELSE project END AS project, CASE WHEN commit_id % 41 <> 0 THEN day END AS day FROM commits),
ends AS (SELECT project, min(day) AS a, max(day) AS b FROM stops GROUP BY 1)"""


@query("c07_align_to_timeline", f"""WITH {_STOPS}
SELECT p.commit_id, CAST(CASE WHEN p.day IS NOT NULL THEN coalesce((SELECT min(t.day) FROM stops t WHERE t.project = p.project AND t.day >= p.day), e.b) END AS VARCHAR) AS aligned_day,
  CASE WHEN p.day IS NULL OR e.a IS NULL THEN 'missing' WHEN p.day < e.a THEN 'before_start' WHEN p.day > e.b THEN 'after_end' ELSE 'within_range' END AS align_status
FROM probes p LEFT JOIN ends e ON p.project = e.project""")
def align_to_timeline(spark, sf):
    commits = s.commits(spark, sf)
    inside = c.within_open_ended("day", F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    stops = commits.filter(inside & (F.col("commit_id") % 3 == 0)).select("project", "day").distinct()
    probes = commits.select(
        "commit_id",
        F.when(F.col("commit_id") % 50 == 0, "nowhere").otherwise(F.col("project")).alias("project"),
        F.when(F.col("commit_id") % 41 != 0, F.col("day")).alias("day"),
    )
    out = jn.align_to_timeline(probes, stops, "project", "day")
    return out.select("commit_id", F.col("aligned_day").cast("string").alias("aligned_day"), "align_status")


_FOLDS = """b AS (SELECT project, chunk, min(day) AS s, max(day) AS e FROM chunks GROUP BY ALL),
folds AS (SELECT t.project, 'fold-' || t.chunk AS fold, min(p.s) AS train_start, max(p.e) AS train_end FROM b t JOIN b p ON t.project = p.project AND p.chunk < t.chunk GROUP BY ALL)"""


@query("c08_interval_join", f"""WITH {_CHUNKS}, {_FOLDS}, {s.DETECTIONS_CTE}
SELECT d.project, fold, count(*) AS n, CAST(sum(days) AS BIGINT) AS days FROM detections d JOIN folds f ON d.project = f.project
  AND d.commit_day <= f.train_end AND (f.fold = 'fold-1' OR d.commit_day >= f.train_start) GROUP BY ALL""")
def interval_join(spark, sf):
    folds, _ = wn.walk_forward(s.scored(spark, sf).select("project", "day"), "project", 4)
    folds = folds.select("project", "fold", F.when(F.col("fold") != "fold-1", F.col("train_start")).alias("train_start"), "train_end")
    rows = s.detections(spark, sf).groupBy("project", "commit_day").agg(F.count("*").alias("n"), F.sum("days").alias("days"))
    out = jn.interval_join(rows, folds, "project", "commit_day", "train_start", "train_end")
    return out.groupBy("project", "fold").agg(F.sum("n").alias("n"), F.sum("days").alias("days"))


HISTORY_CTE = f"""{s.COMMIT_FILES_CTE}, ev AS (SELECT DISTINCT project, path, day FROM commit_files WHERE flagged = 1),
fh AS (SELECT f.project, f.commit_id, f.day, f.path, count(ev.day) AS ever, count(ev.day) FILTER (WHERE ev.day > f.day - 180) AS w180, max(ev.day) AS last
  FROM commit_files f LEFT JOIN ev ON ev.project = f.project AND ev.path = f.path AND ev.day < f.day GROUP BY ALL),
hist AS (SELECT project, commit_id, day, CAST(max(CASE WHEN ever > 0 THEN 1 ELSE 0 END) AS INTEGER) AS past_any_ever, CAST(sum(ever) AS BIGINT) AS past_count_ever,
  avg(CASE WHEN ever > 0 THEN 1 ELSE 0 END) AS past_file_ratio_ever, CAST(min(date_diff('day', last, day)) AS INTEGER) AS days_since_past_min,
  CAST(max(CASE WHEN w180 > 0 THEN 1 ELSE 0 END) AS INTEGER) AS past_any_180d, CAST(sum(w180) AS BIGINT) AS past_count_180d FROM fh GROUP BY ALL)"""


@query("c09_past_event_features", f"""WITH {HISTORY_CTE}
SELECT project, commit_id, past_any_ever, past_count_ever, round(past_file_ratio_ever, 6) AS past_file_ratio_ever, days_since_past_min, past_any_180d, past_count_180d FROM hist""")
def past_event_features(spark, sf):
    out = features.file_history_features(s.commit_files(spark, sf), [180])
    return out.drop("day").withColumn("past_file_ratio_ever", F.round("past_file_ratio_ever", 6))


@query("c10_leave_one_out", f"""WITH {_UNITS}
SELECT p.project, count(*) AS others, sum(u.units) AS other_units FROM (SELECT DISTINCT project FROM units) p JOIN units u ON u.project <> p.project GROUP BY 1""")
def leave_one_out(spark, sf):
    units = detection.detection_units(s.detections(spark, sf), s.rates(spark, sf))
    return summaries.leave_one_out_sums(units, "project", "units")


_PATHS_SQL = """
targets AS (SELECT DISTINCT 'src' || (p_size % 5) || '/' || p_name || '.c' AS path, p_brand AS project FROM part),
cands AS (SELECT p_brand AS project, '/' || CASE p_partkey % 3 WHEN 0 THEN 'proj/out' WHEN 1 THEN 'proj' ELSE 'x' END || '/' || 'src' || (p_partkey % 5) || '/' || p_name || '.c.html' AS candidate FROM part)"""


@query("c11_suffix_join", f"""WITH {_PATHS_SQL}, m AS (SELECT DISTINCT t.project, t.path, c.candidate FROM targets t JOIN cands c ON t.project = c.project AND ends_with(c.candidate, t.path || '.html'))
SELECT project, path, arg_min(candidate, (length(candidate), candidate)) AS candidate FROM m GROUP BY ALL""")
def suffix_join(spark, sf):
    part = load(spark, sf, "part")
    targets = part.select(F.col("p_brand").alias("project"), F.concat(F.lit("src"), F.col("p_size") % 5, F.lit("/"), "p_name", F.lit(".c")).alias("path"))
    k = F.col("p_partkey")
    root = F.when(k % 3 == 0, "proj/out").when(k % 3 == 1, "proj").otherwise("x")
    candidates = part.select(
        F.col("p_brand").alias("project"),
        F.concat(F.lit("/"), root, F.lit("/src"), k % 5, F.lit("/"), "p_name", F.lit(".c.html")).alias("candidate"),
    )
    return jn.suffix_join(targets, candidates, ["project"], "path", "candidate", ending=".html")


@query("c12_covered_lines", """
WITH l AS (SELECT doc_id, source, line, i AS line_no FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(line, i)),
d AS (SELECT doc_id AS file, line_no, trim(line) AS content FROM l WHERE line_no % 2 = 1),
r AS (SELECT doc_id AS file, line_no, CASE WHEN line_no % 3 = 0 THEN 'changed' ELSE trim(line) END AS content, CASE WHEN line_no % 5 <> 0 THEN line_no % 4 END AS execute FROM l)
SELECT d.file, count(*) AS total_added_lines, count(*) FILTER (WHERE d.content = r.content AND r.execute > 0) AS covered_added_lines FROM d LEFT JOIN r USING (file, line_no) GROUP BY 1""")
def covered_lines(spark, sf):
    lines = load(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("file", (F.col("pos") + 1).alias("line_no"), F.trim("line").alias("content"))
    report = lines.select(
        "file", "line_no",
        F.when(F.col("line_no") % 3 == 0, "changed").otherwise(F.col("content")).alias("content"),
        F.when(F.col("line_no") % 5 != 0, F.col("line_no") % 4).alias("execute"),
    )
    return jn.covered_lines(lines.filter("line_no % 2 = 1"), report, ["file"])


LABELLED_CTE = f"""{TIMELINE_CTE}, ordered AS (SELECT project, day, row_number() OVER (PARTITION BY project ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY project) AS n FROM preds),
chunks AS (SELECT project, day, CAST(floor(i / greatest(ceil(n / 4.0), 1)) AS BIGINT) AS chunk FROM ordered), {_FOLDS},
labelled AS (SELECT t.project, t.day, t.day_index, t.rate, t.unit_end, p.risk, coalesce(p.risk >= 0.7, false) AS is_flagged, f.fold, f.train_start, f.train_end, p.churn
  FROM timeline t LEFT JOIN preds p ON t.project = p.project AND t.day = p.day LEFT JOIN chunks c ON c.project = t.project AND c.day = t.day
  LEFT JOIN folds f ON f.project = t.project AND f.fold = 'fold-' || c.chunk)"""
LABELLED_CTE = LABELLED_CTE.replace("ordered AS", "preds AS (SELECT project, day, risk, added + deleted AS churn FROM scored WHERE (added + deleted) % 10 <> 0), ordered AS", 1)


def predictions(daily):
    """Scored days with gaps: every tenth churn value is missing from the predictions."""
    churn = F.col("added") + F.col("deleted")
    return daily.select("project", "day", F.col("risk").alias("predicted_risk_x"), churn.alias("churn")).filter("churn % 10 <> 0")


def labelled(spark, sf):
    daily = settle(s.scored(spark, sf), "scored")
    return tl.labelled_timeline(timeline(spark, sf, daily), predictions(daily), "predicted_risk_x", threshold=0.7, folds=4, extra=["churn"])


@query("c13_labelled_timeline", f"""WITH {LABELLED_CTE}
SELECT project, CAST(day AS VARCHAR) AS day, CAST(day_index AS BIGINT) AS day_index, rate, risk, CAST(is_flagged AS INTEGER) AS is_flagged, fold,
  CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end FROM labelled""")
def labelled_timeline(spark, sf):
    return labelled(spark, sf).select(
        "project", F.col("day").cast("string").alias("day"), F.col("day_index").cast("bigint").alias("day_index"), "rate", "risk",
        F.col("is_flagged").cast("int").alias("is_flagged"), "fold", F.col("train_start").cast("string").alias("train_start"), F.col("train_end").cast("string").alias("train_end"),
    )


_CROSS = f"""{s.SCORED_CTE}, {_UNITS}, e AS (SELECT project, day, row_number() OVER (PARTITION BY project ORDER BY day) AS no, added * 100.0::DOUBLE AS reach FROM scored),
tg AS (SELECT DISTINCT project, units AS target FROM units)"""


@query("c14_first_crossing", f"""WITH {_CROSS}
SELECT t.project, t.target, CAST(min(e.no) AS INTEGER) AS hit_no FROM tg t LEFT JOIN e ON e.project = t.project AND e.reach + 1e-9 >= t.target GROUP BY ALL""")
def first_crossing(spark, sf):
    daily = s.scored(spark, sf).select("project", "day", (F.col("added") * 100.0).alias("reach"))
    events = daily.withColumn("no", F.row_number().over(wn.by_day("project")))
    targets = detection.detection_units(s.detections(spark, sf), s.rates(spark, sf)).select("project", F.col("units").alias("target"))
    return jn.first_crossing(events, targets, ["project"], "reach", "no", "target")


@query("c15_eligible_records", f"""WITH {s.DETECTIONS_CTE}, f AS (SELECT 'p' || s_nationkey AS project, min(CAST(l_shipdate AS DATE)) AS first_day FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45 GROUP BY 1)
SELECT d.project, count(*) AS eligible FROM detections d JOIN f ON d.project = f.project WHERE commit_day >= first_day GROUP BY 1""")
def eligible_records(spark, sf):
    reports = s.lines_by_project(spark, sf, "l_shipdate", "l_quantity").filter("l_quantity > 45")
    first = reports.groupBy("project").agg(F.min(F.to_date("l_shipdate")).alias("first_day"))
    out = s.detections(spark, sf).join(first, "project").filter("commit_day >= first_day")
    return out.groupBy("project").agg(F.count("*").alias("eligible"))


@query("c16_daily_values_to_rows", f"""WITH {s.ACTIVITY_CTE}
SELECT e.event_id, a.commit_count AS prev_count, CAST(a.commit_count - b.commit_count AS BIGINT) AS delta_count FROM events e
LEFT JOIN activity a ON a.project = e.event_type AND a.day = CAST(e.ts AS DATE) - 1
LEFT JOIN activity b ON b.project = e.event_type AND b.day = CAST(e.ts AS DATE) - 2""")
def daily_values_to_rows(spark, sf):
    daily = features.coverage_lags(s.activity(spark, sf), ["commit_count"], 1)
    rows = load(spark, sf, "events").select("event_id", F.col("event_type").alias("project"), F.to_date("ts").alias("day"))
    out = rows.join(daily, ["project", "day"], "left")
    return out.select("event_id", F.col("commit_count_prev").alias("prev_count"), F.col("commit_count_delta").alias("delta_count"))


@query("c17_against_baseline", f"""WITH {_SIDE_SQL}
SELECT strategy, project, total, baseline, greatest(baseline - total, 0) AS residual, greatest(total - baseline, 0) AS overrun FROM side""")
def against_baseline(spark, sf):
    per, base = _side(spark, sf)
    return summaries.against_baseline(per, base, "total").drop("rows")


@query("c18_observed_work", f"""WITH {TIMELINE_CTE}, {s.DETECTIONS_CTE},
d AS (SELECT project, commit_day AS day, sum(days) AS days FROM detections GROUP BY ALL)
SELECT t.project, CAST(t.day AS VARCHAR) AS day, CAST(greatest(coalesce(days, 0) * rate, 0) AS BIGINT) AS observed FROM timeline t LEFT JOIN d ON t.project = d.project AND t.day = d.day""")
def observed_work(spark, sf):
    out = budgets.observed_work(timeline(spark, sf), s.detections(spark, sf))
    return out.select("project", F.col("day").cast("string").alias("day"), F.col("observed").cast("bigint").alias("observed"))
