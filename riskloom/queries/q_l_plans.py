"""Composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.learning import curves
from riskloom.operators import aggregates as ag
from riskloom.operators import sets as st
from riskloom.operators import windows as wn
from riskloom.plans import attribution as at
from riskloom.plans import budgets as bd
from riskloom.plans import comparison as cp
from riskloom.plans import coverage as cv
from riskloom.plans import detection as dt
from riskloom.plans import features as ft
from riskloom.plans import funnel as fn
from riskloom.plans import sweep as sw
from riskloom.plans import tables as tbl
from riskloom.plans import timeline as tl
from riskloom.queries import q_a_sources as qa
from riskloom.queries import standins as s
from riskloom.queries.q_c_joins import HISTORY_CTE, LABELLED_CTE, labelled
from riskloom.queries.q_d_aggregates import _plan
from riskloom.queries.q_e_windows import CURVE_CTE, TIMELINE_CTE, timeline
from riskloom.queries.q_h_functions import _URLS_SQL, advisory_json, repos
from riskloom.queries.q_i_text import TFIDF_CTE, TFIDF_STOP
from riskloom.queries.registry import query
from riskloom.session import load, scratch_path, settle
from riskloom.sources import readers as rd
from riskloom.sources import writers as wr

# Daily totals of the stand-in coverage: one row per project and order day of status O.
_COVERAGE = """cov AS (SELECT o_orderpriority AS project, CAST(o_orderdate AS DATE) AS day, count(*) AS lines, CAST(sum(o_custkey % 50) AS BIGINT) AS hits FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)"""


def coverage_days(spark, sf):
    df = load(spark, sf, "orders").filter("o_orderstatus = 'O'")
    return df.groupBy(F.col("o_orderpriority").alias("project"), F.to_date("o_orderdate").alias("day")).agg(
        F.count("*").alias("lines"), F.sum(F.col("o_custkey") % 50).alias("hits")
    )


@query("l01_daily_feature_table", f"""WITH {HISTORY_CTE}, {_COVERAGE},
rw AS (SELECT c.project, c.commit_id, c.day + 1 AS day, c.flagged, c.is_fix, coalesce(past_any_ever, 0) AS past_any_ever, coalesce(past_count_ever, 0) AS past_count_ever,
    coalesce(past_file_ratio_ever, 0) AS ratio, days_since_past_min, coalesce(past_count_180d, 0) AS past_count_180d
  FROM commits c LEFT JOIN hist h ON c.project = h.project AND c.commit_id = h.commit_id
  WHERE c.day BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND EXISTS (SELECT 1 FROM cov WHERE cov.project = c.project AND cov.day = c.day)),
dd AS (SELECT project, day, count(*) AS n, max(flagged) AS y, sum(flagged) AS yn, avg(is_fix) AS fix, max(past_any_ever) AS any_ever, sum(past_count_ever) AS cnt_ever, avg(ratio) AS ratio, min(days_since_past_min) AS since, sum(past_count_180d) AS cnt_180 FROM rw GROUP BY ALL),
lim AS (SELECT project, max(day) AS last FROM cov GROUP BY 1)
SELECT d.project, CAST(d.day AS VARCHAR) AS label_day, CAST(d.day - 1 AS VARCHAR) AS feature_day, p.n AS daily_commit_count, p.y AS y_flagged, CAST(p.yn AS BIGINT) AS flagged_commit_count, round(p.fix, 6) AS is_fix,
  p.any_ever AS past_any_ever, CAST(p.cnt_ever AS BIGINT) AS past_count_ever, round(p.ratio, 6) AS past_file_ratio_ever, p.since AS days_since_past_min, CAST(p.cnt_180 AS BIGINT) AS past_count_180d,
  c1.lines AS lines_prev, CAST(c1.lines - c2.lines AS BIGINT) AS lines_delta, c1.hits AS hits_prev, CAST(c1.hits - c2.hits AS BIGINT) AS hits_delta
FROM dd d LEFT JOIN dd p ON p.project = d.project AND p.day = d.day - 1 JOIN lim ON lim.project = d.project
LEFT JOIN cov c1 ON c1.project = d.project AND c1.day = d.day - 1 AND d.day <= lim.last LEFT JOIN cov c2 ON c2.project = d.project AND c2.day = d.day - 2 AND d.day <= lim.last""")
def daily_feature_table(spark, sf):
    out = ft.daily_feature_table(
        s.commits(spark, sf), s.commit_files(spark, sf), coverage_days(spark, sf), None, {"is_fix": "mean"}, ["lines", "hits"],
        start="1996-01-01", end="2000-12-31", windows=[180],
    )
    return out.select(
        "project", F.col("label_day").cast("string").alias("label_day"), F.col("feature_day").cast("string").alias("feature_day"), "daily_commit_count", "y_flagged",
        "flagged_commit_count", F.round("is_fix", 6).alias("is_fix"), "past_any_ever", "past_count_ever", F.round("past_file_ratio_ever", 6).alias("past_file_ratio_ever"),
        "days_since_past_min", "past_count_180d", "lines_prev", "lines_delta", "hits_prev", "hits_delta",
    )


_REFS = "SELECT DISTINCT lang AS project, unnest([doc_id, doc_id + 4]) AS commit_id FROM documents WHERE doc_id % 7 = 0"


@query("l02_label_table", f"""WITH {TFIDF_CTE}, refs AS ({_REFS})
SELECT d.doc_id AS commit_id, CASE WHEN d.doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS source, CASE WHEN max(r.commit_id) IS NULL THEN 0 ELSE 1 END AS flagged,
  {', '.join(f"round(coalesce(max(CASE WHEN place = {i} THEN w / norm END), 0), 6) AS w{i}" for i in range(1, 5))}
FROM documents d LEFT JOIN wt ON wt.doc_id = d.doc_id LEFT JOIN nm ON nm.doc_id = d.doc_id LEFT JOIN refs r ON r.project = d.lang AND r.commit_id = d.doc_id GROUP BY d.doc_id""")
def label_table(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("commit_id"), F.col("lang").alias("project"), "text", F.col("n_chars").alias("day"))
    advisories = docs.filter("commit_id % 7 = 0").select("project", F.concat(F.col("commit_id"), F.lit(" "), F.col("commit_id") + 4).alias("introduced_commits"))
    done = docs.filter("commit_id % 3 = 0").withColumn("source", F.lit("old"))
    out = tbl.label_table(docs.withColumn("source", F.lit("new")), advisories, done, message="text", k=4, stop_words=TFIDF_STOP)
    return out.select("commit_id", "source", "flagged", *[F.round(f"w{i}", 6).alias(f"w{i}") for i in range(1, 5)])


@query("l03_detection_table", """
SELECT l.l_orderkey AS issue_id, l.l_partkey AS part, l.l_linenumber AS line, CASE WHEN o.o_orderkey % 5 < 4 THEN CAST(floor(date_diff('second', o.o_orderdate, l.l_shipdate + INTERVAL 6 HOUR) / 86400) AS BIGINT) END AS days
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def detection_table(spark, sf):
    lines = load(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    row = F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"))
    advisories = lines.select(
        row.alias("issue_id"), k.alias("order_key"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"),
        F.when(k % 2 == 0, "https://host.org/own/lib.git").otherwise("git@host.org:Own/Lib").alias("repo"),
        F.when(k % 5 < 4, F.concat(F.lit("c"), k, F.lit(";d"), k)).otherwise("--").alias("introduced_commits"),
    )
    issues = lines.select(row.alias("issue"), (F.col("l_shipdate") + F.expr("INTERVAL 6 HOURS")).alias("reported")).distinct()
    commits = load(spark, sf, "orders").select(
        F.lit("https://host.org/own/lib/").alias("repo"), F.concat(F.lit("c"), "o_orderkey").alias("sha"), F.col("o_orderdate").alias("committed")
    )
    return tbl.detection_table(advisories, issues, commits).select(F.col("order_key").alias("issue_id"), "part", "line", "days")


UNITS_ONLY = f"""{s.DETECTIONS_CTE},
units AS (SELECT d.project, commit_day, order_no, line_no, part_no, days, rate, issue_id, introduced, CASE WHEN rate > 0 THEN days * rate ELSE CAST(days AS DOUBLE) END AS units
  FROM detections d LEFT JOIN rates r ON d.project = r.project WHERE days >= 0)"""


@query("l04_baseline_and_targets", f"""WITH {s.RATES_CTE}, {UNITS_ONLY},
b AS (SELECT d.project, coalesce(quantile_cont(days * rate, 0.5), 0) AS units, quantile_cont(days, 0.5) AS days, coalesce(max(rate), 0) AS rate FROM detections d LEFT JOIN rates r ON d.project = r.project WHERE days >= 0 GROUP BY 1)
SELECT 'baseline' AS kind, project, CAST(NULL AS VARCHAR) AS target_id, CASE WHEN units > 0 THEN units WHEN days * rate > 0 THEN days * rate WHEN days > 0 THEN days ELSE 'inf'::DOUBLE END AS amount FROM b
UNION ALL SELECT 'target', project, CASE WHEN issue_id <> '' THEN issue_id WHEN trim(introduced) <> '' THEN 'introduced:' || introduced ELSE 'row_' || order_no END, units FROM units""")
def baseline_and_targets(spark, sf):
    found, rates = s.detections(spark, sf), s.rates(spark, sf)
    base = dt.threshold_map(dt.baseline_metrics(found, rates))
    targets = dt.detection_targets(found, rates, ["issue_id"], "introduced", "order_no")
    a = base.select(F.lit("baseline").alias("kind"), "project", F.lit(None).cast("string").alias("target_id"), F.col("threshold").alias("amount"))
    return a.unionByName(targets.select(F.lit("target").alias("kind"), "project", "target_id", F.col("target").alias("amount")))


_Q = "quantile_cont(u.units, 0.5) AS med, quantile_cont(u.units, 0.25) AS q1, quantile_cont(u.units, 0.75) AS q3"
STATS_CTE = f"""{LABELLED_CTE}, {UNITS_ONLY},
fs AS (SELECT w.project, w.fold, {_Q} FROM (SELECT DISTINCT project, fold, train_start, train_end FROM labelled WHERE is_flagged AND fold IS NOT NULL) w
  JOIN units u ON u.project = w.project AND u.commit_day BETWEEN w.train_start AND w.train_end GROUP BY ALL),
ps AS (SELECT u.project, {_Q} FROM units u GROUP BY 1), gs AS (SELECT {_Q} FROM units u),
os AS (SELECT p.project, {_Q} FROM (SELECT DISTINCT project FROM labelled) p JOIN units u ON u.project <> p.project GROUP BY 1),
st AS (SELECT l.*, coalesce(fs.med, ps.med, gs.med) AS med, CASE WHEN fs.med IS NOT NULL THEN fs.q1 WHEN ps.med IS NOT NULL THEN ps.q1 ELSE gs.q1 END AS q1,
    CASE WHEN fs.med IS NOT NULL THEN fs.q3 WHEN ps.med IS NOT NULL THEN ps.q3 ELSE gs.q3 END AS q3,
    CASE WHEN fs.med IS NOT NULL THEN 'fold' WHEN ps.med IS NOT NULL THEN 'project' ELSE 'global' END AS src, 'per_project' AS mode
  FROM labelled l LEFT JOIN fs ON fs.project = l.project AND fs.fold = l.fold LEFT JOIN ps ON ps.project = l.project, gs WHERE is_flagged
  UNION ALL SELECT l.*, os.med, os.q1, os.q3, 'others', 'cross_project' FROM labelled l JOIN os ON os.project = l.project WHERE is_flagged)"""


def _both_modes(spark, sf, budget, columns, **options):
    # the tables that all strategies share are written once
    days, found, rates = settle(labelled(spark, sf), "labelled"), settle(s.detections(spark, sf), "detections"), s.rates(spark, sf)
    parts = [budget(days, found, rates, mode=m, **options).select(F.lit(m).alias("mode"), "project", F.col("day").cast("string").alias("day"), *columns) for m in bd.MODES]
    return parts[0].unionByName(parts[1])


@query("l05_median_budget", f"""WITH {STATS_CTE}
SELECT mode, project, CAST(day AS VARCHAR) AS day, med AS median, src AS stat_source, CAST(ceil(med) AS BIGINT) AS scheduled FROM st WHERE (mode = 'cross_project' OR fold IS NOT NULL) AND rate > 0 AND ceil(med) > 0""")
def median_budget(spark, sf):
    return _both_modes(spark, sf, bd.median_budget, ["median", "stat_source", "scheduled"])


@query("l06_iqr_budget", f"""WITH {STATS_CTE}, d AS (SELECT *, q1 + CAST(('0x' || substr(md5(project || '::' || CASE WHEN mode = 'per_project' THEN fold ELSE '-' END || '::' || day_index || '::42'), 1, 8)) AS BIGINT) / 4294967296.0 * (q3 - q1) AS v FROM st WHERE mode = 'cross_project' OR fold IS NOT NULL)
SELECT mode, project, CAST(day AS VARCHAR) AS day, q1, q3, round(v, 6) AS sampled, CAST(ceil(v) AS BIGINT) AS scheduled FROM d WHERE ceil(v) > 0""")
def iqr_budget(spark, sf):
    out = _both_modes(spark, sf, bd.iqr_budget, ["q1", "q3", "sampled", "scheduled"])
    return out.withColumn("sampled", F.round("sampled", 6))


_CHURN_CTE = f"""{STATS_CTE},
past AS (SELECT project, day, quantile_cont(CASE WHEN is_flagged THEN coalesce(churn, 0) END, 0.5) OVER (PARTITION BY project ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM labelled),
e AS (SELECT st.*, base, med * CASE WHEN base > 0 THEN least(ln(1 + coalesce(churn, 0)) / ln(1 + base), 3.0) ELSE 1 END AS expected FROM st JOIN past ON past.project = st.project AND past.day = st.day)"""


@query("l07_churn_budget", f"""WITH {_CHURN_CTE}
SELECT mode, project, CAST(day AS VARCHAR) AS day, base AS past_churn, round(expected, 6) AS expected, CAST(ceil(expected - 1e-9) AS BIGINT) AS scheduled, CAST(NOT coalesce(base > 0, false) AS INTEGER) AS no_past
FROM e WHERE med > 0 AND ceil(expected - 1e-9) > 0""")
def churn_budget(spark, sf):
    out = _both_modes(spark, sf, bd.churn_budget, ["past_churn", "expected", "scheduled", "no_past_churn"], cap=3.0)
    return out.withColumns({"expected": F.round("expected", 6), "no_past": F.col("no_past_churn").cast("int")}).drop("no_past_churn")


def _attribution_cte(window: int) -> str:
    days = f"least(date_diff('day', f, day), {window} + 1)" if window else "date_diff('day', f, day)"
    expired = f"rate > 0 AND prev IS NOT NULL AND greatest(f + 1, prev - {window}) < day - {window}" if window else "false"
    return f"""{s.SCORED_CTE}, {s.RATES_CTE}, {UNITS_ONLY},
sch AS (SELECT 'a' AS strategy, project, day, added * 10 AS scheduled FROM scored WHERE flagged = 1 AND project <> 'p9' UNION ALL SELECT 'b', project, day, deleted * 150 FROM scored WHERE risk >= 0.7),
tg AS (SELECT project, units AS b, count(*) AS n FROM units WHERE project <> 'p4' GROUP BY ALL),
e0 AS (SELECT strategy, s.project, day, scheduled, coalesce(rate, 0) AS rate, row_number() OVER w AS no, min(day) OVER w AS f, lag(day) OVER w AS prev FROM sch s JOIN rates r ON s.project = r.project WINDOW w AS (PARTITION BY strategy, s.project ORDER BY day)),
e1 AS (SELECT *, rate * {days} AS progress, {expired} AS exp_flag FROM e0), e AS (SELECT *, progress + scheduled AS reach FROM e1),
h AS (SELECT x.strategy, x.project, tg.b, tg.n, min(e.no) AS hit FROM (SELECT DISTINCT strategy, project FROM e) x JOIN tg ON tg.project = x.project LEFT JOIN e ON e.strategy = x.strategy AND e.project = x.project AND e.reach + 1e-9 >= tg.b GROUP BY ALL),
hk AS (SELECT h.*, CASE WHEN e.progress IS NOT NULL AND e.progress + 1e-9 < h.b THEN 1 ELSE 0 END AS extra FROM h LEFT JOIN e ON e.strategy = h.strategy AND e.project = h.project AND e.no = h.hit),
pe AS (SELECT strategy, project, hit, sum(extra) AS nx, sum(n - extra) AS nb, max(CASE WHEN extra = 1 THEN b END) AS top FROM hk WHERE hit IS NOT NULL GROUP BY ALL),
op AS (SELECT e.strategy, e.project, e.no, min(hk.b) AS threshold FROM e JOIN hk ON hk.strategy = e.strategy AND hk.project = e.project AND (hk.hit IS NULL OR hk.hit > e.no OR (hk.hit = e.no AND hk.extra = 1)) GROUP BY ALL),
ev AS (SELECT e.strategy, e.project, e.day, e.no, coalesce(op.threshold, 'inf'::DOUBLE) AS threshold, e.scheduled, CASE WHEN coalesce(nx, 0) > 0 THEN least(top - progress, scheduled) ELSE 0 END AS consumed, coalesce(nx, 0) AS nx, coalesce(nb, 0) AS nb, progress, reach,
  CASE WHEN e.project NOT IN (SELECT project FROM tg) THEN 'fp' WHEN op.threshold IS NULL THEN 'baseline_only' WHEN coalesce(nx, 0) > 0 THEN 'tp' WHEN exp_flag THEN 'expired' ELSE 'fp' END AS classification
  FROM e LEFT JOIN pe ON pe.strategy = e.strategy AND pe.project = e.project AND pe.hit = e.no LEFT JOIN op ON op.strategy = e.strategy AND op.project = e.project AND op.no = e.no)"""


def _schedules(spark, sf):
    daily = settle(s.scored(spark, sf), "scored")
    a = daily.filter("flagged = 1 AND project <> 'p9'").select(F.lit("a").alias("strategy"), "project", "day", (F.col("added") * 10).alias("scheduled"))
    b = daily.filter("risk >= 0.7").select(F.lit("b").alias("strategy"), "project", "day", (F.col("deleted") * 150).alias("scheduled"))
    targets = dt.detection_units(s.detections(spark, sf), s.rates(spark, sf)).filter("project <> 'p4'").select("project", F.col("units").alias("target"))
    return a.unionByName(b).withColumn("event_id", F.lit(0)), targets, s.rates(spark, sf)


_EVENT_SQL = """SELECT strategy, project, CAST(day AS VARCHAR) AS day, threshold, scheduled::DOUBLE AS scheduled, consumed::DOUBLE AS consumed, (scheduled - consumed)::DOUBLE AS wasted, classification,
  CAST(nx AS BIGINT) AS detections_count, CAST(nb AS BIGINT) AS baseline_detections_count, progress::DOUBLE AS progress, reach::DOUBLE AS reach,
  CASE WHEN nx > 0 THEN CAST(sum(nx + nb) OVER (PARTITION BY strategy, project ORDER BY no) AS BIGINT) END AS detection_id FROM ev"""


def _attributed(spark, sf, window):
    out = at.crossing_attribution(*_schedules(spark, sf), window=window)
    return out.select(
        "strategy", "project", F.col("day").cast("string").alias("day"), "threshold", "scheduled", "consumed", "wasted", "classification",
        F.col("detections_count").cast("bigint").alias("detections_count"), "baseline_detections_count", "progress", "reach", "detection_id",
    )


@query("l08_crossing_attribution", f"WITH {_attribution_cte(0)} {_EVENT_SQL}")
def crossing_attribution(spark, sf):
    return _attributed(spark, sf, 0)


@query("l08_crossing_attribution_window", f"WITH {_attribution_cte(30)} {_EVENT_SQL}")
def crossing_attribution_window(spark, sf):
    return _attributed(spark, sf, 30)


@query("l08_attribution_summary", f"""WITH {_attribution_cte(30)}, tc AS (SELECT project, sum(n) AS n FROM tg GROUP BY 1),
pp AS (SELECT ev.strategy, ev.project, count(*) FILTER (WHERE classification <> 'baseline_only') AS trig, count(*) FILTER (WHERE classification = 'tp') AS hit, count(*) FILTER (WHERE classification = 'expired') AS ex,
  sum(nx) AS nx, sum(nb) AS nb, sum(scheduled) AS sc, sum(consumed) AS co, count(*) FILTER (WHERE classification <> 'tp') AS miss FROM ev GROUP BY ALL)
SELECT strategy, CAST(sum(trig) AS BIGINT) AS triggers_total, CAST(sum(hit) AS BIGINT) AS success_triggers, CAST(sum(ex) AS BIGINT) AS expired_triggers, CAST(sum(nx) AS BIGINT) AS detections_additional,
  CAST(sum(nb) AS BIGINT) AS detections_baseline, sum(sc)::DOUBLE AS units_total, sum(co)::DOUBLE AS units_success, sum(sc - co)::DOUBLE AS units_wasted, count(*) AS projects, count(*) FILTER (WHERE hit > 0) AS projects_with_success,
  count(*) FILTER (WHERE miss > 0) AS projects_with_waste, CAST(sum(coalesce(tc.n, 0)) AS BIGINT) AS targets_total, round(sum(hit)::DOUBLE / sum(trig), 6) AS success_ratio, round(sum(co)::DOUBLE / sum(sc), 6) AS units_success_ratio
FROM pp LEFT JOIN tc ON tc.project = pp.project GROUP BY 1""")
def attribution_summary(spark, sf):
    schedules, targets, rates = _schedules(spark, sf)
    out = at.attribution_summary(at.crossing_attribution(schedules, targets, rates, window=30), targets)
    keep = ["strategy", "triggers_total", "success_triggers", "expired_triggers", "detections_additional", "detections_baseline", "units_total", "units_success", "units_wasted"]
    return out.select(
        *keep, "projects", "projects_with_success", "projects_with_waste", "targets_total", F.round("success_ratio", 6).alias("success_ratio"), F.round("units_success_ratio", 6).alias("units_success_ratio")
    ).withColumn("detections_additional", F.col("detections_additional").cast("bigint"))


_DATASET = f"""{LABELLED_CTE}, {s.DETECTIONS_CTE}, dd AS (SELECT project, commit_day AS day, sum(days) AS days FROM detections GROUP BY ALL),
ds AS (SELECT l.project, l.day, l.fold, l.rate, coalesce(l.churn, 0) AS churn, CAST(greatest(coalesce(days, 0) * l.rate, 0) AS BIGINT) AS observed FROM labelled l LEFT JOIN dd ON dd.project = l.project AND dd.day = l.day WHERE is_flagged AND fold IS NOT NULL)"""


@query("l09_regression_budget_simple", f"""WITH {_DATASET}, fit AS (SELECT p.project, regr_slope(observed, churn) AS b, regr_intercept(observed, churn) AS a FROM (SELECT DISTINCT project FROM ds) p JOIN ds ON ds.project <> p.project GROUP BY 1)
SELECT ds.project, CAST(day AS VARCHAR) AS day, observed, round(a + b * churn, 4) AS raw, CAST(ceil(round(greatest(a + b * churn, 0), 6)) AS BIGINT) AS scheduled FROM ds JOIN fit ON ds.project = fit.project""")
def regression_budget_simple(spark, sf):
    out = bd.regression_budget(settle(labelled(spark, sf), "labelled"), s.detections(spark, sf), ["churn"], digits=6)
    return out.select("project", F.col("day").cast("string").alias("day"), "observed", F.round("raw", 4).alias("raw"), "scheduled")


# Three features by Cramer's rule on the centred moments of the training projects.
@query("l09_regression_budget_multi", f"""WITH {LABELLED_CTE}, {s.DETECTIONS_CTE}, dd AS (SELECT project, commit_day AS day, sum(days) AS days FROM detections GROUP BY ALL),
ds AS (SELECT l.project, l.day, l.rate::DOUBLE AS rate, l.day_index::DOUBLE AS place, coalesce(l.churn, 0)::DOUBLE AS churn, CAST(greatest(coalesce(days, 0) * l.rate, 0) AS BIGINT) AS observed
  FROM labelled l LEFT JOIN dd ON dd.project = l.project AND dd.day = l.day WHERE is_flagged AND fold IS NOT NULL),
tr AS (SELECT project FROM (SELECT project, row_number() OVER (ORDER BY md5(project || '::42'), project) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT project FROM ds)) WHERE r <= greatest(floor(n * 0.8), 1)),
m AS (SELECT avg(churn) AS m1, avg(rate) AS m2, avg(place) AS m3, avg(observed) AS my, covar_pop(churn, churn) AS a, covar_pop(churn, rate) AS b, covar_pop(churn, place) AS c, covar_pop(rate, rate) AS d, covar_pop(rate, place) AS e, covar_pop(place, place) AS f,
  covar_pop(observed, churn) AS p, covar_pop(observed, rate) AS q, covar_pop(observed, place) AS r FROM ds JOIN tr USING (project)),
k AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
w AS (SELECT *, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS w1, (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / det AS w2, (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det AS w3 FROM k),
o AS (SELECT project, day, observed, my + w1 * (churn - m1) + w2 * (rate - m2) + w3 * (place - m3) AS raw FROM ds, w)
SELECT project, CAST(day AS VARCHAR) AS day, observed, round(raw, 4) AS raw, CAST(ceil(round(greatest(raw, 0), 6)) AS BIGINT) AS scheduled FROM o""")
def regression_budget_multi(spark, sf):
    out = bd.regression_budget(settle(labelled(spark, sf), "labelled"), s.detections(spark, sf), ["churn", "rate", "day_index"], evaluation="random_split", digits=6)
    return out.select("project", F.col("day").cast("string").alias("day"), "observed", F.round("raw", 4).alias("raw"), "scheduled")


@query("l10_leave_one_out_caps", f"""WITH {s.SCORED_CTE}, t AS (SELECT project, CAST(sum(CASE WHEN project IN ('p1', 'p7') THEN 0 ELSE added END) AS BIGINT) AS total FROM scored GROUP BY 1)
SELECT a.project, a.total, round(coalesce((SELECT avg(b.total) FROM t b WHERE b.project <> a.project AND b.total > 0), a.total), 6) AS cap FROM t a""")
def leave_one_out_caps(spark, sf):
    totals = s.scored(spark, sf).groupBy("project").agg(F.sum(F.when(F.col("project").isin("p1", "p7"), 0).otherwise(F.col("added"))).alias("total"))
    return bd.leave_one_out_caps(totals).withColumn("cap", F.round("cap", 6))


_BASE = """bl AS (SELECT d.project, coalesce(quantile_cont(days * rate, 0.5), 0) AS bu, quantile_cont(days, 0.5) AS bd, coalesce(max(rate), 0) AS rate FROM detections d LEFT JOIN rates r ON d.project = r.project WHERE days >= 0 GROUP BY 1)"""


@query("l11_compare_strategies", f"""WITH {s.SCORED_CTE}, {s.RATES_CTE}, {s.DETECTIONS_CTE}, {_BASE},
sch AS (SELECT 'early' AS strategy, project, day, added AS scheduled FROM scored WHERE risk >= 0.5 AND day < DATE '1998-01-01' UNION ALL SELECT 'late', project, day, added FROM scored WHERE risk >= 0.5 AND day >= DATE '1998-01-01'),
pj AS (SELECT strategy, s.project, CAST(sum(scheduled) AS DOUBLE) AS sc, max(coalesce(b.rate, 0)) AS rate, max(coalesce(bd, 0)) AS bd, max(coalesce(bu, 0)) AS bu FROM sch s LEFT JOIN bl b ON b.project = s.project GROUP BY ALL),
es AS (SELECT *, CASE WHEN rate > 0 THEN greatest(bd - sc / rate, 0) ELSE bd END AS ed, greatest(bu - sc, 0) AS eu FROM pj)
SELECT strategy, count(*) AS projects, CAST(sum(sc) AS BIGINT) AS total_scheduled, quantile_cont(sc, 0.5) AS median_scheduled, round(avg(sc), 6) AS mean_scheduled, round(quantile_cont(ed, 0.5), 6) AS median_days, round(avg(ed), 6) AS mean_days,
  round(quantile_cont(eu, 0.5), 6) AS median_units, round(avg(eu), 6) AS mean_units, round(sum(bu - eu), 4) AS units_saved FROM es GROUP BY 1""")
def compare_strategies(spark, sf):
    plan = _plan(spark, sf).withColumn("scheduled", F.col("added"))
    cut = F.lit("1998-01-01").cast("date")
    schedules = cp.union_schedules({"early": plan.filter(F.col("day") < cut), "late": plan.filter(F.col("day") >= cut)})
    base = dt.baseline_metrics(s.detections(spark, sf), s.rates(spark, sf))
    out = cp.compare_strategies(schedules, base)["overall"]
    rounded = ["mean_scheduled", "median_days", "mean_days", "median_units", "mean_units"]
    return out.withColumns({**{c: F.round(c, 6) for c in rounded}, "units_saved": F.round("units_saved", 4)})


_SWEEP_TARGETS = [0.02, 0.3]


@query("l12_threshold_sweep", f"""WITH {TIMELINE_CTE}, {CURVE_CTE}, {UNITS_ONLY}, os AS (SELECT p.project, quantile_cont(u.units, 0.5) AS med FROM (SELECT DISTINCT project FROM scored) p JOIN units u ON u.project <> p.project GROUP BY 1),
th AS (SELECT t AS target, max(threshold) AS threshold, arg_max(precision, threshold) AS precision, arg_max(recall, threshold) AS recall, arg_max(tp, threshold) AS tp, arg_max(fp, threshold) AS fp, arg_max(fn, threshold) AS fn
  FROM (SELECT unnest({_SWEEP_TARGETS!r})::DOUBLE AS t) JOIN pr ON precision >= t GROUP BY 1)
SELECT 'median' AS strategy, target AS precision_target, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, max(tp) AS tp, max(fp) AS fp, max(fn) AS fn, count(*) AS rows, count(DISTINCT tl.project) AS unique_projects,
  count(DISTINCT tl.day) AS unique_days, CAST(sum(ceil(med)) AS BIGINT) AS scheduled, round(1 - precision, 6) AS false_positive_rate
FROM th JOIN scored s ON s.risk >= th.threshold JOIN timeline tl ON tl.project = s.project AND tl.day = s.day JOIN os ON os.project = s.project WHERE tl.rate > 0 AND ceil(med) > 0 GROUP BY target, threshold, precision, recall""")
def threshold_sweep(spark, sf):
    rows = settle(s.scored(spark, sf), "scored")
    scores = rows.select("project", "day", F.col("risk").alias("predicted_risk_x"))
    days = tl.labelled_timeline(timeline(spark, sf, rows), scores, "predicted_risk_x")
    curve = curves.precision_recall(rows, "risk", "flagged")
    sweep = sw.threshold_sweep(curve, _SWEEP_TARGETS, days, settle(s.detections(spark, sf), "detections"), s.rates(spark, sf), strategies=["median"], mode="cross_project")
    sweep = sweep.drop("step", "median_mean", "sampled_mean", "weight_mean", "predicted_sum")
    out = cp.low_precision_rows(sweep, _SWEEP_TARGETS[0]).unionByName(cp.low_precision_rows(sweep, _SWEEP_TARGETS[1]))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "false_positive_rate")})


_RESULT_NAMES = {"1-URGENT": "median", "2-HIGH": "iqr", "3-MEDIUM": "churn", "4-NOT SPECIFIED": "regression"}


@query("l13_result_table", """
WITH x AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'S1' WHEN '2-HIGH' THEN 'S2' WHEN '3-MEDIUM' THEN 'S3' WHEN '4-NOT SPECIFIED' THEN 'S4' END AS label, CAST(sum(o_custkey) AS DOUBLE) AS cost,
  CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS found, count(*) AS total FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
r AS (SELECT * FROM x UNION ALL SELECT 'S5', cost * 2, found, total FROM x WHERE label = 'S4')
SELECT label, cost, found, found || ' / ' || total AS found_of, round(found::DOUBLE / total * 100, 2) AS hit_rate, round(cost / found, 2) AS cost_per_hit, round(100.0 * ((SELECT cost FROM r WHERE label = 'S1') - cost) / (SELECT cost FROM r WHERE label = 'S1'), 2) AS reduction FROM r ORDER BY label""")
def result_table(spark, sf):
    names = F.create_map(*[F.lit(x) for pair in _RESULT_NAMES.items() for x in pair])
    simple = load(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'").groupBy(F.try_element_at(names, F.col("o_orderpriority")).alias("strategy")).agg(
        F.sum("o_custkey").alias("units_total"), F.count_if(F.col("o_orderstatus") == "F").alias("detections_additional"), F.count("*").alias("targets_total")
    )
    simple = simple.withColumn("success_ratio", F.col("detections_additional") / F.col("targets_total"))
    multi = simple.withColumn("units_total", F.col("units_total") * 2)
    return cp.result_table(cp.combine_results(simple, multi))


@query("l14_build_timeline", f"""WITH {s.SCORED_CTE}, {s.RATES_CTE}
SELECT s.project, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days, CAST(count(*) * max(coalesce(rate, 0)) AS BIGINT) AS cumulative_units FROM scored s JOIN rates r ON s.project = r.project GROUP BY 1""")
def build_timeline(spark, sf):
    table = tl.build_timeline(s.scored(spark, sf).select("project", "day"), s.rates(spark, sf))
    out = wn.timeline_summary(table)
    return out.select("project", F.col("last_day").cast("string").alias("last_day"), F.col("day_index").cast("bigint").alias("days"), "cumulative_units")


@query("l15_compare_models", """
WITH m AS (SELECT c_mktsegment AS model, 'p' || c_nationkey AS project, count(*) AS n, round(CAST(count(*) FILTER (WHERE c_acctbal > 0) AS DOUBLE) / count(*), 4) AS share FROM customer GROUP BY ALL),
c AS (SELECT * FROM m WHERE project IN (SELECT project FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT model) FROM m))),
lg AS (SELECT model, project, 'precision' AS metric, share AS value FROM c UNION ALL SELECT model, project, 'recall', 0.5 FROM c UNION ALL SELECT model, project, 'mcc', share / 2 FROM c WHERE n % 5 <> 0),
tp AS (SELECT model, value, row_number() OVER (PARTITION BY model ORDER BY value DESC, project) AS r FROM lg WHERE metric = 'precision')
SELECT lg.model, metric, round(avg(value), 6) AS mean_value, (SELECT count(DISTINCT project) FROM lg l2 WHERE l2.model = lg.model) AS project_count, round(max(t.top_mean), 6) AS top_mean
FROM lg JOIN (SELECT model, avg(value) AS top_mean FROM tp WHERE r <= 5 GROUP BY 1) t ON t.model = lg.model GROUP BY lg.model, metric""")
def compare_models(spark, sf):
    path = qa.experiments(spark, sf)
    metrics = rd.read_experiment_metrics(spark, f"{path}/metrics", multi_line=False)
    importances = rd.read_importances(spark, f"{path}/importances")
    out = cp.compare_models(metrics, importances, s.scored(spark, sf), ["precision", "recall", "mcc"], top_n=5)
    joined = out["means"].join(out["best_means"], "model")
    return joined.withColumns({c: F.round(c, 6) for c in ("mean_value", "top_mean")})


@query("l16_dataset_funnel", f"""WITH {s.DETECTIONS_CTE}, md AS (SELECT 'p' || n_nationkey AS project, n_regionkey AS repo FROM nation WHERE n_nationkey % 3 < 2),
fd AS (SELECT 'p' || s_nationkey AS project, min(CAST(l_shipdate AS DATE)) AS day FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate >= DATE '1997-01-01' GROUP BY 1),
r AS (SELECT repo, d.project, commit_day >= fd.day AS ok FROM detections d LEFT JOIN md ON md.project = d.project LEFT JOIN fd ON fd.project = d.project),
s2 AS (SELECT * FROM r WHERE repo IS NOT NULL AND project NOT IN ('p0', 'p6')), s3 AS (SELECT * FROM s2 WHERE repo IN (SELECT repo FROM s2 GROUP BY 1 HAVING count(*) >= 100))
SELECT (SELECT count(*) FROM r) AS total_issues, (SELECT count(*) FROM r WHERE repo IS NOT NULL) AS known_issues, (SELECT count(DISTINCT repo) FROM r) AS known_repos, (SELECT count(*) FROM s2) AS cloned_issues,
  (SELECT count(DISTINCT repo) FROM s2) AS cloned_repos, (SELECT count(*) FROM s3) AS enough_issues, (SELECT count(DISTINCT repo) FROM s3) AS enough_repos, (SELECT count(*) FROM s3 WHERE ok) AS final_issues,
  round((SELECT count(*) FROM r WHERE repo IS NOT NULL) * 100.0::DOUBLE / (SELECT count(*) FROM r), 6) AS known_percent""")
def dataset_funnel(spark, sf):
    nation = load(spark, sf, "nation")
    k = F.col("n_nationkey")
    language = F.when(k % 3 == 0, "C").when(k % 3 == 1, " c++ ").otherwise("go")
    metadata = nation.select(F.concat(F.lit("p"), k).alias("project"), language.alias("language"), F.col("n_regionkey").alias("main_repo"))
    cloned = metadata.filter(~F.col("project").isin("p0", "p6")).select("project")
    coverage = s.lines_by_project(spark, sf, "l_shipdate").select("project", F.to_date("l_shipdate").alias("day"))
    advisories = s.detections(spark, sf).select("project", F.col("commit_day").alias("published"))
    out = cp.dataset_funnel(metadata, advisories, cloned, coverage, ["c", "c++"], 100, start=F.lit("1997-01-01").cast("date"))
    return out.withColumn("known_percent", F.round("known_percent", 6))


@query("l16_per_project_statistics", f"""WITH {s.DETECTIONS_CTE}, dy AS (SELECT 'p' || s_nationkey AS project, CAST(l_shipdate AS DATE) AS day, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hit FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
t AS (SELECT project, count(DISTINCT CASE WHEN issue_id <> '' THEN issue_id WHEN trim(introduced) <> '' THEN 'introduced:' || introduced ELSE 'row_' || order_no END) AS targets FROM detections GROUP BY 1)
SELECT dy.project, count(*) AS total_days, CAST(sum(hit) AS BIGINT) AS days_with, CAST(min(day) AS VARCHAR) AS first_day, coalesce(max(targets), 0) AS targets FROM dy LEFT JOIN t ON t.project = dy.project GROUP BY 1""")
def per_project_statistics(spark, sf):
    days = s.lines_by_project(spark, sf, "l_shipdate", "l_returnflag").select(
        "project", F.to_date("l_shipdate").alias("day"), (F.col("l_returnflag") == "R").cast("int").alias("flag")
    )
    targets = fn.distinct_targets(s.detections(spark, sf).withColumn("id", tx.stable_id(["issue_id"], "introduced", "order_no")))
    out = fn.day_flag_totals(days).filter("project <> 'all'").join(fn.report_totals(days), "project").join(targets, "project", "left")
    return out.select("project", "total_days", "days_with", F.col("first_day").cast("string").alias("first_day"), F.coalesce("ids", F.lit(0)).alias("targets"))


@query("l17_advisory_table", """
SELECT CAST(o_custkey AS BIGINT) AS issue_id, 'A-' || o_orderkey AS advisory_id, 'p' || (o_orderkey % 25) AS package, 'i' || o_orderkey || ';j' || o_orderkey AS introduced_commits, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS published
FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' ORDER BY 1, 2""")
def advisory_table(spark, sf):
    path = scratch_path(spark, "advisory")
    wr.write_json(advisory_json(spark, sf), path, "raw")
    start, end = (F.lit(t).cast("timestamp") for t in ("1996-01-01", "1999-12-31 12:00:00"))
    out = tbl.advisory_table(rd.read_advisories(spark, path, multi_line=False), start, end)
    return out.select("issue_id", "advisory_id", "package", "introduced_commits", "published")


@query("l18_coverage_tables", """
SELECT o_orderstatus AS project, strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS date, 'files' AS kind, count(*) AS rows, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines_count, CAST(sum(l_linenumber) AS BIGINT) AS lines_covered, 0::BIGINT AS branches
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL SELECT o_orderstatus, strftime(date_trunc('month', o_orderdate), '%Y%m%d'), 'totals', count(DISTINCT o_orderkey), CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), CAST(sum(l_linenumber) AS BIGINT), 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def coverage_tables(spark, sf):
    files, totals = cv.coverage_tables(rd.read_coverage(spark, qa._coverage_reports(spark, sf), multi_line=False))

    def per_day(df, kind, prefix):
        return df.groupBy("project", "date").agg(
            F.count("*").alias("rows"), F.sum(f"{prefix}lines_count").alias("lines_count"), F.sum(f"{prefix}lines_covered").alias("lines_covered"), F.sum(f"{prefix}branches_count").alias("branches")
        ).withColumn("kind", F.lit(kind))

    return per_day(files, "files", "").unionByName(per_day(totals, "totals", "totals_"))


@query("l19_revision_table", f"""WITH {qa.SRCMAP_CTE}, md AS (SELECT unnest(['F', 'O', 'P']) AS project, unnest(['lib1', 'lib2', 'lib4']) AS lib),
k AS (SELECT s.project, date, CASE WHEN url = 'https://host.org/own/' || lib || '.git' THEN s.project ELSE repo_name END AS repo_name, revision FROM srcmap s JOIN md ON md.project = s.project),
dl AS (SELECT project, date, arg_max(revision, (CAST(substr(revision, 2) AS BIGINT), revision)) AS revision FROM k WHERE repo_name = project GROUP BY ALL)
SELECT * FROM (SELECT project, date, revision, lag(revision) OVER (PARTITION BY project ORDER BY date) AS previous_revision,
  (SELECT count(*) FROM k WHERE k.project = dl.project AND repo_name = k.project) AS kept, (SELECT count(*) FROM k WHERE k.project = dl.project) AS original FROM dl) WHERE previous_revision IS NOT NULL""")
def revision_table(spark, sf):
    maps = rd.read_source_maps(spark, qa.source_maps(spark, sf), whole_files=False)
    libs = F.create_map(*[F.lit(x) for x in ("F", "lib1", "O", "lib2", "P", "lib4")])
    projects = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("project")).distinct()
    projects = projects.withColumn("main_repo", F.concat(F.lit("https://host.org/own/"), F.try_element_at(libs, F.col("project")), F.lit("/")))
    commits = load(spark, sf, "supplier").select(
        F.concat(F.lit("r"), "s_suppkey").alias("revision"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("s_suppkey").cast("int")).cast("timestamp").alias("committed")
    )
    _, counts, pairs = tbl.revision_table(maps, projects, commits)
    return pairs.join(counts, "project").select("project", "date", "revision", "previous_revision", "kept", "original")


def _patches_and_pages(spark, sf):
    """Patches that add document lines at their own numbers, and the coverage pages of most of them."""
    doc = F.col("doc_id")

    def line(text, i):
        n = i + 1
        body = F.when(n % 3 == 0, F.concat(F.lit(" "), text)).when(n % 3 == 1, F.concat(F.lit("+"), text)).otherwise(F.concat(F.lit("-old\n+"), text))
        return F.when(n % 10 == 1, F.concat(F.lit("@@ -1 +"), n, F.lit(",9 @@\n"), body)).otherwise(body)

    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    name = F.concat(F.lit("src/d"), doc % 7, F.lit("/f"), doc, F.lit(".c"))
    date = F.concat(F.lit("2024010"), doc % 9 + 1)
    patch = F.concat(F.lit("diff --git a b\nindex 1..2\n--- a/x\n+++ b/x\n"), text)
    docs = load(spark, sf, "documents").select("doc_id", F.col("source").alias("project"), date.alias("date"), name.alias("path"), patch.alias("patch"))
    named = qa.report_pages(spark, sf).join(docs.drop("patch"), "doc_id").filter("doc_id % 6 <> 0")
    good = named.select("project", "date", F.concat(F.lit("/proj/"), "path", F.lit(".html")).alias("page_path"), "html")
    decoy = named.select("project", "date", F.concat(F.lit("/proj/build/out/"), "path", F.lit(".html")).alias("page_path"), F.lit("<tr></tr>").alias("html"))
    return docs, good.unionByName(decoy)


@query("l20_patch_coverage_table", f"""WITH {qa.DOC_LINES_CTE}, c AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE doc_id % 6 <> 0 AND line_no % 4 IN (1, 2)) AS covered FROM doc_lines WHERE line_no % 3 > 0 GROUP BY 1)
SELECT source AS project, '2024010' || (doc_id % 9 + 1) AS date, 'src/d' || (doc_id % 7) || '/f' || doc_id || '.c' AS path, total AS total_added_lines, covered AS covered_added_lines, round(covered * 100.0::DOUBLE / total, 6) AS patch_coverage
FROM c JOIN documents USING (doc_id) WHERE doc_id % 9 <> 8""")
def patch_coverage_table(spark, sf):
    docs, pages = _patches_and_pages(spark, sf)
    done = docs.filter("date = '20240109'").select("project", "date")
    out = cv.patch_coverage_table(docs.drop("doc_id"), pages, done)
    return out.withColumn("patch_coverage", F.round("patch_coverage", 6))


@query("l21_advisory_summary", f"""WITH {_URLS_SQL}, k AS (SELECT id, lower(regexp_replace(rtrim(trim(url), '/'), '\\.git$', '', 'i')) AS repo FROM repos)
SELECT a.id AS project, count(*) AS vulnerability_count FROM k a JOIN k b ON a.repo = b.repo WHERE a.id % 20 = 0 AND b.id % 20 <> 0 GROUP BY 1""")
def advisory_summary(spark, sf):
    urls = repos(spark, sf)
    metadata = urls.filter("id % 20 = 0").select(F.col("id").alias("project"), F.lit("c").alias("language"), F.col("url").alias("main_repo"))
    advisories = urls.filter("id % 20 <> 0").select(F.col("url").alias("repo"))
    return tbl.advisory_summary(metadata, advisories).select("project", "vulnerability_count")


_DS_CTE = _DATASET[len(LABELLED_CTE) :]  # what it adds to the labelled days


@query("n01_named_strategies", f"""WITH {_CHURN_CTE}{_DS_CTE.replace(f", {s.DETECTIONS_CTE}", "") if s.DETECTIONS_CTE in _CHURN_CTE else _DS_CTE},
fit AS (SELECT p.project, regr_slope(observed, ds.churn) AS b, regr_intercept(observed, ds.churn) AS a FROM (SELECT DISTINCT project FROM ds) p JOIN ds ON ds.project <> p.project GROUP BY 1)
SELECT 'median' AS strategy, count(*) AS rows, CAST(sum(ceil(med)) AS BIGINT) AS scheduled FROM st WHERE mode = 'per_project' AND fold IS NOT NULL AND rate > 0 AND ceil(med) > 0
UNION ALL SELECT 'iqr', count(*), CAST(sum(ceil(v)) AS BIGINT) FROM (SELECT q1 + CAST(('0x' || substr(md5(project || '::' || fold || '::' || day_index || '::42'), 1, 8)) AS BIGINT) / 4294967296.0 * (q3 - q1) AS v FROM st WHERE mode = 'per_project' AND fold IS NOT NULL) WHERE ceil(v) > 0
UNION ALL SELECT 'churn', count(*), CAST(sum(ceil(expected - 1e-9)) AS BIGINT) FROM e WHERE mode = 'per_project' AND med > 0 AND ceil(expected - 1e-9) > 0
UNION ALL SELECT 'regression', count(*), CAST(sum(ceil(round(greatest(a + b * ds.churn, 0), 6))) AS BIGINT) FROM ds JOIN fit ON ds.project = fit.project""")
def named_strategies(spark, sf):
    tables = [settle(labelled(spark, sf), "labelled"), settle(s.detections(spark, sf), "detections"), s.rates(spark, sf)]
    options = {"Strategy1": {}, "iqr": {}, "STRATEGY3": {"cap": 3.0}, "regression": {"digits": 6}}
    parts = [bd.run_strategy(name, *tables, **o).select("strategy", "project", "day", "scheduled") for name, o in options.items()]
    return ag.schedule_summary(st.union_all(parts), "scheduled", keys=["strategy"]).select("strategy", "rows", "scheduled")
