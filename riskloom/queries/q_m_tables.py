"""Every table of the composite jobs, on the schedules that the budget strategies really give."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.learning import curves
from riskloom.plans import budgets as bd
from riskloom.plans import comparison as cp
from riskloom.plans import detection as dt
from riskloom.plans import sweep as sw
from riskloom.queries import q_a_sources as qa
from riskloom.queries import q_l_plans as lp
from riskloom.queries import standins as s
from riskloom.queries.q_c_joins import LABELLED_CTE, labelled
from riskloom.queries.registry import SQL, query
from riskloom.session import settle
from riskloom.sources import readers as rd


@query("l09_regression_budget_ceil", f"""WITH {lp._DATASET}, fit AS (SELECT p.project, regr_slope(observed, churn) AS b, regr_intercept(observed, churn) AS a FROM (SELECT DISTINCT project FROM ds) p JOIN ds ON ds.project <> p.project GROUP BY 1),
r AS (SELECT ds.project, CAST(day AS VARCHAR) AS day, observed, a + b * churn AS raw FROM ds JOIN fit ON ds.project = fit.project)
SELECT project, day, observed, round(raw, 4) AS raw, CASE WHEN abs(raw - round(raw)) > 1e-6 THEN CAST(ceil(greatest(raw, 0)) AS BIGINT) END AS scheduled FROM r""")
def regression_budget_ceil(spark, sf):
    """The plain ceil; predictions within 1e-6 of a whole number may go either way and are left open."""
    out = bd.regression_budget(settle(labelled(spark, sf), "labelled"), s.detections(spark, sf), ["churn"])
    clear = F.abs(F.col("raw") - F.round("raw")) > 1e-6
    return out.select("project", F.col("day").cast("string").alias("day"), "observed", F.round("raw", 4).alias("raw"), F.when(clear, F.col("scheduled")).alias("scheduled"))


_STRATEGIES = {"median": "l05_median_budget", "iqr": "l06_iqr_budget", "churn": "l07_churn_budget", "regression": "l09_regression_budget_simple"}
_REAL = " UNION ALL ".join(
    f"SELECT '{name}' AS strategy, project, CAST(day AS DATE) AS day, scheduled FROM ({SQL[q]}){'' if name == 'regression' else chr(32) + 'WHERE mode = ' + repr('per_project')}" for name, q in _STRATEGIES.items()
)
_PROJECTS = f"""WITH sch AS ({_REAL}), {s.RATES_CTE}, {s.DETECTIONS_CTE}, {lp._BASE},
pj AS (SELECT strategy, s.project, count(*) AS rows, count(DISTINCT day) AS unique_days, CAST(sum(scheduled) AS BIGINT) AS scheduled, max(coalesce(b.rate, 0)) AS rate, max(coalesce(bd, 0)) AS bd, max(coalesce(bu, 0)) AS bu
  FROM sch s LEFT JOIN bl b ON b.project = s.project GROUP BY ALL),
es AS (SELECT *, CASE WHEN rate > 0 THEN greatest(bd - scheduled / rate, 0) ELSE bd END AS ed, greatest(bu - scheduled, 0) AS eu FROM pj)"""


def _compared(spark, sf):
    """The four strategies over one labelled timeline, compared."""
    days, found, rates = settle(labelled(spark, sf), "labelled"), settle(s.detections(spark, sf), "detections"), s.rates(spark, sf)
    schedules = {"median": bd.median_budget(days, found, rates), "iqr": bd.iqr_budget(days, found, rates), "churn": bd.churn_budget(days, found, rates, cap=3.0)}
    schedules["regression"] = bd.regression_budget(days, found, ["churn"], digits=6)
    return cp.compare_strategies(settle(cp.union_schedules(schedules), "schedules"), dt.baseline_metrics(found, rates))


@query("l11_real_summary", f"WITH sch AS ({_REAL}) SELECT strategy, count(*) AS rows, count(DISTINCT project) AS unique_projects, count(DISTINCT day) AS unique_days, CAST(sum(scheduled) AS BIGINT) AS scheduled FROM sch GROUP BY 1")
def real_summary(spark, sf):
    return _compared(spark, sf)["summary"]


@query("l11_real_projects", f"""{_PROJECTS}
SELECT strategy, project, rows, unique_days, scheduled, rate, round(bd, 6) AS baseline_days, round(bu, 6) AS baseline_units, round(scheduled / rows, 6) AS per_trigger, round(ed, 6) AS estimated_days, round(eu, 6) AS estimated_units FROM es""")
def real_projects(spark, sf):
    rounded = ["baseline_days", "baseline_units", "per_trigger", "estimated_days", "estimated_units"]
    return _compared(spark, sf)["projects"].withColumns({c: F.round(c, 6) for c in rounded})


@query("l11_real_overall", f"""{_PROJECTS}
SELECT strategy, count(*) AS projects, CAST(sum(scheduled) AS BIGINT) AS total_scheduled, quantile_cont(scheduled, 0.5) AS median_scheduled, round(avg(scheduled), 6) AS mean_scheduled, round(quantile_cont(ed, 0.5), 6) AS median_days, round(avg(ed), 6) AS mean_days,
  round(quantile_cont(eu, 0.5), 6) AS median_units, round(avg(eu), 6) AS mean_units, round(sum(bu - eu), 4) AS units_saved FROM es GROUP BY 1""")
def real_overall(spark, sf):
    rounded = ["mean_scheduled", "median_days", "mean_days", "median_units", "mean_units"]
    return _compared(spark, sf)["overall"].withColumns({**{c: F.round(c, 6) for c in rounded}, "units_saved": F.round("units_saved", 4)})


@query("l11_real_daily", f"WITH sch AS ({_REAL}) SELECT strategy, project, CAST(day AS VARCHAR) AS day, CAST(sum(scheduled) AS BIGINT) AS scheduled FROM sch GROUP BY ALL")
def real_daily(spark, sf):
    return _compared(spark, sf)["daily"].withColumn("day", F.col("day").cast("string"))


# The shipped precision targets, a lower one and one out of reach. The label is rarer at high scores, so that
# precision rises as the threshold falls and the targets are reached at different thresholds.
_TARGETS = [0.02, 0.05, 0.07, 0.08, 0.09, 0.1, 0.9]
_SWEEP = f"""{LABELLED_CTE}, {lp.UNITS_ONLY}, hits AS (SELECT risk, CASE WHEN flagged = 1 AND added % 100 >= 100 * risk THEN 1 ELSE 0 END AS hit FROM scored),
pts AS (SELECT risk AS threshold, sum(hit) AS pos, count(*) AS n FROM hits GROUP BY 1),
pr AS (SELECT threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS sel, CAST(sum(pos) OVER () AS BIGINT) AS total FROM pts WINDOW w AS (ORDER BY threshold DESC)),
th AS (SELECT target, max(threshold) AS threshold, arg_max(tp, threshold) AS tp, arg_max(sel, threshold) AS sel, max(total) AS total FROM (SELECT unnest({_TARGETS!r})::DOUBLE AS target) JOIN pr ON tp::DOUBLE / sel >= target GROUP BY 1),
fl AS (SELECT th.target, l.* EXCLUDE (is_flagged, churn), coalesce(l.churn, 0) AS churn FROM labelled l JOIN th ON l.risk >= th.threshold),
fs AS (SELECT w.project, w.fold, {lp._Q} FROM folds w JOIN units u ON u.project = w.project AND u.commit_day BETWEEN w.train_start AND w.train_end GROUP BY ALL),
ps AS (SELECT u.project, {lp._Q} FROM units u GROUP BY 1), gs AS (SELECT {lp._Q} FROM units u),
os AS (SELECT p.project, {lp._Q} FROM (SELECT DISTINCT project FROM labelled) p JOIN units u ON u.project <> p.project GROUP BY 1)"""
_PER_PROJECT = """st AS (SELECT fl.*, CASE WHEN fs.med IS NOT NULL THEN fs.med WHEN ps.med IS NOT NULL THEN ps.med ELSE gs.med END AS med, CASE WHEN fs.med IS NOT NULL THEN fs.q1 WHEN ps.med IS NOT NULL THEN ps.q1 ELSE gs.q1 END AS q1,
  CASE WHEN fs.med IS NOT NULL THEN fs.q3 WHEN ps.med IS NOT NULL THEN ps.q3 ELSE gs.q3 END AS q3, fl.fold AS draw_fold, fl.fold IS NOT NULL AS placed
  FROM fl LEFT JOIN fs ON fs.project = fl.project AND fs.fold = fl.fold LEFT JOIN ps ON ps.project = fl.project, gs)"""
_CROSS_PROJECT = "st AS (SELECT fl.*, os.med, os.q1, os.q3, '-' AS draw_fold, true AS placed FROM fl JOIN os ON os.project = fl.project)"


def _sweep_sql(statistics: str) -> str:
    return f"""WITH {_SWEEP}, {statistics},
past AS (SELECT target, project, day, quantile_cont(churn, 0.5) OVER (PARTITION BY target, project ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM fl),
dr AS (SELECT *, q1 + CAST(('0x' || substr(md5(project || '::' || draw_fold || '::' || day_index || '::42'), 1, 8)) AS BIGINT) / 4294967296.0 * (q3 - q1) AS v FROM st WHERE placed),
ch AS (SELECT st.*, CASE WHEN base > 0 THEN least(ln(1 + churn) / ln(1 + base), 3.0) ELSE 1 END AS weight FROM st JOIN past USING (target, project, day) WHERE med > 0),
dd AS (SELECT project, commit_day AS day, sum(days) AS days FROM detections GROUP BY ALL),
ds AS (SELECT fl.target, fl.project, fl.day, fl.churn, CAST(greatest(coalesce(days, 0) * fl.rate, 0) AS BIGINT) AS observed FROM fl LEFT JOIN dd ON dd.project = fl.project AND dd.day = fl.day WHERE fold IS NOT NULL),
fit AS (SELECT p.target, p.project, regr_slope(observed, churn) AS b, regr_intercept(observed, churn) AS a FROM (SELECT DISTINCT target, project FROM ds) p JOIN ds ON ds.target = p.target AND ds.project <> p.project GROUP BY ALL),
sch AS (SELECT 'median' AS strategy, target, project, day, ceil(med) AS scheduled, med AS median, NULL::DOUBLE AS sampled, NULL::DOUBLE AS weight, NULL::DOUBLE AS raw FROM st WHERE placed AND rate > 0 AND ceil(med) > 0
  UNION ALL SELECT 'iqr', target, project, day, ceil(v), med, v, NULL, NULL FROM dr WHERE ceil(v) > 0
  UNION ALL SELECT 'churn', target, project, day, ceil(med * weight - 1e-9), med, NULL, weight, NULL FROM ch WHERE ceil(med * weight - 1e-9) > 0
  UNION ALL SELECT 'regression', ds.target, ds.project, day, ceil(round(greatest(a + b * churn, 0), 6)), NULL, NULL, NULL, a + b * churn FROM ds JOIN fit ON fit.target = ds.target AND fit.project = ds.project),
su AS (SELECT strategy, target, count(*) AS rows, count(DISTINCT project) AS unique_projects, count(DISTINCT day) AS unique_days, CAST(sum(scheduled) AS BIGINT) AS scheduled, avg(median) AS m, avg(sampled) AS s, avg(weight) AS w, sum(raw) AS p FROM sch GROUP BY ALL)
SELECT th.target AS precision_target, th.threshold, x.strategy, round(tp::DOUBLE / sel, 6) AS precision, round(tp::DOUBLE / total, 6) AS recall, tp, sel - tp AS fp, total - tp AS fn, coalesce(rows, 0) AS rows, coalesce(unique_projects, 0) AS unique_projects,
  coalesce(unique_days, 0) AS unique_days, coalesce(scheduled, 0) AS scheduled, round(m, 6) AS median_mean, round(s, 6) AS sampled_mean, round(w, 6) AS weight_mean, round(p, 2) AS predicted_sum
FROM th CROSS JOIN (SELECT unnest(['median', 'iqr', 'churn', 'regression']) AS strategy) x LEFT JOIN su ON su.strategy = x.strategy AND su.target = th.target"""


def _swept(spark, sf, mode):
    days, found = settle(labelled(spark, sf), "labelled"), settle(s.detections(spark, sf), "detections")
    hit = F.when((F.col("flagged") == 1) & (F.col("added") % 100 >= 100 * F.col("risk")), 1).otherwise(0)
    curve = curves.precision_recall(s.scored(spark, sf).withColumn("hit", hit), "risk", "hit")
    out = sw.threshold_sweep(curve, _TARGETS, days, found, s.rates(spark, sf), mode=mode, cap=3.0, digits=6)
    rounded = ["precision", "recall", "median_mean", "sampled_mean", "weight_mean"]
    return out.drop("step").withColumns({**{c: F.round(c, 6) for c in rounded}, "predicted_sum": F.round("predicted_sum", 2)})


@query("l12_all_strategies", _sweep_sql(_PER_PROJECT))
def all_strategies(spark, sf):
    return _swept(spark, sf, "per_project")


@query("l12_all_strategies_cross_project", _sweep_sql(_CROSS_PROJECT))
def all_strategies_cross_project(spark, sf):
    return _swept(spark, sf, "cross_project")


_MODELS = """WITH m AS (SELECT c_mktsegment AS model, 'p' || c_nationkey AS project, count(*) AS n, round(CAST(count(*) FILTER (WHERE c_acctbal > 0) AS DOUBLE) / count(*), 4) AS share FROM customer GROUP BY ALL),
c AS (SELECT * FROM m WHERE project IN (SELECT project FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT model) FROM m)))"""


def _models(spark, sf):
    path = qa.experiments(spark, sf)
    metrics = rd.read_experiment_metrics(spark, f"{path}/metrics", multi_line=False)
    return cp.compare_models(metrics, rd.read_importances(spark, f"{path}/importances"), s.scored(spark, sf), ["precision", "recall", "mcc"], top_n=5)


@query("l15_best_projects", f"{_MODELS} SELECT model, project, value, rank FROM (SELECT model, project, share AS value, row_number() OVER (PARTITION BY model ORDER BY share DESC, project) AS rank FROM c) WHERE rank <= 5")
def best_projects(spark, sf):
    return _models(spark, sf)["best"].select("model", "project", "value", "rank")


@query("l15_strongest_features", """WITH f AS (SELECT c_mktsegment AS model, 'p' || c_nationkey AS project, 'f' || (c_custkey % 10) AS feature, greatest(CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE), 0) AS importance FROM customer GROUP BY ALL),
t AS (SELECT feature, quantile_cont(importance, 0.5) AS median FROM f GROUP BY 1 ORDER BY median DESC, feature LIMIT 10)
SELECT feature, model, project, importance, round(median, 6) AS median FROM f JOIN t USING (feature)""")
def strongest_features(spark, sf):
    return _models(spark, sf)["features"].select("feature", "model", "project", "importance", F.round("median", 6).alias("median"))


@query("l15_busiest_projects", f"""{_MODELS}, {s.SCORED_CTE.strip()},
b AS (SELECT project, count(*) FILTER (WHERE flagged = 1) AS positive_days FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT model, project, share AS precision, 0.5::DOUBLE AS recall, CASE WHEN n % 5 <> 0 THEN share / 2 END AS mcc, positive_days FROM c JOIN b USING (project)""")
def busiest_projects(spark, sf):
    return _models(spark, sf)["busiest"].select("model", "project", "precision", "recall", "mcc", "positive_days")
