"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import clean as c
from riskloom.functions import numeric as nm
from riskloom.functions import text as tx
from riskloom.operators import aggregates as ag
from riskloom.operators import ranking, scans
from riskloom.plans import detection, funnel, summaries
from riskloom.queries import standins as s
from riskloom.queries.registry import query
from riskloom.session import load


@query("d01_rule_aggregate", """
SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS commits, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total,
  round(CAST(sum(user_id) AS DOUBLE) / count(*), 6) AS mean_user, max(value) AS peak, min(user_id) AS low_user, arg_max(event_id, (ts, event_id)) AS newest
FROM events GROUP BY ALL""")
def rule_aggregate(spark, sf):
    df = load(spark, sf, "events").select(
        "event_type", F.to_date("ts").cast("string").alias("day"), "ts", "event_id",
        F.col("value").cast("decimal(12,2)").alias("money"), F.col("user_id").alias("mean_user"),
        F.col("value").alias("peak"), F.col("user_id").alias("low_user"), F.col("event_id").alias("newest"), F.lit(1).alias("commits"),
    )
    rules = {"commits": "count", "money": "sum", "mean_user": "mean", "peak": "max", "low_user": "min", "newest": "last", "not_there": "sum"}
    out = ag.rule_aggregate(df, ["event_type", "day"], rules, order=["ts", "event_id"], names={"money": "total"})
    return out.withColumns({"total": F.col("total").cast("double"), "mean_user": F.round("mean_user", 6)})


@query("d02_last_non_null", """
SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_id % 3 <> 0) AS last_value FROM events GROUP BY 1""")
def last_non_null(spark, sf):
    df = load(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return df.groupBy("user_id").agg(ag.last_non_null("v", "ts", "event_id").alias("last_value"))


@query("d03_exact_median", """
SELECT event_type AS project, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT 'all', round(quantile_cont(value, 0.5), 6), count(*) FROM events""")
def exact_median(spark, sf):
    df = load(spark, sf, "events").select(F.col("event_type").alias("project"), "value")
    per = scans.exact_quantiles(df, ["project"], "value", {"median": 0.5})
    everything = scans.exact_quantiles(df, [], "value", {"median": 0.5}).select(F.lit("all").alias("project"), "count", "median")
    return per.unionByName(everything).select("project", F.round("median", 6).alias("median"), F.col("count").alias("n"))


@query("d04_duration_quartiles", f"""WITH {s.DETECTIONS_CTE}
SELECT project, quantile_cont(days, 0.5) AS median, quantile_cont(days, 0.25) AS q1, quantile_cont(days, 0.75) AS q3, count(*) AS count
FROM detections WHERE days >= 0 GROUP BY 1""")
def duration_quartiles(spark, sf):
    # whole days: the distinct values per group are bounded by the length of the record
    return s.detections(spark, sf).filter("days >= 0").groupBy("project").agg(*ag.quartiles("days"))


_UNITS = f"""{s.DETECTIONS_CTE}, {s.RATES_CTE},
units AS (SELECT project, commit_day, CASE WHEN rate > 0 THEN days * rate ELSE CAST(days AS DOUBLE) END AS units
  FROM detections LEFT JOIN rates USING (project) WHERE days >= 0)"""


@query("d05_three_level_statistics", f"""WITH {_UNITS}
SELECT 'project' AS level, project, quantile_cont(units, 0.5) AS median, quantile_cont(units, 0.25) AS q1, quantile_cont(units, 0.75) AS q3, count(*) AS count FROM units GROUP BY project
UNION ALL SELECT 'global', NULL, quantile_cont(units, 0.5), quantile_cont(units, 0.25), quantile_cont(units, 0.75), count(*) FROM units
UNION ALL SELECT 'others', p.project, quantile_cont(units, 0.5), quantile_cont(units, 0.25), quantile_cont(units, 0.75), count(*)
  FROM (SELECT DISTINCT project FROM units) p JOIN units u ON u.project <> p.project GROUP BY p.project""")
def three_level_statistics(spark, sf):
    units = detection.detection_units(s.detections(spark, sf), s.rates(spark, sf))
    return detection.level_statistics(units)


@query("d06_daily_share", """
SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS BIGINT) AS covered,
  CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END) AS BIGINT) AS added,
  round(CASE WHEN sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END) > 0
    THEN CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS DOUBLE) / sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END) * 100 ELSE 0 END, 6) AS coverage
FROM lineitem GROUP BY 1""")
def daily_share(spark, sf):
    n = F.col("l_linenumber").cast("bigint")
    df = load(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").cast("string").alias("day"),
        F.when(F.col("l_returnflag") == "R", n).otherwise(0).alias("covered"),
        F.when(F.col("l_linestatus") == "F", n).otherwise(0).alias("added"),
    )
    return ag.daily_share(df, ["day"], "covered", "added", "coverage").withColumn("coverage", F.round("coverage", 6))


_PLAN_SQL = f"""{s.SCORED_CTE},
plan AS (SELECT project, day, added, CASE WHEN commit_count % 2 = 1 THEN added END AS extra FROM scored WHERE risk >= 0.5)"""


def _plan(spark, sf):
    return s.scored(spark, sf).filter("risk >= 0.5").select(
        "project", "day", "added", F.when(F.col("commit_count") % 2 == 1, F.col("added")).alias("extra")
    )


@query("d07_schedule_summary", f"""WITH {_PLAN_SQL}
SELECT 'plan' AS strategy, count(*) AS rows, count(DISTINCT project) AS unique_projects, count(DISTINCT day) AS unique_days,
  CAST(coalesce(sum(extra), 0) AS BIGINT) AS extra, round(CAST(sum(added) AS DOUBLE) / count(added), 6) AS added_mean FROM plan""")
def schedule_summary(spark, sf):
    out = ag.schedule_summary(_plan(spark, sf), "extra", means={"added_mean": "added"})
    return out.select(F.lit("plan").alias("strategy"), "*").withColumn("added_mean", F.round("added_mean", 6))


@query("d08_schedule_summary_by_project", f"""WITH {_PLAN_SQL}, noted AS (SELECT CASE WHEN project <> 'p3' THEN project END AS project, day, extra FROM plan)
SELECT project, count(*) AS rows, count(DISTINCT day) AS unique_days, CAST(coalesce(sum(extra), 0) AS BIGINT) AS extra FROM noted GROUP BY 1""")
def schedule_summary_by_project(spark, sf):
    df = _plan(spark, sf).withColumn("project", F.when(F.col("project") != "p3", F.col("project")))
    return ag.schedule_summary(df, "extra", keys=["project"])


_SIDE_SQL = f"""{_PLAN_SQL}, {s.RATES_CTE},
per_project AS (SELECT CASE WHEN day < DATE '1998-01-01' THEN 'early' ELSE 'late' END AS strategy, project, CAST(sum(added) AS BIGINT) AS total, count(*) AS rows FROM plan GROUP BY ALL),
side AS (SELECT strategy, project, total, rows, coalesce(rate, 0) * 1000 AS baseline FROM per_project LEFT JOIN rates USING (project))"""


def _side(spark, sf):
    per = _plan(spark, sf).groupBy(
        F.when(F.col("day") < F.lit("1998-01-01").cast("date"), "early").otherwise("late").alias("strategy"), "project"
    ).agg(F.sum("added").alias("total"), F.count("*").alias("rows"))
    return per, s.rates(spark, sf).select("project", (F.col("rate") * 1000).alias("baseline"))


@query("d09_strategy_totals", f"""WITH {_SIDE_SQL}
SELECT strategy, CAST(sum(total) AS BIGINT) AS total, quantile_cont(total, 0.5) AS median_total, round(CAST(sum(total) AS DOUBLE) / count(*), 6) AS mean_total,
  sum(baseline) AS baseline, sum(baseline - total) AS saved, count(*) AS projects FROM side GROUP BY 1""")
def strategy_totals(spark, sf):
    per, base = _side(spark, sf)
    out = summaries.strategy_totals(summaries.against_baseline(per, base, "total"), "total")
    return out.withColumn("mean_total", F.round("mean_total", 6))


@query("d10_daily_totals", f"""WITH {_PLAN_SQL}
SELECT 'plan' AS strategy, project, CAST(day AS VARCHAR) AS day, CAST(sum(added) AS BIGINT) AS total FROM plan GROUP BY ALL ORDER BY 1, 2, 3""")
def daily_totals(spark, sf):
    df = _plan(spark, sf).withColumn("strategy", F.lit("plan")).withColumn("day", F.col("day").cast("string"))
    return df.groupBy("strategy", "project", "day").agg(F.sum("added").alias("total")).orderBy("strategy", "project", "day")


@query("d11_mean_by_two_keys", """
WITH m AS (SELECT c_mktsegment AS model, 'n' || (c_nationkey % 3) AS metric, c_custkey AS project, CAST(c_acctbal AS DECIMAL(12,2)) AS value FROM customer)
SELECT a.model, metric, round(mean_value, 6) AS mean_value, project_count FROM
 (SELECT model, metric, CAST(sum(value) AS DOUBLE) / count(*) AS mean_value FROM m GROUP BY ALL) a
 JOIN (SELECT model, count(DISTINCT project) AS project_count FROM m GROUP BY 1) b ON a.model = b.model""")
def mean_by_two_keys(spark, sf):
    df = load(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("model"), F.concat(F.lit("n"), F.col("c_nationkey") % 3).alias("metric"),
        F.col("c_custkey").alias("project"), F.col("c_acctbal").cast("decimal(12,2)").alias("value"),
    )
    return summaries.mean_by_model(df).withColumn("mean_value", F.round("mean_value", 6))


@query("d12_most_common", """
SELECT word, n FROM (SELECT word, count(*) AS n, min(doc_id) AS first_seen FROM
  (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1)
ORDER BY n DESC, first_seen, word LIMIT 10""")
def most_common(spark, sf):
    words = load(spark, sf, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    counts = words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen", "word").limit(10).select("word", "n")


@query("d13_first_value_per_key", f"""WITH {s.COMMIT_FILES_CTE}
SELECT path, arg_min(author, commit_id) AS first_author, count(DISTINCT day) AS days FROM commit_files GROUP BY 1""")
def first_value_per_key(spark, sf):
    df = s.commit_files(spark, sf)
    first = df.groupBy("path").agg(F.min_by("author", "commit_id").alias("first_author"))
    # distinct days: made unique per (path, day) first, so a busy path is counted by many tasks
    days = df.select("path", "day").distinct().groupBy("path").agg(F.count("*").alias("days"))
    return first.join(days, "path")


@query("d14_filter_funnel", f"""WITH {s.DETECTIONS_CTE}, {s.RATES_CTE},
base AS (SELECT d.*, r.rate FROM detections d JOIN rates r USING (project)),
s1 AS (SELECT * FROM base WHERE days >= 0), s2 AS (SELECT * FROM s1 WHERE rate > 0),
s3 AS (SELECT * FROM s2 WHERE part_no IN (SELECT part_no FROM s2 GROUP BY 1 HAVING count(*) >= 2)),
s4 AS (SELECT * FROM s3 WHERE commit_day >= DATE '1997-01-01')
SELECT (SELECT count(*) FROM base) AS total_issues, (SELECT count(*) FROM s1) AS known_issues, (SELECT count(DISTINCT part_no) FROM s1) AS known_repos,
  (SELECT count(*) FROM s2) AS cloned_issues, (SELECT count(DISTINCT part_no) FROM s2) AS cloned_repos,
  (SELECT count(*) FROM s3) AS enough_issues, (SELECT count(DISTINCT part_no) FROM s3) AS enough_repos, (SELECT count(*) FROM s4) AS final_issues,
  round((SELECT count(*) FROM s1) * 100.0::DOUBLE / (SELECT count(*) FROM base), 6) AS known_percent""")
def filter_funnel(spark, sf):
    df = s.detections(spark, sf).join(s.rates(spark, sf), "project").select(
        F.col("part_no").alias("repo"),
        (F.col("days") >= 0).alias("known"),
        F.coalesce(F.col("rate") > 0, F.lit(False)).alias("cloned"),
        (F.col("commit_day") >= F.lit("1997-01-01").cast("date")).alias("eligible"),
    )
    return funnel.stage_counts(df, min_per_repo=2).withColumn("known_percent", F.round("known_percent", 6))


@query("d15_day_flags", f"""WITH d AS (SELECT s_nationkey AS nation, CAST(l_shipdate AS DATE) AS day, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hit
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT 'p' || nation AS project, count(*) AS total_days, CAST(sum(hit) AS BIGINT) AS days_with, CAST(count(*) - sum(hit) AS BIGINT) AS days_without FROM d GROUP BY nation
UNION ALL SELECT 'all', count(*), CAST(sum(hit) AS BIGINT), CAST(count(*) - sum(hit) AS BIGINT) FROM d""")
def day_flags(spark, sf):
    df = s.lines_by_project(spark, sf, "l_shipdate", "l_returnflag").select(
        "project", F.to_date("l_shipdate").alias("day"), (F.col("l_returnflag") == "R").cast("int").alias("flag")
    )
    return funnel.day_flag_totals(df)


@query("d16_distinct_ids", f"""WITH {s.DETECTIONS_CTE},
ids AS (SELECT project, CASE WHEN issue_id <> '' THEN issue_id WHEN trim(introduced) <> '' THEN 'introduced:' || introduced ELSE 'row_' || order_no END AS id
  FROM detections WHERE project IN ('p1','p2','p3','p5','p8','p13'))
SELECT project, count(DISTINCT id) AS ids FROM ids GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT id) FROM ids""")
def distinct_ids(spark, sf):
    allowed = load(spark, sf, "nation").filter(F.col("n_nationkey").isin(1, 2, 3, 5, 8, 13)).select(
        F.concat(F.lit("p"), "n_nationkey").alias("project")
    )
    df = s.detections(spark, sf).withColumn("id", tx.stable_id(["issue_id"], "introduced", "order_no"))
    return funnel.distinct_targets(df, allowed)


@query("d17_report_counts", f"""WITH r AS (SELECT DISTINCT s_nationkey AS nation, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')
SELECT 'p' || nation AS project, count(*) AS reports, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM r GROUP BY nation
UNION ALL SELECT 'all', count(*), CAST(min(day) AS VARCHAR), CAST(max(day) AS VARCHAR) FROM r""")
def report_counts(spark, sf):
    df = s.lines_by_project(spark, sf, "l_shipdate").select("project", F.to_date("l_shipdate").alias("day"))
    ends = [F.lit(d).cast("date") for d in ("1999-12-31", "1996-01-01")]
    out = funnel.report_totals(df.filter(c.within_open_ended("day", *ends)))
    return out.withColumns({k: F.col(k).cast("string") for k in ("first_day", "last_day")})


@query("d18_class_floor", """
WITH y AS (SELECT event_type || '-' || (user_id % 40) AS project, event_id, CASE WHEN value > 60 THEN 1 ELSE 0 END AS label FROM events)
SELECT project, event_id, label FROM y WHERE project IN (SELECT project FROM y GROUP BY 1 HAVING least(sum(label), sum(1 - label)) >= 10)""")
def class_floor(spark, sf):
    df = load(spark, sf, "events").select(
        F.concat("event_type", F.lit("-"), F.col("user_id") % 40).alias("project"), "event_id", (F.col("value") > 60).cast("int").alias("label")
    )
    return ag.class_floor(df, "project", "label", 10)


@query("d19_positive_days", f"""WITH {s.SCORED_CTE} SELECT project, CAST(sum(CASE WHEN flagged = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positive_days FROM scored GROUP BY 1""")
def positive_days(spark, sf):
    return s.scored(spark, sf).groupBy("project").agg(F.count_if(F.col("flagged") == 1).alias("positive_days"))


@query("d20_fold_means", """
SELECT c_mktsegment AS model, round(CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) FILTER (WHERE c_acctbal > 0) AS DOUBLE) / count(*) FILTER (WHERE c_acctbal > 0), 6) AS score,
  round(CAST(sum(c_nationkey) AS DOUBLE) / count(*), 6) AS importance FROM customer GROUP BY 1""")
def fold_means(spark, sf):
    value = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(12,2)"))
    return load(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(
        F.round(F.sum(value).cast("double") / F.count(value), 6).alias("score"), F.round(F.avg("c_nationkey"), 6).alias("importance")
    )


@query("d21_wide_to_long", """
SELECT s_suppkey, 'balance' AS metric, s_acctbal AS value FROM supplier WHERE s_acctbal > 0
UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier""")
def wide_to_long(spark, sf):
    df = load(spark, sf, "supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"), F.col("s_nationkey").cast("double").alias("nation")
    )
    return ag.wide_to_long(df, ["s_suppkey"], ["balance", "nation"])


@query("d22_pivot_sum", """
SELECT o_custkey AS project, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS BIGINT) AS "F", CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS BIGINT) AS "O",
  CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS BIGINT) AS "P" FROM orders GROUP BY 1""")
def pivot_sum(spark, sf):
    df = load(spark, sf, "orders").select(F.col("o_custkey").alias("project"), "o_orderstatus", F.lit(1).alias("n"))
    return df.groupBy("project").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("n"))


@query("d23_top_n_mean", """
SELECT event_type AS model, round(CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*), 6) AS top_mean FROM
 (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5 GROUP BY 1""")
def top_n_mean(spark, sf):
    top = ranking.top_per_group(load(spark, sf, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 5)
    return top.groupBy(F.col("event_type").alias("model")).agg(
        F.round(F.sum(F.col("value").cast("decimal(12,2)")).cast("double") / F.count("*"), 6).alias("top_mean")
    )


@query("d24_error_statistics", """
WITH e AS (SELECT l_suppkey % 4 AS fold, l_linenumber - 1 AS actual, l_quantity / 8 AS predicted FROM lineitem),
r AS (SELECT fold, actual, predicted FROM e UNION ALL SELECT NULL, actual, predicted FROM e)
SELECT coalesce('fold-' || fold, 'overall') AS fold, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse,
  round(avg(abs(actual - predicted) / abs(actual)) FILTER (WHERE actual <> 0), 6) AS mape, count(*) AS count FROM r GROUP BY fold""")
def error_statistics(spark, sf):
    df = load(spark, sf, "lineitem").select(
        F.concat(F.lit("fold-"), F.col("l_suppkey") % 4).alias("fold"), (F.col("l_linenumber") - 1).alias("actual"), (F.col("l_quantity") / 8).alias("predicted")
    )
    out = df.rollup("fold").agg(*ag.error_statistics("actual", "predicted"))
    return out.select(F.coalesce("fold", F.lit("overall")).alias("fold"), *[F.round(m, 6).alias(m) for m in ("mae", "rmse", "mape")], "count")


@query("d25_fold_bounds", f"""WITH {s.SCORED_CTE}
SELECT project, 'fold-' || (commit_count % 3) AS fold, CAST(min(day) AS VARCHAR) AS start_day, CAST(max(day) AS VARCHAR) AS end_day, count(*) AS rows FROM scored GROUP BY ALL""")
def fold_bounds(spark, sf):
    df = s.scored(spark, sf).withColumn("fold", F.concat(F.lit("fold-"), F.col("commit_count") % 3))
    return df.groupBy("project", "fold").agg(
        F.min("day").cast("string").alias("start_day"), F.max("day").cast("string").alias("end_day"), F.count("*").alias("rows")
    )


@query("d26_conditional_counts", """
SELECT event_type, count(*) FILTER (WHERE value > 50) AS hits, count(DISTINCT user_id) FILTER (WHERE value > 50) AS users_hit,
  round(CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) / nullif(count(*) FILTER (WHERE value > 10), 0), 6) AS hit_rate,
  CAST(count(*) AS DOUBLE) / nullif(count(*) FILTER (WHERE value < 0), 0) AS empty_rate FROM events GROUP BY 1""")
def conditional_counts(spark, sf):
    # distinct users per type: first unique per (type, user), then counted, so a large type is spread out
    users = load(spark, sf, "events").groupBy("event_type", "user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("h"), F.count_if(F.col("value") > 10).alias("m"), F.count_if(F.col("value") < 0).alias("z")
    )
    sums = users.groupBy("event_type").agg(
        F.sum("h").alias("hits"), F.count_if(F.col("h") > 0).alias("users_hit"), F.sum("m").alias("m"), F.sum("z").alias("z"), F.sum("n").alias("n")
    )
    return sums.select(
        "event_type", "hits", "users_hit", F.round(nm.ratio_or_null("hits", "m"), 6).alias("hit_rate"), nm.ratio_or_null("n", "z").alias("empty_rate")
    )


@query("d27_baseline_on_every_row", f"""WITH {_PLAN_SQL}
SELECT project, count(*) AS rows, (SELECT count(*) FROM orders) AS baseline_count,
  (SELECT round(CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(*), 6) FROM orders) AS baseline_mean FROM plan GROUP BY 1""")
def baseline_on_every_row(spark, sf):
    base = load(spark, sf, "orders").agg(
        F.count("*").alias("baseline_count"),
        F.round(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double") / F.count("*"), 6).alias("baseline_mean"),
    )
    return ag.with_constants(_plan(spark, sf).groupBy("project").agg(F.count("*").alias("rows")), base)


@query("d28_keep_first_or_last", """
SELECT user_id, 'first' AS kept, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1
UNION ALL SELECT user_id, 'last', event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def keep_first_or_last(spark, sf):
    df = load(spark, sf, "events").select("user_id", "event_id", "ts")
    cols = ["user_id", "kept", "event_id"]
    first = ag.first_by(df.withColumn("kept", F.lit("first")), ["user_id"], ["ts", "event_id"], cols)
    last = ag.first_by(df.withColumn("kept", F.lit("last")), ["user_id"], [F.desc("ts"), F.desc("event_id")], cols)
    return first.unionByName(last)


_CONFUSION = """c AS (SELECT event_type || (user_id % 5) AS grp,
  CAST(sum(CASE WHEN v > 400 AND p > 30 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN v <= 400 AND p > 30 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN v > 400 AND p <= 30 THEN 1 ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN v <= 400 AND p <= 30 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
  FROM (SELECT *, value * 3 AS v, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS p FROM events) GROUP BY 1)"""


def _confusion(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    df = load(spark, sf, "events").select(
        F.concat("event_type", F.col("user_id") % 5).alias("grp"), (F.col("value") * 3 > 400).cast("int").alias("y"), (k > 30).cast("int").alias("p")
    )
    return df.groupBy("grp").agg(*ag.confusion("y", "p"))


@query("d29_class_report", f"""WITH {_CONFUSION}
SELECT grp, round(CASE WHEN tp + fn = 0 AND tp + fp = 0 THEN NULL WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, CAST(tp + fn AS BIGINT) AS support FROM c""")
def class_report(spark, sf):
    out = _confusion(spark, sf).select("grp", *ag.class_report())
    return out.select("grp", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1", "accuracy")], "support")


@query("d30_matthews_correlation", f"""WITH {_CONFUSION}
SELECT grp, round(CASE WHEN tp + fn = 0 THEN NULL WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) = 0 THEN 0 ELSE (tp*tn - fp*fn) / sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) END, 6) AS mcc FROM c""")
def matthews_correlation(spark, sf):
    return _confusion(spark, sf).select("grp", *ag.class_report()).select("grp", F.round("mcc", 6).alias("mcc"))
